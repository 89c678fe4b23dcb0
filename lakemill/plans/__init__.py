"""The dialect: what is read, rewritten and refused."""
