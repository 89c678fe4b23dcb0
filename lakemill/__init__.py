"""A Spark engine for lakehouse tables and training data."""
