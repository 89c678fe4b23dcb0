"""Empty by design: the dialect is batch only. Extensions over streams would live here."""
