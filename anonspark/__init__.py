"""anonspark: find, tokenize, redact and restore sensitive values with PySpark."""

__version__ = "0.1.0"
