"""Service-desk case metrics as PySpark DataFrame plans."""

__version__ = "0.1.0"
