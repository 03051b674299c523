"""Analytics over log-structured, versioned key-value data, written for PySpark."""

__version__ = "0.1.0"
