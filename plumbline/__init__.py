"""plumbline: vector search, command-log and analytics operators on PySpark."""

__version__ = "0.1.0"
