"""Contract-driven analytics over published snapshot tables, on PySpark."""

__version__ = "0.1.0"
