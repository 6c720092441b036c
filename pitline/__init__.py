"""Point-in-time analytics over bitemporal facts, written as PySpark DataFrame operators."""

__version__ = "0.1.0"
