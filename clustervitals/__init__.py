"""Data-platform health analytics as PySpark DataFrame operators."""
