"""Rivulet: SQL over ordered event streams, on PySpark."""
