"""Scan-oriented signal analytics as PySpark DataFrame plans."""
