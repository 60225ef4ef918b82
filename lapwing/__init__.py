"""Lapwing: as-of analytics over event results, and training-data operators, on PySpark."""
