"""Governed analytics over tables, as PySpark DataFrame jobs."""
