"""Interval, evidence and corpus analytics expressed as PySpark DataFrame operators."""
