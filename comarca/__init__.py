"""Geo-commercial analytics as PySpark DataFrame operators."""
