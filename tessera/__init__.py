"""Mesh, field and particle analytics on PySpark DataFrames."""
