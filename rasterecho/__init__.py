"""Temporal feedback over raster tables, written with the PySpark DataFrame API."""
