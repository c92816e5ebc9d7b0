"""Spark-first analytics for environmental time series, grids and rasters."""
