"""Palettes, frames and pixels as DataFrames: a Spark-native raster and palette engine."""
