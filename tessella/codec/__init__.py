"""Pure-Python readers and writers of the file formats; no Spark."""
