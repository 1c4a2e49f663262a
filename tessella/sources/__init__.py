"""Spark sources and sinks of the file formats: batch readers by ``binaryFile``, and Python data sources for writing."""
