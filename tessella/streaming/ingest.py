"""Files as they arrive: the batch readers over a stream of files. A convenience; the formats have no time of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.shipping import ship

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*", most_files: int = 1000) -> DataFrame:
    """A stream of (path, content); hand it to any reader of ``tessella.sources.files`` that is a map over files."""
    ship(spark)
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most_files).load(folder).select("path", "content")
