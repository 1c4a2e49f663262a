"""What the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.shipping import ship

#: Rows of an Arrow batch that are worked on at once; bounds a worker's memory.
SLICE_ROWS = 512
#: Bytes of text after which a slice ends earlier.
SLICE_BYTES = 512 << 10
#: Whether Spark removes the shuffle files of a query when it ends; otherwise they stay until the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What Spark hands over to a worker at once: its settings, by default, and ours.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def ready(df: DataFrame) -> None:
    """Workers get the package, and batches that bound their memory where the session leaves that to Spark."""
    spark = df.sparkSession
    ship(spark)
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir; a local one only where the setting is absent (tests)."""
    base = checkpoint_base(spark)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def checkpoint_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tessella-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder from whatever file system it lies on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there; the shuffles that made it aren't read again and go."""
    spark = df.sparkSession
    checkpoint_base(spark)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query keeps the setting it was made under
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def slices(batches: Iterator[pa.RecordBatch], sized: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of at most SLICE_ROWS rows and, beyond one row, ``most`` bytes of column ``sized``."""
    import pyarrow.compute as pc

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(sized)), 0).to_pylist()
        lo = size = 0
        for i, k in enumerate(lengths):
            if i > lo and (i - lo >= SLICE_ROWS or size + k > most):
                yield batch.slice(lo, i - lo)
                lo, size = i, 0
            size += k
        yield batch.slice(lo, n - lo)
