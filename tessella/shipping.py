"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent
_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Hand the package to every worker once per application (the driver serves the archive itself)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    fd, name = tempfile.mkstemp(prefix=f"{_ROOT.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"{_ROOT.name}/{p.relative_to(_ROOT)}")
    sc.addPyFile(name)
    _shipped[sc.applicationId] = name
