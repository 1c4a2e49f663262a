"""File names of views and their frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file's name up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def is_view(path: Column) -> Column:
    return F.lower(path).endswith(".v56")


def loop_of(path: Column) -> Column:
    """The loop number in names like ``102-3-0.bmp``; null for others."""
    found = F.regexp_extract(path, r"(?i)(?:^|/)\d+-(\d+)-\d+\.bmp$", 1)
    return F.when(found != "", found.cast("int"))


def frame_path(cell: Column, loop: Column, mirror_of: Column) -> Column:
    """Where a dumped frame goes: an image, or a note that it mirrors another loop."""
    folder = F.format_string("Cell%d/Loop%d/", cell, loop)
    return F.concat(folder, F.when(mirror_of.isNull(), F.format_string("view_%d_loop%d.png", cell, loop)).otherwise(F.format_string("mirror_of_%d.txt", mirror_of)))
