"""A sink of whole files: rows (path, content) become files below a folder.

Tasks write below a folder of the job, ``_job-<id>``, under names of their own; what committed tasks wrote is moved into place
when the job commits, so failed, repeated and aborted attempts leave nothing. A file of the same name is replaced; with mode
``overwrite`` all that was in the folder goes. Of rows with one path, any one stays.

Use :func:`save`, or ``df.write.format("tessella_files").mode("append").save(uri)`` after :func:`register`, with a whole URI:
workers do not know the session's default file system, :func:`save` does.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tessella.shipping import ship

#: Files moved at once when a job commits.
MOVERS = 32


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        if "://" not in self.folder and not self.folder.startswith("file:"):
            raise ValueError(f"a whole URI is needed, not {self.folder}")
        self.job = f"_job-{uuid.uuid4().hex}"

    def place(self):
        from pyarrow import fs

        at = self.folder if "://" in self.folder else "file://" + self.folder.removeprefix("file:")
        system, root = fs.FileSystem.from_uri(at)
        return system, root.rstrip("/")

    def write(self, rows: Iterator[Row]) -> Written:
        system, root = self.place()
        task = f"{root}/{self.job}/{uuid.uuid4().hex}"
        files = []
        for row in rows:
            if row.path.startswith("/") or ".." in row.path.split("/") or row.path.startswith("_job-"):
                raise ValueError(f"not a path below the folder: {row.path}")
            if not files:
                system.create_dir(task, recursive=True)
            part = f"{task}/{len(files)}"
            with system.open_output_stream(part) as out:
                out.write(bytes(row.content))
            files.append((part, row.path))
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        from pyarrow import fs

        system, root = self.place()
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.base_name != self.job:
                    (system.delete_dir if old.type == fs.FileType.Directory else system.delete_file)(old.path)
        files = {to: part for m in messages if m is not None for part, to in m.files}
        for folder in {os.path.dirname(to) for to in files}:
            system.create_dir(f"{root}/{folder}".rstrip("/"), recursive=True)

        def move(item: tuple[str, str]) -> None:
            to = f"{root}/{item[0]}"
            if system.get_file_info(to).type != fs.FileType.NotFound:
                system.delete_file(to)
            system.move(item[1], to)

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(move, files.items()))
        self.clear(system, root)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self.clear(*self.place())

    def clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FileSink)


def save(files: DataFrame, folder: str, mode: str = "append") -> str:
    """Writes rows (path, content) below ``folder``, by default on the session's file system; returns the folder's URI."""
    spark = files.sparkSession
    register(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = path.makeQualified(system.getUri(), system.getWorkingDirectory()).toString()
    files.write.format(FileSink.name()).mode(mode).save(uri)
    return uri


def scratch(spark: SparkSession) -> str:
    """A fresh folder that all executors share: below spark.checkpoint.dir, or a local one where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"tessella-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
