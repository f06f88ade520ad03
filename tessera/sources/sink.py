"""A Spark sink that writes one file a row, through any file system that Arrow can reach."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.ship import ship


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else os.path.abspath(uri))


def relative(path: str) -> str:
    """A path without its scheme, host and leading slashes; steps upwards are left out, so it stays below the folder."""
    found = urlparse(path).path if "://" in path or path.startswith("file:") else path
    return "/".join(p for p in found.split("/") if p not in ("", ".", ".."))


class FileSink(DataSource):
    """``df.write.format("files").save(folder)``: the bytes ``content`` of each row at ``path`` below the folder.

    Folders within the path are kept, so files of one name in two folders stay
    two. Rows without content are left out. A file is written under a temporary
    name and moved, so a task that is run again leaves one file. Mode overwrite
    empties the folder first.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            system, folder = located(self.options["path"])
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir_contents(folder)
        return FileWriter(self.options)


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.folder = options["path"]
        self.options = dict(options)

    def files(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        """Name and bytes of each file."""
        for f in batch.to_pylist():
            if f["content"] is not None:
                yield f["path"], f["content"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, folder = located(self.folder)
        for batch in batches:
            for name, raw in self.files(batch):
                target = f"{folder.rstrip('/')}/{relative(name)}"
                system.create_dir(os.path.dirname(target), recursive=True)
                temporary = f"{target}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(temporary) as out:
                    out.write(raw)
                system.move(temporary, target)
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(FileSink)
