"""Files in and out: binary scans, the frame source, and a sink of one file for each row."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..functions import codecs, columns as C
from ..functions._bytes import WINDOW
from ..operators import frames as frames_of, tar


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, relative, modificationTime, length, content; column pruning and filters on length reach the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = path if isinstance(path, str) else os.path.commonpath(path)
    relative = F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() else c for c in base.rstrip("/")) + "/", "")
    return reader.load(path).withColumn("relative", relative)


def read_frames(spark: SparkSession, path: str | list[str], pattern: str | None = "*.lz4") -> DataFrame:
    """The frames table of all files of a folder."""
    return frames_of.frames(read_files(spark, path, pattern), "path", "content")


def read_tar(spark: SparkSession, path: str | list[str], pattern: str | None = "*.{tar,tar.lz4}") -> DataFrame:
    """The entries of all archives of a folder that look like archives, plain or compressed."""
    files = read_files(spark, path, pattern).select("path", "content")
    packed = C.frame_type("content").isin("standard", "legacy", "skippable")
    files = files.select("path", F.when(packed, codecs.frame_decompress("content")["data"]).otherwise(F.col("content")).alias("content"))
    return tar.unpack(files.filter(C.is_tar("content")), "path", "content")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    """What a coder can use of a dictionary file: its last 65,535 bytes, which is what comes to the driver."""
    row = read_files(spark, path).select(F.substring("content", -WINDOW, WINDOW)).first()
    return bytes(row[0]) if row else b""


def store_of(path: str):
    """(file system, path within it) of a local path or of a URI that PyArrow knows."""
    if "://" in path or path.startswith("file:"):
        return FileSystem.from_uri(path)
    return LocalFileSystem(), os.path.abspath(path)


class FileSink(DataSource):
    """Writes (name, data) rows as files below the folder given as `path`; a file appears whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"], [f.name for f in schema.fields])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = store_of(self.path)
        for row in rows:
            own = dict(zip(self.names, row))
            target = posixpath.normpath(posixpath.join(root, own["name"]))
            if posixpath.commonpath([root, target]) != root or target == root:
                raise ValueError(f"a name leaves the folder: {own['name']!r}")
            store.create_dir(posixpath.dirname(target), recursive=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write(own["data"] or b"")
            store.move(part, target)
        return WriterCommitMessage()


def write_files(df: DataFrame, path: str) -> None:
    """Each row (name, data) as one file below path (a folder that all executors share)."""
    df.sparkSession.dataSource.register(FileSink)
    df.select("name", "data").write.format("onefile").mode("append").option("path", path).save()


def extract_tar(entries: DataFrame, path: str) -> None:
    """The non-empty files of unpack(), by base name; of equal ones the later get a number before the ending."""
    key, at = entries.columns[0], "entry_index"
    base = F.regexp_extract("name", "[^/]+$", 0)
    rows = entries.filter((F.col("type") == "0") & (F.octet_length("data") > 0)).withColumn("base", base)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy(key, at)))
    name = F.regexp_replace("base", r"^(.+?)(\.[^.]*)?$", F.concat(F.lit("$1 ("), (F.col("n") - 1).cast("string"), F.lit(")$2")))
    write_files(rows.select(F.when(F.col("n") == 1, F.col("base")).otherwise(name).alias("name"), "data"), path)
