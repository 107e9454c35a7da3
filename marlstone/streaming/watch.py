"""Structured Streaming over a folder of files, with the same functions as the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codecs

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch_frames(spark: SparkSession, path: str, pattern: str = "*.lz4", per_trigger: int = 1000) -> DataFrame:
    """A stream with path, length, the verdict and the size of the content of every new file."""
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)
    )
    rows = files.select("path", "length", codecs.frame_decompress("content").alias("d"))
    ok = F.col("d.error").isNull() & F.coalesce("d.content_checksum_valid", F.lit(True))
    return rows.select("path", "length", ok.alias("ok"), "d.error", F.octet_length("d.data").cast("long").alias("original_size"))
