"""Benchmark rows: size, ratio and speed of compression and decompression, on generated buffers or on the caller's files."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import codecs
from ..plans.compress import FrameOptions, compress_frames

SIZES = (1 << 10, 1 << 12, 1 << 14, 1 << 16, 1 << 18, 1 << 20)
#: Rows of each size, so that a run has work for every core.
COPIES = 64


def generated(spark: SparkSession, size: int, copies: int = COPIES) -> DataFrame:
    """id, content: `copies` rows of the generator's buffer of `size` bytes."""
    one = spark.range(1).select(codecs.generated(F.lit(size)).alias("content"))
    return spark.range(0, copies, 1, 8).join(F.broadcast(one))


def _timed(df: DataFrame, runs: int, warm: int) -> float:
    for _ in range(warm):
        df.write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    for _ in range(runs):
        df.write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) / runs


def measure(df: DataFrame, options: FrameOptions = FrameOptions(), runs: int = 3, warm: int = 1) -> tuple:
    """(input bytes, compressed bytes, ratio, MB/s in, MB/s out, ms in, ms out) of df (content and others), means of `runs`."""
    df = df.persist()
    made = compress_frames(df, "content", options)
    n = df.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    packed = made.agg(F.sum(F.octet_length("frame"))).first()[0] or 0
    a = _timed(made, runs, warm)
    made = made.persist()
    made.count()
    b = _timed(made.select(F.octet_length(codecs.frame_decompress("frame")["data"]).alias("n")), runs, warm)
    made.unpersist()
    df.unpersist()
    return n, packed, round(n / max(packed, 1), 2), round(n / a / 1e6, 1), round(n / b / 1e6, 1), round(a * 1e3, 1), round(b * 1e3, 1)


SCHEMA = "input_size long, compressed_size long, ratio double, compress_mb_s double, decompress_mb_s double, compress_ms double, decompress_ms double"


def results(spark: SparkSession, sizes=SIZES, options: FrameOptions = FrameOptions(), runs: int = 3, max_size: int | None = None) -> DataFrame:
    """One row for each size up to max_size: means of three runs after one."""
    return spark.createDataFrame([measure(generated(spark, s), options, runs) for s in sizes if max_size is None or s <= max_size], SCHEMA)


def results_of(df: DataFrame, options: FrameOptions = FrameOptions()) -> DataFrame:
    """The row of the caller's own data: means of five runs after two."""
    return df.sparkSession.createDataFrame([measure(df, options, runs=5, warm=2)], SCHEMA)


def file_statistics(df: DataFrame, content: str = "content", options: FrameOptions = FrameOptions()) -> DataFrame:
    """df with original_size, compressed_size, ratio, compress_ms, decompress_ms, compress_mb_s and decompress_mb_s of each cell instead of content.

    Each cell is compressed and decompressed whole in its task and timed there, as a file of its own.
    """
    others = [c for c in df.columns if c != content]
    rows = df.select(F.struct(*[df[c] for c in others]).alias("row"), codecs.timed_cell(content, options).alias("t"))
    speed = lambda ms: F.when(F.col(ms) > 0, F.round(F.col("t.original_size") / 1e3 / F.col(ms), 1))
    ratio = F.when(F.col("t.compressed_size") > 0, F.round(F.col("t.original_size") / F.col("t.compressed_size"), 2))
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in others], "t.original_size", "t.compressed_size", ratio.alias("ratio"), "t.compress_ms", "t.decompress_ms",
        speed("t.compress_ms").alias("compress_mb_s"), speed("t.decompress_ms").alias("decompress_mb_s"), "t.intact",
    )
