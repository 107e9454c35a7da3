"""Files larger than a cell, read by ranges: each range is a row, so a file of any size is spread over all tasks.

Compression makes one frame for each range; the frames of a file, in order, are one valid stream. Decompression first walks the
block headers of each file with small reads, then reads and decodes the blocks as rows. The paths must be ones that PyArrow's file
systems open (local or shared folders, and the stores it knows); everything else about the files comes from Spark's own listing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import _bytes, codecs
from ..plans.compress import FrameOptions, compress_frames
from .files import read_files, store_of

RANGE_BYTES = 64 << 20


def _opened(path: str):
    store, own = store_of(re.sub(r"^file:/+", "/", path))
    return store.open_input_file(own)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, part, offset, length) with the bytes of the range; one range at a time is held."""
    for b in batches:
        for i, (path, offset, length) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3)))):
            with _opened(path) as f:
                content = f.read_at(length, offset)
            yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in b.columns), pa.array([content], pa.binary())], names=[*b.schema.names, "content"])


def file_ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """path, part, offset, length, content of the ranges of at most `size` bytes of files (path, length). Spark's listing leaves out empty files."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))
    rows = files.select("path", F.col("length").alias("whole"), F.posexplode(starts).alias("part", "offset"))
    rows = rows.select("path", F.col("part").cast("long").alias("part"), "offset", F.least(F.col("whole") - F.col("offset"), F.lit(size)).alias("length"))
    return rows.repartition("path", "part").mapInArrow(_read, "path string, part long, offset long, length long, content binary")


def compress_files(spark: SparkSession, path: str, pattern: str | None = None, options: FrameOptions = FrameOptions(), size: int = RANGE_BYTES) -> DataFrame:
    """path, part, frame, original_size: the frames of each file; their concatenation in order of part is the compressed file."""
    ranges = file_ranges(read_files(spark, path, pattern).select("path", "length"), size)
    return compress_frames(ranges.select("path", "part", "content"), "content", options)


_PLACE = "path string, part long, offset long, length long, plain boolean, most long, error string"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, length) to the blocks of all frames of each file, found by reading headers only."""
    names = [c.split()[0] for c in _PLACE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    for b in batches:
        for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            with _opened(path) as f:
                rows = [(path, i, *place) for i, place in enumerate(_walked(f, length))]
            cols = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _walked(f, length: int) -> Iterator[tuple[int, int, bool, int, str | None]]:
    """(offset, length, raw, largest size, error) of the data of each block of a file's frames."""
    word = lambda at: int.from_bytes(f.read_at(4, at), "little") if at + 4 <= length else None
    pos = 0
    while pos < length:
        magic = word(pos)
        if magic is not None and magic & ~15 == _bytes.SKIPPABLE_BASE and pos + 8 <= length:
            pos += 8 + word(pos + 4)
            continue
        head = f.read_at(2, pos + 4) if magic == _bytes.FRAME_MAGIC else b""
        if len(head) < 2:
            yield pos, 0, True, 0, "No standard frame here"
            return
        flg, most = head[0], _bytes.BLOCK_SIZES.get(head[1] >> 4 & 7, 1 << 16)
        pos += 7 + (8 if flg & 8 else 0) + (4 if flg & 1 else 0)
        blocks = 0
        while size := word(pos):
            blocks += 1
            if not flg & 32 and blocks > 1:
                yield pos, 0, True, 0, "Linked blocks need the one before"
                return
            n = size & 0x7FFFFFFF
            if pos + 4 + n > length:
                yield pos, 0, True, 0, "Truncated block data"
                return
            yield pos + 4, n, bool(size >> 31), most, None
            pos += 4 + n + (4 if flg & 16 else 0)
        if size is None:
            yield pos, 0, True, 0, "Truncated block data"
            return
        pos += 4 + (4 if flg & 4 else 0)


def decompress_files(spark: SparkSession, path: str, pattern: str | None = "*.lz4") -> DataFrame:
    """path, part, data, error: the decoded blocks of each file; their concatenation in order of part is its content."""
    places = read_files(spark, path, pattern).select("path", "length").mapInArrow(_places, _PLACE)
    rows = places.repartition("path", "part").mapInArrow(_read, _PLACE + ", content binary")
    rows = rows.withColumn("d", codecs.block_decompress(F.when(~F.col("plain"), F.col("content")), F.col("most")))
    return rows.select("path", "part", F.when(F.col("plain"), F.col("content")).otherwise(F.col("d.data")).alias("data"), F.coalesce("error", "d.error").alias("error"))
