"""Block-parallel compression and decompression plans, in built-in operators around one block function.

split -> compress each block -> store raw what does not shrink -> assemble in block order. Cells of one block (most, as block
sizes start at 64 KiB) become frames where they are read, in one Arrow function and without a shuffle; larger ones are exploded to
blocks, spread over all tasks, and assembled by one ordered aggregation. Both ways give the same bytes.

Rows are told apart by a number given to each row where it is read, never by the caller's columns: null and repeated keys are rows
like any other. All other columns of the input come back as they were.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codecs, columns as C
from ..functions._bytes import BLOCK_SIZES, LEGACY_BLOCK


@dataclass(frozen=True)
class FrameOptions:
    """Frame settings. level: 1 fast, 2 to 12 deeper, 0 as 1, below 0 acceleration. Blocks are always coded independently.

    favor_decode_speed lets levels of 10 and above search as level 9 does, which gives fewer and longer matches to copy.
    """

    level: int = 1
    block_size_id: int = 4
    independent: bool = True
    block_checksum: bool = False
    content_size: bool = True
    content_checksum: bool = True
    dict_id: int = 0
    dictionary: bytes = b""
    favor_decode_speed: bool = False

    @property
    def block_size(self) -> int:
        return BLOCK_SIZES.get(self.block_size_id, 1 << 16)

    @property
    def search_level(self) -> int:
        return min(self.level, 9) if self.favor_decode_speed else self.level

    @property
    def flags(self) -> dict[str, bool]:
        return {n: getattr(self, n) for n in ("independent", "block_checksum", "content_size", "content_checksum")}

    def header(self, size: Column) -> Column:
        return C.frame_header(size, self.block_size_id, self.dict_id, **self.flags)


def split_blocks(df: DataFrame, content: str, size: int) -> DataFrame:
    """df without content, exploded to block_index (int) and raw; a cell without bytes has one row with nulls."""
    n = F.octet_length(content)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda s: s < n)
    pieces = F.transform(starts, lambda s: F.substring(F.col(content), s + F.lit(1), F.lit(size)))
    keep = [c for c in df.columns if c != content]
    return df.select(*keep, F.posexplode_outer(pieces).alias("block_index", "raw"))


def _numbered(df: DataFrame, content: str) -> tuple[DataFrame, list[str]]:
    """(rid, row, content) of df and the names of the columns in row."""
    others = [c for c in df.columns if c != content]
    row = F.struct(*[df[c] for c in others]) if others else F.struct(F.lit(0).alias("_"))
    return df.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"), df[content].cast("binary").alias("content")), others


def _named(rows: DataFrame, others: list[str], *columns) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in others], *columns)


def _apart(df: DataFrame, column: str) -> DataFrame:
    """df, with a test that no row fails after an aggregation: Spark cannot run a Python function it has merged into an aggregation's result."""
    return df.filter(F.col(column).isNotNull())


_IN_ORDER = "listagg({}) WITHIN GROUP (ORDER BY block_index)"


def compress_frames(df: DataFrame, content: str = "content", options: FrameOptions = FrameOptions(), split_over: int | None = None) -> DataFrame:
    """df with one LZ4 frame (`frame`) and `original_size` for each cell instead of content.

    Cells of more than `split_over` bytes (one block by default) are compressed block by block over all tasks. A null
    content gives a null frame.
    """
    o = options
    split_over = o.block_size if split_over is None else min(split_over, o.block_size)
    rows, others = _numbered(df, content)
    n = F.octet_length("content")
    small = rows.filter(n.isNull() | (n <= split_over))
    small = _named(small, others, codecs.frame_cell("content", o).alias("frame"), n.cast("long").alias("original_size"))
    large = rows.filter(n > split_over).withColumns({"n": n.cast("long"), "head": o.header(n.cast("long")), "sum": codecs.xxh32("content") if o.content_checksum else F.lit(0)})
    blocks = split_blocks(large, "content", o.block_size).repartition(F.col("rid"), F.col("block_index"))
    blocks = blocks.select("rid", "row", "n", "head", "sum", "block_index", codecs.frame_block("raw", o).alias("block"))
    made = blocks.groupBy("rid").agg(F.expr(_IN_ORDER.format("block")).alias("body"), *(F.first(c).alias(c) for c in ("row", "n", "head", "sum")))
    made = _apart(made, "body")
    parts = [F.col("head"), F.col("body"), F.unhex(F.lit("00000000"))] + ([C.le_bytes("sum")] if o.content_checksum else [])
    return small.unionByName(_named(made, others, F.concat(*parts).alias("frame"), F.col("n").alias("original_size")))


def compress_legacy(df: DataFrame, content: str = "content") -> DataFrame:
    """df with a legacy frame (8 MiB blocks, always packed, no checksums) instead of content; null for null."""
    rows, others = _numbered(df, content)
    rows = rows.withColumn("n", F.octet_length("content"))
    magic, pack = F.unhex(F.lit("02214C18")), lambda c: F.concat(C.le_bytes(F.octet_length(c)), c)
    small = rows.filter(F.col("n").isNull() | (F.col("n") <= LEGACY_BLOCK)).withColumn("packed", codecs.block_compress("content"))
    small = _named(small, others, F.when(F.col("n") == 0, magic).otherwise(F.concat(magic, pack(F.col("packed")))).alias("frame"))
    blocks = split_blocks(rows.filter(F.col("n") > LEGACY_BLOCK), "content", LEGACY_BLOCK).repartition(F.col("rid"), F.col("block_index"))
    blocks = blocks.withColumn("packed", codecs.block_compress("raw")).withColumn("block", pack(F.col("packed")))
    made = blocks.groupBy("rid").agg(F.expr(_IN_ORDER.format("block")).alias("body"), F.first("row").alias("row"))
    made = _apart(made, "body")
    return small.unionByName(_named(made, others, F.concat(magic, F.col("body")).alias("frame")))


def decompress_blocks(df: DataFrame, frame: str = "frame", dictionary: bytes = b"") -> DataFrame:
    """df with data, n_blocks, content_checksum_valid and error instead of frame, decoded block by block over all tasks.

    All frames of a cell count, in order. Cells with a frame of several linked blocks are decoded whole where they are read, as each block
    needs the one before. Damage is told in error; checksums of frames that end early are not compared.
    """
    rows, others = _numbered(df, frame)
    linked = codecs.has_linked_blocks("content")
    whole = rows.filter(F.col("content").isNull() | linked).withColumns({"d": codecs.frame_decompress("content", dictionary), "frames": codecs.walk_frames("content")})
    n_blocks = F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + F.size(f["blocks"]))
    whole = _named(whole, others, "d.data", n_blocks.alias("n_blocks"), "d.content_checksum_valid", "d.error")

    at = rows.filter(F.col("content").isNotNull() & ~linked).select("rid", "row", "content", F.posexplode(codecs.walk_frames("content")).alias("frame_index", "f"))
    blocks = at.select("rid", "row", "content", "frame_index", "f", F.posexplode_outer("f.blocks").alias("block_index", "b"))
    raw = F.substring(F.col("content"), (F.col("b.offset") + 5).cast("int"), F.col("b.compressed_size").cast("int"))
    most = F.when(F.col("f.type") == "legacy", F.lit(LEGACY_BLOCK).cast("long")).otherwise(C.block_max_size(F.shiftright("f.bd", 4).bitwiseAND(F.lit(7))))
    blocks = blocks.select(
        "rid", "row", "frame_index", "block_index", raw.alias("raw"), F.col("b.is_uncompressed").alias("plain"), most.alias("most"),
        F.col("f.error").alias("broken"), F.col("f.content_checksum").alias("sum"),
    ).repartition(F.col("rid"), F.col("frame_index"), F.col("block_index"))
    blocks = blocks.withColumn("d", codecs.block_decompress(F.when(~F.col("plain"), F.col("raw")), F.col("most"), dictionary))
    blocks = blocks.withColumns({"block": F.when(F.col("plain"), F.col("raw")).otherwise(F.col("d.data")), "wrong": F.col("d.error")})
    per = blocks.groupBy("rid", "frame_index").agg(
        F.coalesce(F.expr(_IN_ORDER.format("block")), F.unhex(F.lit(""))).alias("data"), F.count("block_index").alias("n"),
        F.max(F.coalesce("broken", "wrong")).alias("error"), F.first("sum").alias("sum"), F.first("row").alias("row"),
    )
    valid = F.when(F.col("sum").isNotNull() & F.col("error").isNull(), codecs.xxh32("data") == F.col("sum"))
    per = per.withColumn("valid", valid).groupBy("rid").agg(
        F.expr("listagg(data) WITHIN GROUP (ORDER BY frame_index)").alias("data"), F.sum("n").alias("n_blocks"), F.min("valid").alias("content_checksum_valid"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("frame_index"))).alias("error"), F.first("row").alias("row"),
    )
    return whole.unionByName(_named(_apart(per, "data"), others, "data", "n_blocks", "content_checksum_valid", "error"))
