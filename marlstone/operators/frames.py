"""The structure of LZ4 data as tables: frames, header fields, flag bits, blocks, sequences, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import codecs, columns as C


def _bit(c, n: int):
    return F.shiftright(c, n).bitwiseAND(F.lit(1))


def frames(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each frame of each cell (concatenated frames are split). Unknown magic ends a cell with one unknown frame."""
    rows = df.select(key, F.posexplode(codecs.walk_frames(content)).alias("frame_index", "f")).select(key, "frame_index", "f.*")
    standard = F.col("type") == "standard"
    size_id = F.when(standard, F.shiftright("bd", 4).bitwiseAND(F.lit(7)))
    flag = lambda n: _bit(F.col("flg"), n) == 1
    return rows.select(
        key, "frame_index", "type", "offset", "total_bytes", "magic", "magic_variant",
        F.shiftright("flg", 6).bitwiseAND(F.lit(3)).alias("version"),
        flag(5).alias("block_independent"), flag(4).alias("block_checksum"), flag(3).alias("content_size_flag"),
        flag(2).alias("content_checksum_flag"), flag(0).alias("has_dict_id"),
        size_id.alias("block_size_id"), F.when(standard, C.block_max_size(size_id)).alias("block_max_size"),
        "content_size", "dict_id", "header_checksum", "header_checksum_valid", "content_checksum", "flg", "bd", "blocks", "error",
    )


def frame_fields(parsed: DataFrame, key: str) -> DataFrame:
    """Header fields of standard frames, in file order, with place, size, value, hex and description; from frames()."""
    f = parsed.filter("type = 'standard' and flg is not null")
    shift = F.when(F.col("content_size_flag"), 8).otherwise(0)
    shift2 = shift + F.when(F.col("has_dict_id"), 4).otherwise(0)
    le_hex = lambda v, n: C.hex_spaced(C.le_bytes(v, n))
    field = lambda name, at, size, value, note: F.struct(
        F.lit(name).alias("name"), (F.col("offset") + at).alias("offset"), F.lit(size).alias("size"),
        value.cast("long").alias("value"), le_hex(value, size).alias("hex"), note.alias("description"),
    )
    fields = F.array(
        field("magic", 0, 4, F.col("magic"), F.lit("LZ4 frame")),
        field("flg", 4, 1, F.col("flg"), F.concat(F.lit("version "), F.col("version").cast("string"))),
        field("bd", 5, 1, F.col("bd"), F.concat(F.lit("block maximum "), F.coalesce(C.block_size_label("block_size_id"), F.lit("unknown")))),
        F.when(F.col("content_size_flag"), field("content_size", 6, 8, F.col("content_size"), C.human_size("content_size"))),
        F.when(F.col("has_dict_id"), field("dict_id", 6 + shift, 4, F.col("dict_id"), F.lit("dictionary id"))),
        field("header_checksum", 6 + shift2, 1, F.col("header_checksum"), F.when(F.col("header_checksum_valid"), "VALID").otherwise("INVALID")),
    )
    return f.select(key, "frame_index", F.posexplode(F.filter(fields, lambda x: x.isNotNull())).alias("field_index", "x")).select(key, "frame_index", "field_index", "x.*")


def flag_bits(parsed: DataFrame, key: str) -> DataFrame:
    """Seven rows of FLG bits and three of BD bits of each standard frame; from frames()."""
    f = parsed.filter("type = 'standard' and flg is not null")
    bit = lambda byte, name, bits, value: F.struct(F.lit(byte).alias("byte"), F.lit(name).alias("name"), F.lit(bits).alias("bits"), value.cast("int").alias("value"))
    flg, bd = F.col("flg"), F.col("bd")
    bits = F.array(
        bit("FLG", "version", "7-6", F.shiftright(flg, 6)),
        bit("FLG", "block_independent", "5", _bit(flg, 5)),
        bit("FLG", "block_checksum", "4", _bit(flg, 4)),
        bit("FLG", "content_size", "3", _bit(flg, 3)),
        bit("FLG", "content_checksum", "2", _bit(flg, 2)),
        bit("FLG", "reserved", "1", _bit(flg, 1)),
        bit("FLG", "dict_id", "0", _bit(flg, 0)),
        bit("BD", "reserved", "7", _bit(bd, 7)),
        bit("BD", "block_max_size", "6-4", F.shiftright(bd, 4).bitwiseAND(F.lit(7))),
        bit("BD", "reserved_low", "3-0", bd.bitwiseAND(F.lit(15))),
    )
    return f.select(key, "frame_index", F.inline(bits))


def blocks(parsed: DataFrame, key: str) -> DataFrame:
    """One row for each block, nothing decoded (original_size is known for raw blocks only); from frames()."""
    rows = parsed.select(key, "frame_index", F.posexplode("blocks").alias("block_index", "b")).select(key, "frame_index", "block_index", "b.*")
    return rows.withColumn("original_size", F.when(F.col("is_uncompressed"), F.col("compressed_size")))


def block_payloads(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, frame_index, block_index, is_uncompressed, payload."""
    parsed = df.select(key, F.col(content).cast("binary").alias("content")).withColumn("w", codecs.walk_frames("content"))
    rows = parsed.select(key, "content", F.posexplode("w").alias("frame_index", "f")).select(key, "content", "frame_index", F.posexplode("f.blocks").alias("block_index", "b"))
    own = F.substring(F.col("content"), (F.col("b.offset") + F.col("b.header_size") + 1).cast("int"), F.col("b.compressed_size").cast("int"))
    return rows.select(key, "frame_index", "block_index", F.col("b.is_uncompressed").alias("is_uncompressed"), own.alias("payload"))


def sized_blocks(df: DataFrame, key: str, content: str) -> DataFrame:
    """Blocks with their decoded sizes."""
    rows = block_payloads(df, key, content).withColumn("d", codecs.block_decompress("payload", 8 << 20))
    size = F.when(F.col("is_uncompressed"), F.octet_length("payload")).otherwise(F.octet_length("d.data")).cast("long")
    return rows.select(key, "frame_index", "block_index", "is_uncompressed", F.octet_length("payload").cast("long").alias("compressed_size"), size.alias("original_size"))


def sequences(df: DataFrame, key: str, content: str) -> DataFrame:
    """One row for each sequence of each packed block."""
    rows = block_payloads(df, key, content).filter(~F.col("is_uncompressed"))
    return rows.select(key, "frame_index", "block_index", F.posexplode(codecs.block_sequences("payload")).alias("seq_index", "s")).select(
        key, "frame_index", "block_index", "seq_index", "s.*"
    )


def statistics(parsed: DataFrame, key: str) -> DataFrame:
    """Frames, blocks, sizes and format (the last known type) of each cell; from frames()."""
    return parsed.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.sum(F.size("blocks")).cast("long").alias("n_blocks"),
        F.sum("total_bytes").alias("total_size"),
        F.sum(F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["compressed_size"])).alias("compressed_size"),
        F.sum("content_size").alias("content_size"),
        F.coalesce(F.max_by("type", F.when(F.col("type") != "unknown", F.col("frame_index"))), F.lit("unknown")).alias("format"),
    )


def concat_frames(df: DataFrame, group: str, order: str, frame: str) -> DataFrame:
    """group, frames: the frames of each group one after the other."""
    return df.groupBy(group).agg(F.expr(f"listagg(`{frame}`) WITHIN GROUP (ORDER BY `{order}`)").alias("frames"))


def hex_dump(df: DataFrame, key: str, content: str, limit: int = 256) -> DataFrame:
    """key, offset, hex, ascii: rows of 16 of the first `limit` bytes."""
    data = df.select(key, F.substring(F.col(content).cast("binary"), 1, limit).alias("d")).filter(F.octet_length("d") > 0)
    rows = data.select(key, "d", F.explode(F.sequence(F.lit(0), F.octet_length("d") - 1, F.lit(16))).alias("offset"))
    own = F.substring(F.col("d"), F.col("offset") + 1, F.lit(16))
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(own)), lambda i: C.byte_at(own, i - 1))
    text = F.array_join(F.transform(codes, lambda c: F.when(c.between(32, 126), F.char(c)).otherwise(".")), "")
    return rows.select(key, "offset", C.hex_spaced(own).alias("hex"), text.alias("ascii"))


def integrity(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, status (OK or FAIL), error, sizes and checksum verdict; every cell is decoded whole, none raises."""
    rows = df.select(key, F.octet_length(content).cast("long").alias("compressed_size"), codecs.frame_decompress(content).alias("d"))
    sums = F.coalesce("d.content_checksum_valid", F.lit(True))
    error = F.coalesce(F.col("d.error"), F.when(~sums, "Content checksum mismatch"))
    return rows.select(
        key, F.when(error.isNull(), "OK").otherwise("FAIL").alias("status"), error.alias("error"), "compressed_size",
        F.octet_length("d.data").cast("long").alias("original_size"), F.col("d.content_checksum_valid").alias("content_checksum_valid"),
    )
