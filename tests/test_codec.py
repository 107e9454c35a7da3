import random

import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marlstone.functions import _bytes as B, codecs, columns as C
from marlstone.plans.compress import FrameOptions, compress_frames, compress_legacy, decompress_blocks

TEXTS = [b"", b"a", b"Hello, World!", b"abcdefgh" * 4, b"x" * 10_000, bytes(range(256)) * 9, ("Ünïcode prose, again and again. " * 40).encode()]


def noise(n: int, seed: int = 42) -> bytes:
    return random.Random(seed).randbytes(n)


@pytest.mark.parametrize("level", [1, 2, 3, 9, 12, 0, -1, -5, -20])
@pytest.mark.parametrize("data", [*TEXTS, noise(65_537)], ids=len)
def test_blocks_round_trip_and_decode_elsewhere(level, data):
    packed = B.encode_block(data, level)
    assert B.decode_block(packed, len(data) + 1) == (data, None)
    if data:
        assert pa.Codec("lz4_raw").decompress(packed, len(data), asbytes=True) == data
    assert len(packed) <= B.bound(len(data))


@given(st.binary(max_size=400), st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_dictionary_round_trip(data, prefix):
    assert B.decode_block(B.encode_block(data, 1, prefix), 1 << 20, prefix) == (data, None)


def test_dictionary_saves_bytes():
    record = b'{"user_id": 17, "name": "Ada", "role": "admin", "active": true}'
    assert len(B.encode_block(record, 1, record * 3)) < len(B.encode_block(record, 1)) / 2


def test_block_damage():
    assert B.decode_block(b"\x14a\x00\x00", 100)[1] == "Invalid match offset: 0"
    assert B.decode_block(b"\x14a\x09\x00\x50bcdef", 100)[1] == "Match before start of data"
    assert B.decode_block(b"\x50abc", 100) == (b"abc", None)
    assert B.decode_block(B.encode_block(b"q" * 100), 10) == (b"q" * 10, None)


def test_sequences_cover_the_text():
    data = b"abcabcabc" * 50 + noise(40)
    assert sum(lit + match for lit, _, match in B.sequences_of(B.encode_block(data))) == len(data)


def framed(spark, data: bytes, options=FrameOptions(), **more) -> bytes:
    df = spark.createDataFrame([(1, data)], "k int, content binary")
    return bytes(compress_frames(df, "content", options, **more).first().frame)


def decoded(spark, frame: bytes, dictionary: bytes = b"", first_only: bool = False):
    df = spark.createDataFrame([(frame,)], "f binary")
    return df.select(codecs.frame_decompress("f", dictionary, first_only).alias("d")).first().d


@pytest.mark.parametrize("options", [FrameOptions(), FrameOptions(9, 7, False, True, False, False), FrameOptions(block_size_id=5, block_checksum=True, dict_id=9)])
def test_frames_decode_elsewhere(spark, options):
    for data in (b"", b"text " * 30_000, noise(70_000), b"z" * 65_536):
        frame = framed(spark, data, options)
        assert decoded(spark, frame).data == data
        if not options.dict_id:
            assert pa.CompressedInputStream(pa.BufferReader(frame), "lz4").read() == data


def test_frames_from_elsewhere(spark):
    data = b"linked blocks share their history " * 9_000
    got = decoded(spark, pa.Codec("lz4").compress(data, asbytes=True))
    assert (got.data, got.error) == (data, None)


def test_linked_blocks_use_their_history(spark):
    a, b = noise(3000, 1), noise(3000, 1)
    blocks = [B.encode_block(a), B.encode_block(b, 1, a)]
    assert len(blocks[1]) < 100
    head = bytes([0x40, 0x40])
    frame = b"\x04\x22\x4d\x18" + head + bytes([xxhash.xxh32_intdigest(head) >> 8 & 255])
    raw = (len(a) | 1 << 31).to_bytes(4, "little") + a
    frame += raw + len(blocks[1]).to_bytes(4, "little") + blocks[1] + bytes(4)
    assert decoded(spark, frame).data == a + b


def test_split_and_whole_cells_give_the_same_bytes(spark):
    data = b"spread over all tasks " * 20_000
    assert framed(spark, data) == framed(spark, data, split_over=10)
    assert framed(spark, b"short", split_over=1) == framed(spark, b"short")
    df = spark.createDataFrame([(1, framed(spark, data))], "k int, frame binary")
    got = decompress_blocks(df).first()
    assert got.data == data and got.n_blocks == -(-len(data) // 65_536) and got.error is None


def test_null_cells_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, b"x")], "k int, content binary")
    got = {r.k: r.frame for r in compress_frames(df).collect()}
    assert got[1] is None and got[2] is not None
    assert compress_frames(df.filter("k > 5")).count() == 0


def test_damage_is_told_not_raised(spark):
    frame = framed(spark, b"some text worth a checksum " * 50)
    assert decoded(spark, b"").error == "Input too short"
    assert decoded(spark, b"abcdefgh").error.startswith("Invalid magic number")
    assert decoded(spark, frame[:5]).error == "Truncated frame descriptor"
    assert decoded(spark, frame[:9]).error == "Truncated content size field"
    assert decoded(spark, frame[:14]).error == "Truncated header checksum"
    assert decoded(spark, frame[:25]).error == "Truncated block data"
    assert decoded(spark, frame[:-2]).error == "Truncated content checksum"
    flipped = frame[:-1] + bytes([frame[-1] ^ 1])
    assert decoded(spark, flipped).content_checksum_valid is False
    assert decoded(spark, frame).content_checksum_valid is True


def test_streams_of_frames(spark):
    a, b = framed(spark, b"one"), framed(spark, b"two", FrameOptions(content_checksum=False))
    skip = b"\x53\x2a\x4d\x18\x02\x00\x00\x00hi"
    got = decoded(spark, a + skip + b)
    assert (got.data, got.n_frames, got.error) == (b"onetwo", 3, None)
    assert decoded(spark, skip + a, first_only=True).data == b""
    assert decoded(spark, a + b"\0\1\2\3").error.startswith("Invalid magic number")


def test_legacy(spark):
    df = spark.createDataFrame([(1, b"old format " * 100), (2, b"")], "k int, content binary")
    for r in compress_legacy(df).select("k", codecs.frame_decompress("frame").alias("d")).collect():
        assert (r.d.data, r.d.type) == ({1: b"old format " * 100, 2: b""}[r.k], "legacy")


@pytest.mark.parametrize("data, want", [(b"", 0x02CC5D05), (b"Hello, World!", 0x4007DE50), (bytes([0x64, 0x40]), 0x95C0A77C)])
def test_xxh32(spark, data, want):
    r = spark.createDataFrame([(data,)], "b binary").select(C.xxh32_short("b").alias("native"), codecs.xxh32("b").alias("arrow")).first()
    assert r.native == r.arrow == want


def test_little_endian_fields(spark):
    r = spark.range(1).select(F.hex(C.le_bytes(F.lit(0x1234), 4)).alias("w"), C.read_le(C.le_bytes(F.lit(2**40 + 7), 8), 0, 8).alias("v")).first()
    assert (r.w, r.v) == ("34120000", 2**40 + 7)


def test_variants_are_checked():
    with pytest.raises(ValueError):
        C.skippable_frame(F.lit("x"), 16)


def test_rows_need_no_key(spark):
    """Null and repeated keys on both sides of the block size, and columns whose names the plans use themselves."""
    cells = [b"small", b"L" * 200_000 + noise(70_000), b"other " * 40_000, b"", None]
    rows = [(k, c, 1, 2, "r") for k in (None, 7) for c in cells]
    df = spark.createDataFrame(rows, "k int, content binary, rid int, block_index int, row string")
    want = sorted((str(k), c or b"", c is None) for k, c, *_ in rows)
    for made in (compress_frames(df), compress_frames(df, split_over=3), compress_legacy(df)):
        assert made.columns[:4] == ["k", "rid", "block_index", "row"]
        got = made.select("k", "row", "frame", codecs.frame_decompress("frame").alias("d")).collect()
        assert sorted((str(r.k), bytes(r.d.data) if r.d else b"", r.frame is None) for r in got) == want
        assert all(r.d.error is None and r.d.content_checksum_valid is not False for r in got if r.d)
        back = decompress_blocks(made.drop("original_size")).collect()
        assert sorted((str(r.k), bytes(r.data or b""), r.data is None) for r in back) == want
        assert all(r.error is None and r.content_checksum_valid is not False for r in back)


def test_blocks_of_all_frames_are_decoded(spark):
    a, b = framed(spark, b"one " * 40_000, FrameOptions(block_checksum=True)), framed(spark, b"two")
    linked = pa.Codec("lz4").compress(b"linked blocks share their history " * 9_000, asbytes=True)
    skip = b"\x53\x2a\x4d\x18\x02\x00\x00\x00hi"
    bad = a[:-1] + bytes([a[-1] ^ 1])
    cells = {"all": a + skip + b, "linked": linked, "skip": skip, "bad": bad, "cut": a[:-15], "odd": b"nothing"}
    df = spark.createDataFrame([(k, v) for k, v in cells.items()], "k string, frame binary")
    got = {r.k: r for r in decompress_blocks(df).collect()}
    assert (got["all"].data, got["all"].n_blocks, got["all"].content_checksum_valid) == (b"one " * 40_000 + b"two", 4, True)
    assert got["linked"].data == b"linked blocks share their history " * 9_000 and got["skip"].data == b"" and got["bad"].content_checksum_valid is False
    assert got["cut"].error == "Truncated block data" and got["odd"].error.startswith("Invalid magic")


def test_dictionary_ids_are_matched(spark):
    frame = framed(spark, b"text " * 9, FrameOptions(dict_id=5))
    df = spark.createDataFrame([(frame,)], "f binary")
    got = [df.select(codecs.frame_decompress("f", dict_id=i).alias("d")).first().d.error for i in (0, 5, 6)]
    assert got == [None, None, "Dictionary id 5, not 6"]


def test_generator():
    x, want = 12345, []
    for _ in range(5000):
        x = int(float(x) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        want.append(x % 256)
    got = B.generated(5000)
    assert list(got[4096:]) == want[4096:] and got[:12] == b"Hello World!" and len(B.generated(0)) == 0
