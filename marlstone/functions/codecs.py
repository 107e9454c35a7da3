"""Arrow functions on binary columns: checksums, block coding, frame decoding. One native expression feeds each."""

from __future__ import annotations

import time
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import arrow_udf

from . import _bytes


def _map(result: str, arrow: pa.DataType, cell: Callable) -> Callable[[Column], Column]:
    """An Arrow function of one binary column, null for null."""

    def run(cells: pa.Array) -> pa.Array:
        return pa.array([None if b is None else cell(b) for b in cells.cast(pa.binary()).to_pylist()], arrow)

    run.__annotations__ = {"cells": pa.Array, "return": pa.Array}
    inner = arrow_udf(run, result)
    return lambda c: inner((F.col(c) if isinstance(c, str) else c).cast("binary"))


def xxh32(col, seed: int = 0) -> Column:
    return _map("long", pa.int64(), lambda b: xxhash.xxh32_intdigest(b, seed))(col)


def block_compress(col, level: int = 1, dictionary: bytes = b"") -> Column:
    """LZ4 block. level 1 is fast, 2 to 12 search deeper, below 0 is the acceleration. Dictionaries apply below level 2."""
    return _map("binary", pa.binary(), lambda b: _bytes.encode_block(b, level, dictionary))(col)


def frame_cell(col, options) -> Column:
    """A whole frame of a cell (frame settings as in the plans), null for null."""
    o = options
    return _map("binary", pa.binary(), lambda b: _bytes.frame_of(b, o))(col)


def frame_block(col, options) -> Column:
    """A block of a frame as it is stored: size word, data (raw where packing does not help), checksum if asked for."""
    o = options
    return _map("binary", pa.binary(), lambda b: _bytes.stored(b, o))(col)


def _block(raw: bytes, size: int, dictionary: bytes) -> dict:
    data, error = _bytes.decode_block(raw, size + 1, dictionary)
    if len(data) > size:
        data, error = data[:size], error or f"Larger than {size} bytes"
    return {"data": data, "error": error}


def block_decompress(col, max_size: int | Column = 1 << 22, dictionary: bytes = b"") -> Column:
    """struct(data, error) of an LZ4 block. max_size is the known size of its content, or a bound; a longer content is an error."""
    kind = pa.struct([("data", pa.binary()), ("error", pa.string())])

    def run(cells: pa.Array, sizes: pa.Array) -> pa.Array:
        both = zip(cells.cast(pa.binary()).to_pylist(), sizes.to_pylist())
        return pa.array([None if b is None or n is None else _block(b, n, dictionary) for b, n in both], kind)

    run.__annotations__ = {"cells": pa.Array, "sizes": pa.Array, "return": pa.Array}
    size = max_size if isinstance(max_size, Column) else F.lit(max_size)
    return arrow_udf(run, "struct<data:binary,error:string>")((F.col(col) if isinstance(col, str) else col).cast("binary"), size.cast("long"))


DECODED = "struct<data:binary,n_frames:int,type:string,content_size:bigint,content_checksum_valid:boolean,error:string>"
_DECODED = pa.struct(
    [("data", pa.binary()), ("n_frames", pa.int32()), ("type", pa.string()), ("content_size", pa.int64()), ("content_checksum_valid", pa.bool_()), ("error", pa.string())]
)


def _decode(b: bytes, dictionary: bytes, first_only: bool, dict_id: int = 0) -> dict:
    frames = _bytes.walk(b)
    if first_only:
        frames = frames[:1]
    parts, valid, error = [], None, None
    for f in frames:
        if dict_id and f.get("dict_id", dict_id) != dict_id:
            data, wrong = b"", f"Dictionary id {f['dict_id']}, not {dict_id}"
        else:
            data, wrong = _bytes.decode_frame(b, f, dictionary)
        if "content_checksum" in f and not wrong:
            ok = xxhash.xxh32_intdigest(data) == f["content_checksum"]
            valid = ok if valid is None else valid and ok
        error = error or wrong
        parts.append(data)
    return {
        "data": b"".join(parts), "n_frames": len(frames), "type": frames[0]["type"], "content_size": frames[0].get("content_size") if frames[0]["type"] == "standard" else None,
        "content_checksum_valid": valid, "error": error,
    }


def frame_decompress(col, dictionary: bytes = b"", first_only: bool = False, dict_id: int = 0) -> Column:
    """Content of all frames of a cell (or of its first one) with checks; damage is told in `error`, never raised.

    With dict_id, a frame that names another dictionary is an error.
    """
    return _map(DECODED, _DECODED, lambda b: _decode(b, dictionary, first_only, dict_id))(col)


def has_linked_blocks(col) -> Column:
    """Whether a cell has a frame of several blocks that need the ones before them."""
    linked = lambda f: f["type"] == "standard" and not f.get("flg", 32) & 32 and len(f["blocks"]) > 1
    return _map("boolean", pa.bool_(), lambda b: any(map(linked, _bytes.walk(b))))(col)


TIMED = "struct<original_size:bigint,compressed_size:bigint,compress_ms:double,decompress_ms:double,intact:boolean>"
_TIMED = pa.struct([("original_size", pa.int64()), ("compressed_size", pa.int64()), ("compress_ms", pa.float64()), ("decompress_ms", pa.float64()), ("intact", pa.bool_())])


def timed_cell(col, options) -> Column:
    """Sizes and times of one cell, compressed and decompressed as a frame."""

    def cell(b: bytes) -> dict:
        began = time.perf_counter()
        frame = _bytes.frame_of(b, options)
        middle = time.perf_counter()
        back = _decode(frame, options.dictionary, True)["data"]
        done = time.perf_counter()
        return {"original_size": len(b), "compressed_size": len(frame), "compress_ms": 1e3 * (middle - began), "decompress_ms": 1e3 * (done - middle), "intact": back == b}

    return _map(TIMED, _TIMED, cell)(col)


SEQUENCES = "array<struct<literal_length:bigint,match_offset:bigint,match_length:bigint>>"
_SEQUENCES = pa.list_(pa.struct([(n, pa.int64()) for n in ("literal_length", "match_offset", "match_length")]))


def block_sequences(col) -> Column:
    """Sequences of a block, without decoding."""

    def run(cells: pa.Array) -> pa.Array:
        flat, counts = array("q"), [0]  # three numbers a sequence, so that a batch holds no object for each
        for b in cells.cast(pa.binary()):
            if b.is_valid:
                for s in _bytes.sequences_of(b.as_py()):
                    flat.extend(s)
            counts.append(len(flat) // 3)
        by = np.frombuffer(flat, np.int64).reshape(-1, 3)
        rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(by[:, i])) for i in range(3)], fields=list(_SEQUENCES.value_type))
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), rows, mask=cells.is_null()).cast(_SEQUENCES)

    run.__annotations__ = {"cells": pa.Array, "return": pa.Array}
    return arrow_udf(run, SEQUENCES)((F.col(col) if isinstance(col, str) else col).cast("binary"))


BLOCK = "struct<offset:bigint,header_size:int,compressed_size:bigint,is_uncompressed:boolean,block_checksum:bigint,block_checksum_valid:boolean>"
WALKED = (
    "array<struct<type:string,offset:bigint,total_bytes:bigint,magic:bigint,magic_variant:int,flg:int,bd:int,content_size:bigint,dict_id:bigint,"
    f"header_checksum:int,header_checksum_valid:boolean,content_checksum:bigint,error:string,blocks:array<{BLOCK}>>>"
)
_BLOCK = pa.struct(
    [("offset", pa.int64()), ("header_size", pa.int32()), ("compressed_size", pa.int64()), ("is_uncompressed", pa.bool_()), ("block_checksum", pa.int64()), ("block_checksum_valid", pa.bool_())]
)
_WALKED = pa.list_(
    pa.struct(
        [("type", pa.string()), ("offset", pa.int64()), ("total_bytes", pa.int64()), ("magic", pa.int64()), ("magic_variant", pa.int32()), ("flg", pa.int32()), ("bd", pa.int32()),
         ("content_size", pa.int64()), ("dict_id", pa.int64()), ("header_checksum", pa.int32()), ("header_checksum_valid", pa.bool_()), ("content_checksum", pa.int64()),
         ("error", pa.string()), ("blocks", pa.list_(_BLOCK))]
    )
)


def walk_frames(col) -> Column:
    """Frames of a cell with header fields and blocks, nothing decoded."""
    return _map(WALKED, _WALKED, lambda b: [{"blocks": []} | f for f in _bytes.walk(b)])(col)


def generated(col, seed: int = 12345) -> Column:
    """Buffers of the benchmark generator, of as many bytes as col says."""

    def run(sizes: pa.Array) -> pa.Array:
        return pa.array([None if n is None else _bytes.generated(n, seed) for n in sizes.to_pylist()], pa.binary())

    run.__annotations__ = {"sizes": pa.Array, "return": pa.Array}
    return arrow_udf(run, "binary")((F.col(col) if isinstance(col, str) else col).cast("long"))


def tar_header(name: Column, size: Column, mtime: Column, kind: Column) -> Column:
    """Header of a tar entry, with a pax record before it where the name does not fit."""

    def run(names: pa.Array, sizes: pa.Array, times: pa.Array, kinds: pa.Array) -> pa.Array:
        cells = zip(*(a.to_pylist() for a in (names, sizes, times, kinds)))
        return pa.array([None if None in c else _bytes.tar_header(*c) for c in cells], pa.binary())

    run.__annotations__ = {n: pa.Array for n in ("names", "sizes", "times", "kinds", "return")}
    return arrow_udf(run, "binary")(name, size.cast("long"), mtime.cast("long"), kind)


def tar_archive(files: Column, mtime: int) -> Column:
    """The archive of an ordered array of files (structs with name and data)."""

    def run(cells: pa.Array) -> pa.Array:
        return pa.array([_bytes.tar_archive(c.as_py(), mtime) if c.is_valid else None for c in cells], pa.binary())

    run.__annotations__ = {"cells": pa.Array, "return": pa.Array}
    return arrow_udf(run, "binary")(files)


TAR = "array<struct<name:string,type:string,size:bigint,mtime:bigint,checksum_valid:boolean,data:binary>>"
_TAR = pa.list_(pa.struct([("name", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("mtime", pa.int64()), ("checksum_valid", pa.bool_()), ("data", pa.binary())]))


def tar_entries(col) -> Column:
    return _map(TAR, _TAR, _bytes.tar_entries_of)(col)
