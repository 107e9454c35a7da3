"""Native column expressions: little-endian fields, short checksums, frame headers, sizes, hex and tar fields.

Bytes go through hexadecimal text where they must be reversed, as `reverse` would turn binary into text. 32-bit products are split
in halves, as products beyond 63 bits are errors in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ._bytes import BLOCK_SIZES

P1, P2, P3, P4, P5 = 2654435761, 2246822519, 3266489917, 668265263, 374761393
M32 = 0xFFFFFFFF
#: Label of each block size id, searches and target length of each high-compression level.
BLOCK_LABELS = {0: "Default(64KB)", 4: "64 KB", 5: "256 KB", 6: "1 MB", 7: "4 MB"}
LEVELS = {
    2: (2, 16), 3: (4, 16), 4: (8, 16), 5: (16, 16), 6: (32, 16), 7: (64, 16), 8: (128, 16), 9: (256, 16), 10: (96, 64), 11: (512, 128), 12: (16384, 4096),
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _pairs_swapped(h: Column, n: int) -> Column:
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])


def le_bytes(value, n: int = 4) -> Column:
    """value as n little-endian bytes."""
    return F.unhex(_pairs_swapped(F.lpad(F.hex(_c(value).cast("long")), 2 * n, "0"), n))


def read_le(data, at: int | Column = 0, n: int = 4) -> Column:
    """Unsigned little-endian integer of n bytes (up to 7, or 8 below 2^63) at a 0-based offset."""
    own = F.substring(_c(data), _c(at) + 1, F.lit(n)) if isinstance(at, Column) else F.substring(_c(data), at + 1, n)
    return F.conv(_pairs_swapped(F.hex(own), n), 16, 10).cast("long")


def byte_at(data, at: int | Column) -> Column:
    return read_le(data, at, 1)


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once: the expressions below use their argument several times."""
    return F.element_at(F.transform(F.array(x), f), 1)


def mul32(a: Column, b: int) -> Column:
    """Product modulo 2^32 of a 32-bit column and a constant. a should be a column or a lambda variable."""
    low = (a.bitwiseAND(F.lit(0xFFFF)) * F.lit(b)).bitwiseAND(F.lit(M32))
    high = F.shiftleft((F.shiftright(a, 16) * F.lit(b)).bitwiseAND(F.lit(0xFFFF)), 16)
    return (low + high).bitwiseAND(F.lit(M32))


def rotl32(a: Column, n: int) -> Column:
    return F.shiftleft(a, n).bitwiseAND(F.lit(M32)).bitwiseOR(F.shiftrightunsigned(a, 32 - n))


def xxh32_short(data, seed: int = 0) -> Column:
    """XXH32 of binary of fewer than 16 bytes (every frame descriptor is), in expressions only."""
    data = _c(data)
    n = F.octet_length(data).cast("long")
    start = F.lit((seed + P5) & M32).cast("long") + n

    def rounds(acc: Column, value: Column, factor: int, turn: int, last: int) -> Column:
        mixed = let(value, lambda v: acc + mul32(v, factor))
        turned = let(mixed.bitwiseAND(F.lit(M32)), lambda v: rotl32(v, turn))
        return let(turned, lambda v: mul32(v, last))

    def shifted(h: Column, by: int) -> Column:
        return let(h, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, by)))

    places = F.sequence(F.lit(0), F.lit(14))
    size = n.cast("int")
    words = F.filter(places, lambda i: (i % 4 == 0) & (i + 4 <= size))
    rest = F.filter(places, lambda i: (i < size) & (i >= size - size % 4))
    h = F.aggregate(words, start, lambda acc, i: rounds(acc, read_le(data, i, 4), P3, 17, P4))
    h = F.aggregate(rest, h, lambda acc, i: rounds(acc, byte_at(data, i), P5, 11, P1))
    h = let(shifted(h, 15), lambda v: mul32(v, P2))
    h = let(shifted(h, 13), lambda v: mul32(v, P3))
    return shifted(h, 16)


def compress_bound(n) -> Column:
    n = _c(n).cast("long")
    return F.when(n > 0x7E000000, F.lit(0).cast("long")).otherwise(n + F.floor(n / 255) + 16)


def flg_byte(independent=True, block_checksum=False, content_size=True, content_checksum=True, dictionary=False) -> int:
    return 64 | independent << 5 | block_checksum << 4 | content_size << 3 | content_checksum << 2 | int(dictionary)


def frame_header(size, block_size_id: int = 4, dict_id: int = 0, check=xxh32_short, **flags) -> Column:
    """Magic, descriptor and header checksum of a frame whose content has `size` bytes; check hashes the descriptor."""
    flg = flg_byte(dictionary=bool(dict_id), **flags)
    parts = [F.unhex(F.lit(f"{flg:02X}{block_size_id << 4:02X}"))]
    if flg & 8:
        parts.append(le_bytes(size, 8))
    if dict_id:
        parts.append(le_bytes(dict_id, 4))
    descriptor = F.concat(*parts)
    return F.concat(F.unhex(F.lit("04224D18")), descriptor, le_bytes(F.shiftright(check(descriptor), 8).bitwiseAND(F.lit(255)), 1))


def skippable_frame(payload, variant: int = 0) -> Column:
    """A skippable frame around binary or text (as UTF-8)."""
    if not 0 <= variant <= 15:
        raise ValueError("a skippable frame has a variant of 0 to 15")
    payload = _c(payload).cast("binary")
    return F.concat(F.unhex(F.lit(f"{0x50 + variant:02X}2A4D18")), le_bytes(F.octet_length(payload), 4), payload)


def frame_type(data) -> Column:
    """standard, legacy, skippable or unknown, by the magic number."""
    magic = F.when(F.octet_length(_c(data)) >= 4, read_le(data, 0, 4))
    return (
        F.when(magic == 0x184D2204, "standard")
        .when(magic == 0x184C2102, "legacy")
        .when(magic.between(0x184D2A50, 0x184D2A5F), "skippable")
        .otherwise("unknown")
    )


def literal_block(data) -> Column:
    """The block of up to 12 bytes, which is one run of literals."""
    return F.concat(le_bytes(F.octet_length(_c(data)) * 16, 1), _c(data).cast("binary"))


def hex_spaced(data) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.hex(_c(data))), "(..)", "$1 "))


def hex_preview(data, limit: int = 128) -> Column:
    own = hex_spaced(F.substring(_c(data), 1, limit))
    return F.when(F.octet_length(_c(data)) > limit, F.concat(own, F.lit("..."))).otherwise(own)


def _tenths(n: Column, unit: int) -> Column:
    t = F.floor((n * 20 + unit) / (2 * unit))
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"))


def human_size(n, spaced: bool = False) -> Column:
    """n, 1.0K, 1.0M, 1.0G; spaced: 0 B, n B, 1.0 KB and so on. Ties round up."""
    n = _c(n).cast("long")
    tail = "B" if spaced else ""
    gap = " " if spaced else ""
    small = F.concat(n.cast("string"), F.lit(" B" if spaced else ""))
    out = F.when(n < 1024, small).when(n < 1 << 20, F.concat(_tenths(n, 1 << 10), F.lit(f"{gap}K{tail}")))
    return out.when(n < 1 << 30, F.concat(_tenths(n, 1 << 20), F.lit(f"{gap}M{tail}"))).otherwise(F.concat(_tenths(n, 1 << 30), F.lit(f"{gap}G{tail}")))


def output_name(name, compress: bool) -> Column:
    """x -> x.lz4; x.lz4 -> x; anything else -> x.dec."""
    name = _c(name)
    if compress:
        return F.concat(name, F.lit(".lz4"))
    return F.when(name.endswith(".lz4"), F.substring(name, F.lit(1), F.char_length(name) - 4)).otherwise(F.concat(name, F.lit(".dec")))


def block_size_label(block_size_id) -> Column:
    pairs = [F.lit(x) for kv in BLOCK_LABELS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _c(block_size_id))


def block_max_size(block_size_id) -> Column:
    pairs = [F.lit(x).cast("int" if i % 2 == 0 else "long") for kv in BLOCK_SIZES.items() for i, x in enumerate(kv)]
    return F.coalesce(F.create_map(*pairs)[_c(block_size_id)], F.lit(1 << 16).cast("long"))


def octal(n, width: int) -> Column:
    """width - 1 octal digits and a NUL."""
    return F.concat(F.lpad(F.conv(_c(n).cast("string"), 10, 8), width - 1, "0").cast("binary"), F.unhex(F.lit("00")))


def hex_literal(text) -> Column:
    """Bytes of a hexadecimal text with any white space."""
    return F.unhex(F.regexp_replace(_c(text), r"\s", ""))


def is_tar(data) -> Column:
    return (F.octet_length(_c(data)) > 263) & (F.hex(F.substring(_c(data), 258, 5)) == F.lit("7573746172"))
