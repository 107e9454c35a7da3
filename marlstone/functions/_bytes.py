"""Small per-cell helpers on bytes, used inside Arrow functions: block coding and the frame walk."""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import pyarrow as pa
import xxhash

FRAME_MAGIC = 0x184D2204
LEGACY_MAGIC = 0x184C2102
SKIPPABLE_BASE = 0x184D2A50
BLOCK_SIZES = {4: 1 << 16, 5: 1 << 18, 6: 1 << 20, 7: 1 << 22}
LEGACY_BLOCK = 8 << 20
WINDOW = 65535
MIN_MATCH, LAST_LITERALS, MATCH_LIMIT = 4, 5, 12
_codecs: dict[int, pa.Codec] = {}


#: Fixed value: the text that opens each generated buffer.
GENERATOR_TEXT = b"Hello World! This is LZ4 benchmark data. "


def generated(n: int, seed: int = 12345) -> bytes:
    """n bytes: the low bytes of x -> (double(x) * 1103515245 + 12345) & 0x7FFFFFFF, the first 4,096 overlaid by a repeated text."""
    out, x = bytearray(n), seed
    for i in range(n):
        x = int(float(x) * 1103515245.0 + 12345.0) & 0x7FFFFFFF
        out[i] = x & 255
    head = min(n, 4096)
    out[:head] = (GENERATOR_TEXT * (head // len(GENERATOR_TEXT) + 1))[:head]
    return bytes(out)


def bound(n: int) -> int:
    """Largest size a block of n bytes can take."""
    return 0 if n > 0x7E000000 else n + n // 255 + 16


def encode_block(src: bytes, level: int = 1, prefix: bytes = b"") -> bytes:
    """A block of src. Levels of 2 and above search deeper (and use no prefix), below 1 they skip faster."""
    if not src:
        return b""
    if prefix and level < 2 or level < 0:
        return _greedy(src, max(1, -level), prefix[-WINDOW:])
    level = max(1, min(level, 12))
    if level not in _codecs:
        _codecs[level] = pa.Codec("lz4_raw", compression_level=level)
    return _codecs[level].compress(src, asbytes=True)


def _length(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def _emit(out: bytearray, literals: bytes, match: int = 0, offset: int = 0) -> None:
    n, m = len(literals), match - MIN_MATCH
    out.append(min(n, 15) << 4 | (min(m, 15) if match else 0))
    if n >= 15:
        out += _length(n - 15)
    out += literals
    if match:
        out += offset.to_bytes(2, "little")
        if m >= 15:
            out += _length(m - 15)


@lru_cache(4)
def _places(prefix: bytes) -> dict[bytes, int]:
    """The last place of each four bytes of a dictionary; made once a worker."""
    return {prefix[i : i + 4]: i for i in range(len(prefix) - 3)}


def _greedy(src: bytes, step: int, prefix: bytes) -> bytes:
    """One candidate for each four bytes, misses skipped by `step`; matches may reach into the prefix."""
    data, base = prefix + src, len(prefix)
    before, table = _places(prefix), {}
    end, out = len(data), bytearray()
    i = anchor = base
    while i <= end - MATCH_LIMIT:
        key = data[i : i + 4]
        at = table.get(key)
        if at is None:
            at = before.get(key)
        table[key] = i
        if at is None or i - at > WINDOW:
            i += step
            continue
        n, most = MIN_MATCH, end - LAST_LITERALS - i
        while n < most:
            w = min(64, most - n)
            if data[i + n : i + n + w] == data[at + n : at + n + w]:
                n += w
                continue
            while data[i + n] == data[at + n]:
                n += 1
            break
        _emit(out, data[anchor:i], n, i - at)
        i += n
        anchor = i
    _emit(out, data[anchor:])
    return bytes(out)


def stored(raw: bytes, o) -> bytes:
    """Size word, data and optional checksum of a block: packed, or raw with bit 31 set where packing does not help."""
    data = encode_block(raw, o.search_level, o.dictionary)
    word = len(data)
    if word >= len(raw):
        data, word = raw, len(raw) | 1 << 31
    check = struct.pack("<I", xxhash.xxh32_intdigest(data)) if o.block_checksum else b""
    return struct.pack("<I", word) + data + check


def frame_of(raw: bytes, o) -> bytes:
    """The frame of a cell, block by block."""
    flg = 64 | o.independent << 5 | o.block_checksum << 4 | o.content_size << 3 | o.content_checksum << 2 | bool(o.dict_id)
    head = bytes([flg, o.block_size_id << 4])
    if o.content_size:
        head += struct.pack("<Q", len(raw))
    if o.dict_id:
        head += struct.pack("<I", o.dict_id)
    check = struct.pack("<I", xxhash.xxh32_intdigest(raw)) if o.content_checksum else b""
    own = bytes([xxhash.xxh32_intdigest(head) >> 8 & 255])
    body = b"".join(stored(raw[i : i + o.block_size], o) for i in range(0, len(raw), o.block_size))
    return struct.pack("<I", FRAME_MAGIC) + head + own + body + bytes(4) + check


def sequences_of(src: bytes) -> list[tuple[int, int, int]]:
    """(literal length, match offset, match length) of each sequence; what a truncated tail still tells included."""
    out, i, n = [], 0, len(src)
    while i < n:
        token = src[i]
        i += 1
        lit, i = _read_length(src, i, token >> 4)
        if i + lit >= n:
            out.append((min(lit, n - i), 0, 0))
            break
        i += lit
        if i + 2 > n:
            out.append((lit, 0, 0))
            break
        offset = src[i] | src[i + 1] << 8
        match, i = _read_length(src, i + 2, token & 15)
        out.append((lit, offset, match + MIN_MATCH))
    return out


def _read_length(src: bytes, i: int, n: int) -> tuple[int, int]:
    if n == 15:
        while i < len(src):
            b = src[i]
            i, n = i + 1, n + b
            if b != 255:
                break
    return n, i


def decode_block(src: bytes, limit: int, prefix: bytes = b"") -> tuple[bytes, str | None]:
    """(bytes, error) of a block. At most `limit` bytes; a truncated block gives what it holds."""
    if not prefix and 0 < len(src):
        # A block alone in a minimal frame decodes in the native library; odd blocks and those over 4 MiB are walked below.
        frame = b"\x04\x22\x4d\x18\x60\x70\x73" + struct.pack("<I", len(src)) + src + bytes(4)
        try:
            out = pa.CompressedInputStream(pa.BufferReader(frame), "lz4").read()
            if len(out) <= limit:
                return out, None
        except (OSError, pa.ArrowInvalid):
            pass
    out, base, i = bytearray(prefix[-WINDOW:]), len(prefix[-WINDOW:]), 0
    for lit, offset, match in sequences_of(src):
        token = src[i]
        _, at = _read_length(src, i + 1, token >> 4)
        out += src[at : at + lit]
        i = at + lit
        if match:
            _, i = _read_length(src, i + 2, token & 15)
            if offset == 0:
                return bytes(out[base:]), "Invalid match offset: 0"
            start = len(out) - offset
            if start < 0:
                return bytes(out[base:]), "Match before start of data"
            run = bytes(out[start : start + match])
            out += (run * (match // len(run) + 1))[:match]
        if len(out) - base >= limit:
            break
    return bytes(out[base : base + limit]), None


def walk(src: bytes) -> list[dict]:
    """Frames of a byte string without decoding: type, place, header and blocks of each, an error where it breaks off."""
    out, pos = [], 0
    while pos + 4 <= len(src):
        magic = int.from_bytes(src[pos : pos + 4], "little")
        if magic == FRAME_MAGIC:
            f = _standard(src, pos)
        elif magic == LEGACY_MAGIC:
            f = _legacy(src, pos)
        elif magic & ~15 == SKIPPABLE_BASE:
            size = int.from_bytes(src[pos + 4 : pos + 8], "little")
            whole = pos + 8 <= len(src) and pos + 8 + size <= len(src)
            f = {"type": "skippable", "end": min(len(src), pos + 8 + size), "magic_variant": magic & 15, "content_size": size}
            f["error"] = None if whole else "Truncated skippable frame"
        else:
            f = {"type": "unknown", "end": len(src), "error": f"Invalid magic number: 0x{magic:08X}"}
        f |= {"magic": magic, "offset": pos, "total_bytes": f.pop("end") - pos}
        out.append(f)
        pos += f["total_bytes"]
        if f["error"] or f["type"] == "unknown":
            break
    if not out or pos < len(src) and not out[-1]["error"]:
        rest = {"type": "unknown", "offset": pos, "total_bytes": len(src) - pos, "magic": None, "error": "Input too short"}
        if len(src) > pos or not out:
            out.append(rest)
    return out


def _standard(src: bytes, pos: int) -> dict:
    f = {"type": "standard", "error": None, "blocks": [], "end": len(src)}
    at = pos + 6
    if at > len(src):
        return f | {"error": "Truncated frame descriptor"}
    flg, bd = src[pos + 4], src[pos + 5]
    f |= {"flg": flg, "bd": bd}
    if flg & 8:
        if at + 8 > len(src):
            return f | {"error": "Truncated content size field"}
        f["content_size"] = min(int.from_bytes(src[at : at + 8], "little"), (1 << 63) - 1)
        at += 8
    if flg & 1:
        if at + 4 > len(src):
            return f | {"error": "Truncated dictionary ID field"}
        f["dict_id"] = int.from_bytes(src[at : at + 4], "little")
        at += 4
    if at >= len(src):
        return f | {"error": "Truncated header checksum"}
    f["header_checksum"] = src[at]
    f["header_checksum_valid"] = src[at] == xxhash.xxh32_intdigest(src[pos + 4 : at]) >> 8 & 255
    at += 1
    while True:
        if at + 4 > len(src):
            return f | {"error": "Truncated block data"}
        word = int.from_bytes(src[at : at + 4], "little")
        if word == 0:
            at += 4
            break
        size = word & 0x7FFFFFFF
        if at + 4 + size > len(src):
            return f | {"error": "Truncated block data"}
        block = {"offset": at, "header_size": 4, "compressed_size": size, "is_uncompressed": bool(word >> 31)}
        at += 4 + size
        if flg & 16:
            if at + 4 > len(src):
                return f | {"error": "Truncated block checksum"}
            block["block_checksum"] = int.from_bytes(src[at : at + 4], "little")
            block["block_checksum_valid"] = block["block_checksum"] == xxhash.xxh32_intdigest(src[at - size : at])
            at += 4
        f["blocks"].append(block)
    if flg & 4:
        if at + 4 > len(src):
            return f | {"error": "Truncated content checksum"}
        f["content_checksum"] = int.from_bytes(src[at : at + 4], "little")
        at += 4
    return f | {"end": at}


def _legacy(src: bytes, pos: int) -> dict:
    f, at = {"type": "legacy", "error": None, "blocks": []}, pos + 4
    while at + 4 <= len(src):
        size = int.from_bytes(src[at : at + 4], "little")
        if size == 0 or size > bound(LEGACY_BLOCK):
            break
        if at + 4 + size > len(src):
            return f | {"error": "Truncated block data", "end": len(src)}
        f["blocks"].append({"offset": at, "header_size": 4, "compressed_size": size, "is_uncompressed": False})
        at += 4 + size
    return f | {"end": at}


def decode_frame(src: bytes, f: dict, dictionary: bytes = b"") -> tuple[bytes, str | None]:
    """Content of one walked frame, linked blocks with their history; at most what the blocks declare."""
    if f["type"] in ("skippable", "unknown"):
        return b"", f["error"]
    legacy = f["type"] == "legacy"
    limit = LEGACY_BLOCK if legacy else BLOCK_SIZES.get(f.get("bd", 0) >> 4 & 7, 1 << 16)
    linked = not legacy and not f.get("flg", 32) & 32
    parts: list[bytes] = []
    history, error = dictionary[-WINDOW:], f["error"]
    for b in f.get("blocks", ()):
        raw = src[b["offset"] + 4 : b["offset"] + 4 + b["compressed_size"]]
        if b["is_uncompressed"]:
            part, wrong = raw[:limit], None
        else:
            part, wrong = decode_block(raw, limit, history)
        parts.append(part)
        if wrong:
            error = error or wrong
            break
        if linked:
            history = (history + part)[-WINDOW:]
    return b"".join(parts), error


@lru_cache(64)
def _fixed(size: int, mtime: int, kind: bytes) -> tuple[bytes, bytes, int]:
    """What stands between name and checksum and between checksum and prefix of a header, and the sum of both with eight blanks."""
    before = b"0000644\0" + b"0000000\0" * 2 + b"%011o\0%011o\0" % (size, mtime)
    after = kind + bytes(100) + b"ustar\x0000" + bytes(64) + b"0000000\0" * 2
    return before, after, sum(before) + sum(after) + 8 * 32


def _ustar(name: bytes, prefix: bytes, size: int, mtime: int, kind: bytes) -> bytes:
    before, after, total = _fixed(size, mtime, kind)
    check = b"%06o\0 " % (total + sum(name) + sum(prefix))
    return name.ljust(100, b"\0") + before + check + after + prefix.ljust(155, b"\0") + bytes(12)


def tar_archive(files: list[dict], mtime: int) -> bytes | None:
    """Ancestor directories by name, then files (name, data) in their order, padded, and two zero blocks. Files without a name are left out."""
    dirs: set[str] = set()
    parts = []
    for f in files:
        name, data = f["name"], f["data"] or b""
        if name is None:
            continue
        at = name.rfind("/")
        while at > 0 and name[: at + 1] not in dirs:
            dirs.add(name[: at + 1])
            at = name.rfind("/", 0, at)
        parts += [tar_header(name, len(data), mtime, "0"), data, bytes(-len(data) % 512)]
    if not parts:
        return None
    return b"".join([tar_header(d, 0, mtime, "5") for d in sorted(dirs, key=str.encode)] + parts + [bytes(1024)])


def tar_header(name: str, size: int, mtime: int, kind: str) -> bytes:
    """512 bytes; a name over 100 bytes is split at the last slash that leaves at most 155 and 100 bytes, or else told in a pax record."""
    raw = name.encode()
    own, prefix, record = raw, b"", b""
    if len(raw) > 100:
        cut = raw[:156].rfind(b"/")
        if cut > 0 and 0 < len(raw) - cut - 1 <= 100:
            prefix, own = raw[:cut], raw[cut + 1 :]
        else:
            line = b" path=" + raw + b"\n"
            n = len(line) + len(str(len(line)))
            n = len(line) + len(str(n))
            body = str(n).encode() + line
            record = _ustar(b"pax_header", b"", len(body), mtime, b"x") + body.ljust(-(-len(body) // 512) * 512, b"\0")
            own = raw[:100]
    return record + _ustar(own, prefix, size, mtime, kind.encode())


def _pax_path(body: bytes) -> str | None:
    """The last path record of a pax header."""
    found = None
    while m := re.match(rb"(\d{1,9}) ", body):
        n = int(m[1])
        key, _, value = body[m.end() : n].partition(b"=")
        if key == b"path":
            found = value[:-1].decode("utf-8", "replace")
        body = body[max(n, 1) :]
    return found


def tar_entries_of(src: bytes) -> list[dict]:
    """Entries of a tar archive up to the first zero block; the data of every entry is skipped by its size.

    Pax and GNU long names apply to the entry that follows them; their own entries are not returned.
    """
    out, pos, long_name = [], 0, None
    text = lambda a, n: src[pos + a : pos + a + n].split(b"\0", 1)[0].decode("utf-8", "replace")

    def octal(a: int, n: int) -> int:
        digits = text(a, n).strip()
        return int(digits, 8) if digits and not digits.strip("01234567") else 0

    while pos + 512 <= len(src):
        head = src[pos : pos + 512]
        if not any(head):
            break
        size, prefix = octal(124, 12), text(345, 155) if head[257:262] == b"ustar" else ""
        name, kind = text(0, 100), chr(head[156]) if head[156] else "0"
        body = src[pos + 512 : pos + 512 + size]
        if kind in "xL":
            long_name = (_pax_path(body) if kind == "x" else body.split(b"\0")[0].decode("utf-8", "replace")) or long_name
        elif kind != "g":
            out.append(
                {
                    "name": (long_name or (f"{prefix}/{name}" if prefix else name)).rstrip("/"),
                    "type": kind,
                    "size": size,
                    "mtime": octal(136, 12),
                    "checksum_valid": octal(148, 8) == sum(head[:148]) + sum(head[156:]) + 8 * 32,
                    "data": body if size and kind == "0" else b"",
                }
            )
            long_name = None
        pos += 512 + -(-size // 512) * 512
    return out
