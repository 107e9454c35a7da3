"""Files read, compressed and decompressed by ranges, against the files themselves."""

import random

import pyarrow as pa

from marlstone.plans.compress import FrameOptions
from marlstone.sources.ranges import compress_files, decompress_files


def test_files_by_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    cells = {"a": random.Random(1).randbytes(150_000) + b"text " * 50_000, "c": b"short"}
    for name, data in cells.items():
        (tmp_path / "in" / name).write_bytes(data)
    for options in (FrameOptions(), FrameOptions(block_checksum=True, content_size=False, content_checksum=False, block_size_id=5)):
        made = compress_files(spark, str(tmp_path / "in"), None, options, size=100_000).orderBy("part").collect()
        assert len(made) == 5
        for name, data in cells.items():
            stream = b"".join(bytes(r.frame) for r in made if r.path.endswith("/" + name))
            (tmp_path / "out" / f"{name}.lz4").write_bytes(b"\x53\x2a\x4d\x18\x02\x00\x00\x00hi" + stream)
        got = decompress_files(spark, str(tmp_path / "out")).orderBy("part").collect()
        for name, data in cells.items():
            assert b"".join(bytes(r.data) for r in got if r.path.endswith(f"/{name}.lz4")) == data
        assert all(r.error is None for r in got)


def test_damage_by_ranges_is_told(spark, tmp_path):
    whole = pa.Codec("lz4").compress(b"linked blocks share their history " * 9_000, asbytes=True)
    for name, data in {"linked": whole, "cut": whole[:30], "odd": b"nothing of the kind"}.items():
        (tmp_path / f"{name}.lz4").write_bytes(data)
    got = {r.path.split("/")[-1]: r.error for r in decompress_files(spark, str(tmp_path)).filter("error is not null").collect()}
    assert got == {"linked.lz4": "Linked blocks need the one before", "cut.lz4": "Truncated block data", "odd.lz4": "No standard frame here"}
