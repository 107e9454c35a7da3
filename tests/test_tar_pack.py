"""Archives hold every entry once, and no directory or header goes through a shuffle."""

import io
import tarfile

from marlstone.operators import tar


def test_pack_against_tarfile_and_without_a_second_shuffle(spark):
    rows = [("g", 3, "a/b/c/" + "n" * 120, b"x" * 513), ("g", 1, "a/é/f", None), ("g", 2, "top", b""), ("h", 1, "/root/x//y", b"1"), ("h", 2, None, b"lost"), (None, 1, "d/" * 90 + "e", b"2")]
    df = spark.createDataFrame(rows, "g string, o long, n string, d binary")
    packed = tar.pack(df, "g", "o", "n", "d", 5)
    assert packed._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1
    got = {r.g: tarfile.open(fileobj=io.BytesIO(r.archive)).getmembers() for r in packed.collect()}
    names = lambda g: [(m.name, m.isdir(), m.size) for m in got[g]]
    assert names("g") == [("a", True, 0), ("a/b", True, 0), ("a/b/c", True, 0), ("a/é", True, 0), ("a/é/f", False, 0), ("top", False, 0), ("a/b/c/" + "n" * 120, False, 513)]
    assert sorted((m.name.rstrip("/"), m.isdir()) for m in got["h"]) == [("/root", True), ("/root/x", True), ("/root/x", True), ("/root/x//y", False)]
    assert len(got[None]) == 91 and all(m.mtime == 5 for m in got[None])
