"""What a Python worker holds at a time is bounded, whatever the size of a table."""

import os

from pyspark.sql import functions as F

from marlstone.functions import _bytes, codecs
from marlstone.queries import Q

SF = "/root/testdata/sf0.001"


def test_queries_bound_their_batches(spark):
    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    try:
        for n in names:
            spark.conf.unset(n)
        Q["block_table"](spark, SF)
        assert int(spark.conf.get(names[0])) <= 500 and int(spark.conf.get(names[1]).rstrip("b")) <= 4 << 20
        spark.conf.set(names[0], "7")
        Q["size_routing"](spark, SF)
        assert spark.conf.get(names[0]) == "7"  # a session that asks for fewer keeps its setting
    finally:
        for n in names:
            spark.conf.unset(n)


def test_sequences_are_those_of_each_cell(spark):
    cells = [None, b"", _bytes.encode_block(b"abcd" * 50), _bytes.encode_block(os.urandom(300)), b"\x1f"]
    rows = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(cells)], "i long, b binary").coalesce(1)
    got = {r.i: r.s for r in rows.select("i", codecs.block_sequences(F.col("b")).alias("s")).collect()}
    assert got[0] is None and got[1] == []
    for i, c in enumerate(cells[1:], 1):
        assert [tuple(s) for s in got[i]] == _bytes.sequences_of(c)
