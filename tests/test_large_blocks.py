"""Blocks over 4 MiB come back whole, and what a bound cuts off is told."""

import hashlib
import random

from pyspark.sql import functions as F

from marlstone import queries
from marlstone.functions import codecs

WORDS = [bytes(random.Random(i).choices(b"abcdefgh", k=6)) for i in range(50)]
BIG = (b" ".join(random.Random(1).choices(WORDS, k=40_000)) * 20)[: (1 << 22) + 999]


def test_block_roundtrip_of_a_text_over_4_mib(spark, tmp_path):
    assert len(BIG) > 1 << 22
    rows = [(1, BIG.decode(), "en", "s"), (2, "small", "en", "s"), (3, None, "en", "s"), (4, "x" * (1 << 22), "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in queries.Q["block_roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {i: hashlib.md5((t or "").encode()).hexdigest() for i, t, _, _ in rows}


def test_content_over_the_bound_is_an_error(spark):
    d = spark.createDataFrame([(b"q" * 100,), (b"q" * 10,)], "c binary").select(codecs.block_compress("c").alias("b"))
    got = [tuple(r) for r in d.select(codecs.block_decompress("b", 10).alias("d")).select(F.col("d.data").cast("string"), "d.error").collect()]
    assert sorted(got, key=lambda r: r[1] or "") == [("q" * 10, None), ("q" * 10, "Larger than 10 bytes")]


def test_benchmark_protocols(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(queries.bench, "generated", lambda spark, size: size)
    monkeypatch.setattr(queries.bench, "measure", lambda df, options, runs, warm=1: seen.append((df, runs, warm)) or (1, 1, 1.0, 1.0, 1.0, 1.0, 1.0))
    assert queries.Q["bench_generated"](spark, "").count() == 6
    assert seen == [(1 << k, 3, 1) for k in (10, 12, 14, 16, 18, 20)]
    queries.bench.results_of(spark.range(1))
    assert seen[6][1:] == (5, 2)
