"""Exact dedup by composable polynomial fingerprints.

A text is equal to another when both are identical after each run of ASCII white space became one blank. The
fingerprint of a normalised text is its UTF-8 byte string read as a polynomial at two points modulo two primes
below 2^31. Chunks are hashed independently and composed by length-shifted arithmetic:
H(a || b) = H(a) * r^len(b) + H(b). Texts above `huge_chars` are cut into chunk rows which Spark spreads over all
tasks and composes with a native fold; all others compose their chunks in the task that reads them. Both ways give
the same fingerprint. Texts with equal fingerprints are then compared chunk by chunk: for each chunk number the
smallest and the largest chunk of the group must agree, which partial aggregation settles before any shuffle.

Defined results: a null text counts as empty; empty texts are equal to each other. A null doc_id never stays unless
its whole group has null ids (keep_id is then null and kept is false). Rows repeating the kept doc_id are kept alike.
An empty table gives an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import maybe_broadcast, save, small_enough

PRIMES = (2147483629, 2147483587)
POINTS = (1000003, 7368787)
CHUNK = 1 << 14
FP_SCHEMA = "doc_id long, n_bytes long, f1 long, f2 long, sha binary"
CHUNK_SCHEMA = "rid long, no long, n_bytes long, h1 long, h2 long, p1 long, p2 long"
KEY = ["n_bytes", "f1", "f2"]


def normalised(text) -> F.Column:
    """text with each run of ASCII white space replaced by one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*", " ")


def _weights(i: int) -> np.ndarray:
    out, x = np.empty(CHUNK, np.uint64), 1
    for k in range(CHUNK - 1, -1, -1):
        out[k] = x
        x = x * POINTS[i] % PRIMES[i]
    return out


_tables: list[np.ndarray] = []


def chunk_hash(raw: bytes) -> tuple[int, int]:
    """Both polynomial hashes of one chunk of at most CHUNK bytes."""
    if not _tables:
        _tables.extend(_weights(i) for i in (0, 1))
    a = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int((a * t[CHUNK - len(a) :]).sum()) % p for t, p in zip(_tables, PRIMES))


def compose(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Fingerprint of a concatenation from those of its parts."""
    return tuple((h * pow(r, right_len, p) + g) % p for h, g, r, p in zip(left, right, POINTS, PRIMES))


def fingerprint(raw: bytes) -> tuple[int, int]:
    """Fingerprint of a whole byte string, composed from its chunks."""
    h = (0, 0)
    for at in range(0, len(raw), CHUNK):
        part = raw[at : at + CHUNK]
        h = compose(h, chunk_hash(part), len(part))
    return h


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        prints = [fingerprint(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                b.column(0),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
            ],
            names=["doc_id", "n_bytes", "f1", "f2", "sha"],
        )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raws = b.column(2).cast(pa.binary()).to_pylist()
        prints = [fingerprint(t) for t in raws]
        sizes = [len(t) for t in raws]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(sizes, pa.int64())]
            + [pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1)]
            + [pa.array([pow(POINTS[i], n, PRIMES[i]) for n in sizes], pa.int64()) for i in (0, 1)],
            names=["rid", "no", "n_bytes", "h1", "h2", "p1", "p2"],
        )


def _pieces(t, size: int) -> F.Column:
    """t cut into pieces of `size` characters (one empty piece for an empty text)."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(t) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(t, s + F.lit(1), F.lit(size)))


def fingerprints(docs: DataFrame, huge_chars: int = 8_000_000, piece_chars: int = 1_000_000) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, f1, f2 (the fingerprint) and sha (SHA-256 digest) of the normalised text."""
    base = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    small = base.filter(F.char_length("t") <= huge_chars).mapInArrow(_whole, FP_SCHEMA)
    huge = base.filter(F.char_length("t") > huge_chars).select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "t"
    )
    if small_enough(huge.select("rid"), 0):
        return small
    rows = save(huge, "huge-texts")
    parts = rows.select("rid", F.posexplode(_pieces(F.col("t"), piece_chars)).alias("no", "piece"))
    hashed = (
        parts.select("rid", F.col("no").cast("long").alias("no"), "piece")
        .repartition(F.col("rid"), F.col("no"))
        .mapInArrow(_chunks, CHUNK_SCHEMA)
    )
    parts = F.array_sort(F.collect_list(F.struct("no", "h1", "h2", "p1", "p2")))
    fold = lambda h, p, m: F.aggregate(
        "parts", F.lit(0).cast("long"), lambda acc, x: (acc * x[p] + x[h]) % F.lit(m)
    )
    composed = hashed.groupBy("rid").agg(F.sum("n_bytes").alias("n_bytes"), parts.alias("parts"))
    composed = composed.select(
        "rid", "n_bytes", fold("h1", "p1", PRIMES[0]).alias("f1"), fold("h2", "p2", PRIMES[1]).alias("f2")
    )
    big = rows.select("rid", "doc_id", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"))
    return small.unionByName(big.join(composed, "rid").drop("rid"))


def _same_texts(docs: DataFrame, prints: DataFrame, groups: DataFrame, piece_chars: int) -> DataFrame:
    """KEY, same: whether all texts of a group agree in every chunk. Only texts of repeated fingerprints are read."""
    again = prints.join(maybe_broadcast(groups.select(*KEY), 1_000_000), KEY, "left_semi")
    ids = again.filter(F.col("doc_id").isNotNull()).select("doc_id", *KEY).distinct()
    texts = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    found = texts.join(maybe_broadcast(ids, 1_000_000), "doc_id")
    # A repeated doc_id may bring in rows with another text; the byte length and SHA-256 already told those apart.
    pieces = found.filter(F.octet_length("t") == F.col("n_bytes")).select(
        *KEY, F.posexplode(_pieces(F.col("t"), piece_chars)).alias("no", "piece")
    )
    per_chunk = pieces.groupBy(*KEY, "no").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"))
    return per_chunk.groupBy(*KEY).agg(F.min(F.col("lo") == F.col("hi")).alias("same"))


def exact_dedup(docs: DataFrame, piece_chars: int = 65_536, huge_chars: int = 8_000_000) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes."""
    prints = save(fingerprints(docs, huge_chars), "fingerprints")
    size = F.count(F.lit(1)).alias("group_size")
    groups = prints.groupBy(*KEY).agg(F.min("doc_id").alias("keep_id"), size).filter("group_size > 1")
    groups = save(groups, "fingerprint-groups")
    differ = save(_same_texts(docs, prints, groups, piece_chars).filter(~F.col("same")).select(*KEY), "collisions")
    if small_enough(differ, 0):
        classes = groups.withColumn("only", F.lit(None).cast("binary"))
    else:  # different texts behind one fingerprint: their groups are told apart by the digest as well
        apart = prints.join(F.broadcast(differ) if small_enough(differ, 100_000) else differ, KEY, "left_semi")
        apart = apart.groupBy(*KEY, F.col("sha").alias("only")).agg(F.min("doc_id").alias("keep_id"), size)
        good = groups.join(differ, KEY, "left_anti").withColumn("only", F.lit(None).cast("binary"))
        classes = good.unionByName(apart)
    c = maybe_broadcast(classes, 500_000).alias("c")
    p = prints.alias("p")
    on = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in KEY]
    on.append(F.col("c.only").isNull() | (F.col("c.only") == F.col("p.sha")))
    keep = F.when(F.col("c.group_size").isNull(), F.col("p.doc_id")).otherwise(F.col("c.keep_id"))
    return p.join(c, on, "left").select(
        F.col("p.doc_id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("c.group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("p.doc_id") == keep, F.lit(False)).alias("kept"),
        F.lower(F.hex("p.sha")).alias("text_sha256"),
        F.col("p.n_bytes").alias("n_bytes"),
    )
