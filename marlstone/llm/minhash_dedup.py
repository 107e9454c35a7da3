"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds its distinct runs of `width` words (ASCII capitals made small, words split at ASCII white space; fewer
words are one run). SuperMinHash gives each element a pseudo-random permutation of the signature's slots: the element
offers slot p[j] the value j + u. Ranks of one element are correlated, which lowers the variance against
independent hashes, and a level j can stop as soon as every slot holds less than j. Levels run over all elements of a
document at once.

Banding is chosen so that two documents at the threshold share no band with probability below 1e-6. Documents sharing a
band are candidates. Nothing is emitted for all pairs of a bucket: first each member is compared with the bucket's
smallest member, on full sets. The links make components; only buckets whose members lie in several components are
looked at again, as pairs of bounded blocks, each in one task which compares signatures, then full sets of the
pairs that pass (six standard errors below the threshold), and returns links only. Thus
candidates are never capped, and work beyond the first pass occurs only where it may still join components.

Equal texts are one class from the start. Defined results: null or empty texts have no set and stay single. A null
doc_id is its own single row with a null component (kept is then false). Repeated doc_ids with different texts are linked by
their common id. Ties do not arise: the smallest doc_id leads. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import maybe_broadcast, mix64, salted_join, save, shingle_hashes, small_enough, spaced
from .components import connected_components

SLOTS = 180
MISS = 1e-6
BLOCK = 512
#: Elements which get their permutation in one array (bounds memory for very long texts).
PART = 8192
_SCALE = np.float32(2.0**-24)


def banding(threshold: float, slots: int = SLOTS, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose bands all differ at the threshold with probability below miss."""
    for rows in range(12, 0, -1):
        if (1 - threshold**rows) ** (slots // rows) < miss:
            return slots // rows, rows
    raise ValueError("too few slots for this threshold")


def superminhash(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signature (float32, length slots) of an array of distinct 64-bit element hashes, not empty."""
    sig = np.full(slots, np.inf, np.float32)
    for at in range(0, len(elements), PART):
        own = elements[at : at + PART]
        n = len(own)
        perm = np.empty((n, slots), np.uint8)
        perm[:] = np.arange(slots, dtype=np.uint8)
        row = np.arange(n)
        for j in range(slots):
            if sig.max() < j:
                break
            r = mix64(own, j + 1)
            u = (r >> np.uint64(40)).astype(np.float32) * _SCALE
            k = j + ((r & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            slot = perm[row, k].copy()
            perm[row, k] = perm[:, j]
            np.minimum.at(sig, slot, u + np.float32(j))
    return sig


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    bits = sig.view(np.uint32)[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix64(key ^ bits[:, i], i + 1)
    return key.astype(np.int64)


def _shingles(raw: bytes, width: int) -> np.ndarray:
    return np.unique(shingle_hashes(spaced(raw), width))


def _sketcher(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sigs, bands_ = [], [], [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                words = spaced(raw or b"")
                h = shingle_hashes(words, width)
                if not len(h):
                    keys.append(None), sizes.append(0), sigs.append(None), bands_.append(None)
                    continue
                # Two sums over the runs in order and the words' length name the text itself.
                place = mix64(h + np.arange(len(h), dtype=np.uint64), 3)
                keys.append(place.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix64(place, 5)).tobytes() + len(words).to_bytes(8, "little"))
                h = np.unique(h)
                sizes.append(len(h))
                sig = superminhash(h)
                sigs.append(sig.tobytes())
                bands_.append(band_hashes(sig, bands, rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands_, pa.list_(pa.int64()))],
                names=["doc_id", "key", "n_shingles", "sig", "bands"],
            )

    return run


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a similarity of num / den or more."""
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def _verifier(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, np.ndarray] = {}  # by the text itself: an id may have several texts
        for b in batches:
            ok = []
            for tx, ty in zip(*(b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))):
                if tx not in memo:
                    if len(memo) > 64:
                        memo.clear()
                    memo[tx] = _shingles(tx, width)
                ok.append(linked(memo[tx], _shingles(ty, width), num, den))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return run


def _block_links(width: int, num: int, den: int, rows: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Links between members of different components within one pair of blocks of one bucket."""
        col = {n: table.column(n).to_pylist() for n in ("id", "component", "half", "text", "sig", "number")}
        sig = np.stack([np.frombuffer(s, np.float32) for s in col["sig"]])
        comp, half = np.array(col["component"]), np.array(col["half"])
        t = num / den
        least = sig.shape[1] * (t - 6 * math.sqrt(t * (1 - t) / sig.shape[1]))
        sets: dict[int, np.ndarray] = {}
        got: list[tuple[int, int]] = []
        one_block = key[1].as_py() == key[2].as_py()
        left = np.flatnonzero(half != 1) if not one_block else np.arange(len(comp))
        right = np.flatnonzero(half != 0) if not one_block else left
        number = col["number"][0]
        for i in left:
            other = right[(comp[right] != comp[i]) & ((right > i) if one_block else True)]
            if not len(other):
                continue
            same = sig[other] == sig[i]
            other, same = other[same.sum(1) >= least], same[same.sum(1) >= least]
            if number and len(other):  # pairs that met in an earlier band are settled there
                early = same[:, : number * rows].reshape(len(other), number, rows).all(2).any(1)
                other = other[~early]
            for j in other:
                for x in (i, j):
                    if x not in sets:
                        sets[x] = _shingles(col["text"][x].encode(), width)
                if linked(sets[i], sets[j], num, den):
                    got.append((col["id"][i], col["id"][j]))
        return pa.table({"a": pa.array([g[0] for g in got], pa.int64()), "b": pa.array([g[1] for g in got], pa.int64())})

    return run


def _texts_for(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of the documents that occur in pairs (a, b); pairs hold class leaders only."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    ids = maybe_broadcast(ids, 2_000_000)
    return docs.filter("doc_id is not null").select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")


def near_duplicates(
    docs: DataFrame, num: int = 85, den: int = 100, width: int = 5, slots: int = SLOTS, block: int = BLOCK
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept. Links need num / den of the union in common."""
    bands, rows = banding(num / den, slots)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, key binary, n_shingles long, sig binary, bands array<long>"
    sketches = save(docs.mapInArrow(_sketcher(width, bands, rows), schema), "sketches")

    live = sketches.filter("key is not null and doc_id is not null")
    classes = live.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = save(classes, "text-classes")
    multi = maybe_broadcast(classes.filter("copies > 1").select("key", "id"), 500_000)
    heads = live.select("doc_id", "key", "sig", "bands").join(multi, "key", "left")
    # Only classes of several rows can hold a leader twice; all others reach their readers without a shuffle.
    leaders = heads.filter("id is null").unionByName(heads.filter("id = doc_id").dropDuplicates(["doc_id", "key"])).select(F.col("doc_id").alias("id"), "sig", "bands")

    # Band members; buckets of one are gone before anything is joined.
    at = leaders.select("id", F.posexplode("bands").alias("number", "bucket"))
    buckets = at.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
    buckets = save(buckets.select("bucket", "low"), "buckets")
    members = save(at.join(maybe_broadcast(buckets, 1_000_000), "bucket"), "bucket-members")

    star = save(members.filter("id != low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
    texts = save(_texts_for(star, docs), "candidate-texts")
    # The texts of a large bucket do not all go to the task of its smallest member: that one's text goes to them.
    pairs = salted_join(star, texts.select(F.col("id").alias("a"), F.col("text").alias("ta")).distinct(), "a")
    pairs = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    links = save(pairs.mapInArrow(_verifier(width, num, den), "a long, b long"), "star-links")
    found = connected_components(links)

    # Buckets that still hold several components, less those whose pairs were all compared with the smallest member.
    named = members.join(maybe_broadcast(found, 1_000_000), F.col("id") == F.col("node"), "left").select(
        "bucket", "number", "id", F.coalesce("component", "id").alias("component")
    )
    # The members of a bucket's smallest component (most of them, in a large group of copies) need no comparison with each other.
    per = named.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.min_by("component", "id").alias("main")
    )
    open_ = per.filter("n > 2 and c0 != c1").select("bucket", "n", "main")
    rest_of = named.join(maybe_broadcast(open_, 1_000_000), "bucket").withColumn("apart", F.col("component") != F.col("main"))
    rest_of = save(rest_of, "open-members")
    if not small_enough(rest_of, 0):
        sizes = rest_of.groupBy("bucket").agg(F.ceil(F.count_if("apart") / F.lit(block)).cast("long").alias("na"), F.ceil(F.count_if(~F.col("apart")) / F.lit(block)).cast("long").alias("nm"))
        rest = rest_of.join(maybe_broadcast(sizes, 1_000_000), "bucket")
        # Blocks 0 to na - 1 hold the members apart, the next nm the others; pairs of blocks have at least one of the former.
        dice = F.xxhash64("id")
        own = F.when(F.col("apart"), F.pmod(dice, "na")).otherwise(F.col("na") + F.pmod(dice, F.greatest("nm", F.lit(1).cast("long"))))
        last = F.when(F.col("apart"), F.col("na") + F.col("nm")).otherwise(F.col("na")) - 1
        rest = rest.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        rest = rest.select(
            "bucket",
            "number",
            "id",
            "component",
            F.least("own", "other").alias("x"),
            F.greatest("own", "other").alias("y"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("half"),
        )
        # Signatures and texts of other documents stay where they are.
        ids = maybe_broadcast(save(rest_of.select("id").distinct(), "open-ids"), 2_000_000)
        sides = rest.join(leaders.select("id", "sig").join(ids, "id", "left_semi"), "id").join(texts.join(ids, "id", "left_semi"), "id")
        more = sides.groupBy("bucket", "x", "y").applyInArrow(_block_links(width, num, den, rows), "a long, b long")
        more = save(more.distinct(), "block-links")
        if not small_enough(more, 0):
            found = connected_components(links.unionByName(more))

    # Copies and repeated ids join the component of their class.
    named = sketches.join(multi, "key", "left").withColumn("leader", F.coalesce("id", "doc_id"))
    return (
        named.join(maybe_broadcast(found, 1_000_000), F.col("leader") == F.col("node"), "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "leader").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def drop_near_duplicates(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs that lead their component, and those without a doc_id; columns as in docs."""
    gone = near_duplicates(docs, num, den).filter("doc_id is not null and not kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = maybe_broadcast(save(gone, "near-duplicates"), 2_000_000)
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("gone"), "left_anti")
