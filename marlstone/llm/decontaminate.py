"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark items (questions and answers) and documents are normalised alike: ASCII capitals become small, and every
run of other characters than ASCII letters, digits and non-ASCII characters separates words. The patterns are all
windows of `window` consecutive words of an item (a shorter item is one window), each with the items it occurs in. One
automaton over all patterns scans every document once; a match marks the words it covers, whose offsets are mapped
back to code points of the original text.

Symbols are numbered words, so a window has as many nodes as words. The automaton is broadcast, and its size is estimated first from
the counted words: beyond `max_bytes` the benchmark is dealt into as many automata as that bound asks for, each scanning all
documents, and the marks are united. Long items are cut into overlapping pieces before they are dealt, so no item makes a large
automaton of its own. No document, item or window is left out either way.

Defined results: null and empty texts have no words and are clean. Items without words have no windows. Items with a
null id still contaminate, and are listed as an empty id. Repeated item ids count once, repeated documents are
returned each. Empty tables give empty results (or clean documents). Only the named columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from ._common import LOWER_ALNUM, save

WINDOW = 13
#: Bytes of one automaton at most, by estimate; bytes of one of its nodes; words of a benchmark piece.
MAX_BYTES = 128_000_000
NODE_BYTES = 64
PIECE_WORDS = 4096
RUN = "struct<first:bigint,last:bigint,start:bigint,end:bigint>"
SCAN = f"struct<n_words:bigint,hits:array<{RUN}>,items:array<string>>"
_RUN = ("first", "last", "start", "end")
_SCAN_TYPE = pa.struct(
    [("n_words", pa.int64()), ("hits", pa.list_(pa.struct([(n, pa.int64()) for n in _RUN]))), ("items", pa.list_(pa.string()))]
)
_ORIGINAL_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(LOWER_ALNUM).split()


def pieces_of(words: list[bytes], window: int, most: int = PIECE_WORDS) -> list[list[bytes]]:
    """An item's words in pieces that overlap by window - 1 words, so that each window lies whole in one piece."""
    if not words:
        return []
    return [words[i : i + most + window - 1] for i in range(0, max(1, len(words) - window + 1), most)]


class Automaton:
    """Aho-Corasick automaton over the windows of benchmark pieces, with numbered words as symbols."""

    def __init__(self, pieces: list[tuple[str, str]], window: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in pieces:
            ids = tuple(self.number.setdefault(w, len(self.number) + 1) for w in text.encode().split())
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(ids[i : i + window], set()).add(item_id)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, items in found.items():
            self.machine.add_word(ids, (len(ids), tuple(items)))
        self.shortest = min(map(len, found), default=0)
        if found:
            self.machine.make_automaton()

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(last word, words, items) of each occurrence of a window."""
        m = self.shortest
        if not m or len(words) < m:
            return
        ids = np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        if (known[m:] - known[:-m] == m).any():  # no window without as many benchmark words in a row
            for last, (n, items) in self.machine.iter(tuple(ids.tolist())):
                yield last, n, items


def scan(raw: bytes, text: str | None, automaton: Automaton) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
    """Words, runs of marked words (first, last, and their code points if text is given), items of one document."""
    words = words_of(raw)
    items: set[str] = set()
    marks = np.zeros(len(words) + 1, np.int32)
    for last, n, ids in automaton.matches(words):
        marks[last - n + 1] += 1
        marks[last + 1] -= 1
        items.update(ids)
    if not items:
        return len(words), [], []
    inside = np.concatenate(([0], np.cumsum(marks[:-1]) > 0, [0])).astype(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)] if text is not None else None
    runs = [(int(a), int(b) - 1) for a, b in zip(edges[::2], edges[1::2])]
    return len(words), [(a, b, at[a][0], at[b][1]) if at else (a, b, -1, -1) for a, b in runs], sorted(items)


_built: dict[str, object] = {}


def _scan_column(shared, key: str, window: int):
    @arrow_udf(SCAN)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(shared.value, window)
        automaton = _built[key]
        for texts in parts:
            out = []
            for raw in texts.cast(pa.binary()).to_pylist():
                raw = raw or b""
                n, hits, items = scan(raw, None, automaton)
                if hits:  # few texts: only these are decoded for the mapping to original offsets
                    n, hits, items = scan(raw, raw.decode(), automaton)
                out.append({"n_words": n, "hits": [dict(zip(_RUN, h)) for h in hits], "items": items})
            yield pa.array(out, _SCAN_TYPE)

    return run


def _united(a: Column, b: Column) -> Column:
    """One scan result of two of the same text. Runs sorted by their first word are merged in one fold."""
    none = F.array().cast(f"array<{RUN}>")

    def merge(acc, x):
        top = F.element_at(acc, -1)
        joined = F.struct(
            top["first"].alias("first"),
            F.greatest(top["last"], x["last"]).alias("last"),
            top["start"].alias("start"),
            F.greatest(top["end"], x["end"]).alias("end"),
        )
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        meets = (F.size(acc) > 0) & (x["first"] <= top["last"] + 1)
        return F.when(meets, F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    runs = F.array_sort(F.concat(a["hits"], b["hits"]))
    items = F.array_sort(F.array_union(a["items"], b["items"]))
    return F.struct(a["n_words"].alias("n_words"), F.aggregate(runs, none, merge).alias("hits"), items.alias("items"))


def _cutter(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (item, b" ".join(p), len(p))
                for item, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist())
                for p in pieces_of(words_of(raw or b""), window)
            ]
            ids, texts, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([t.decode() for t in texts], pa.string()), pa.array(sizes, pa.int64())], names=["item_id", "piece", "n"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per document: row (the input row), n_words, hits (runs of marked words with original offsets), items (ids, sorted as strings)."""
    spark = docs.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    pieces = save(items.mapInArrow(_cutter(window), "item_id string, piece string, n long").distinct(), "benchmark-pieces")
    weight = F.octet_length("piece") + F.col("n") * F.lit(window * NODE_BYTES)
    size = pieces.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    shards = max(1, -(-size // max_bytes))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    for s in range(shards):
        part = pieces if shards == 1 else pieces.filter(F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)) == s)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.select("item_id", "piece").collect()])  # its automaton has about max_bytes
        own = _scan_column(shared, uuid.uuid4().hex, window)(F.coalesce(F.col("row.text"), F.lit("")))
        if s == 0:
            rows = rows.select("row", own.alias("found"))
        else:  # the automata are never in memory together: each scan is written before the next
            rows = save(rows, "scanned").select("row", "found", own.alias("more"))
            rows = rows.select("row", _united(F.col("found"), F.col("more")).alias("found"))
    return rows.select("row", "found.n_words", "found.hits", "found.items")


def judge(found: DataFrame) -> DataFrame:
    """row, n_words, n_hit, n_items, items, hits, contaminated (a twentieth of the words or more is hit)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, h: acc + h["last"] - h["first"] + 1)
    return found.select(
        "row",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        "items",
        "hits",
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs."""
    clean = judge(find_contamination(docs, benchmark)).filter(~F.col("contaminated"))
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
