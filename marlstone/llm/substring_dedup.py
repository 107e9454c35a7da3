"""Substring dedup by compact windows.

The tokens of a text are its runs of `width` words (ASCII capitals made small, words split at ASCII white space). Under a min-hash function,
all subsequences of a text that share their smallest token form compact windows (left, centre, right): the node of the Cartesian
tree over the tokens' hashes, with the reach of its subtree. A text of n tokens has about 2n/t windows wide enough for t tokens.

A passage that keeps a similarity of `num`/`den` over `min_words` words holds a run of equal tokens whose length follows from the two
(`least_run`: a gap between runs costs four tokens of either text at least, in texts that do not repeat a few words over and over). The two
occurrences of such a run have the same smallest token, and half a run in common on one side of it. So windows of that reach, keyed by
the tokens of each half run beside their centre, collide for certain, with one function. Collisions of one pair of texts are
joined by interval: those on nearby diagonals whose windows overlap are one candidate, which is verified on the texts
themselves: matching runs are chained as long as the two intervals keep the similarity over their tokens. Passages of at least `min_words` words are returned.

No group is expanded into pairs: the windows that share a key meet the group's shortest text, found by partial
aggregation. The elected text may share the half run but not the passage. Hence every place of a colliding window at which a passage
may start meets again under the hash of that whole passage, and the shortest text is elected anew: all members of such a group hold the passage
word for word, so no link between them is lost. Only places (of windows that no text has twice) that a verified run repeats word for word in the elected text are left out; that text
stands for them, and it is the shorter one, so the last of them is in the group. Thus the texts that share a passage of `min_words` words
word for word are connected by returned rows, whose spans hold it (where one token repeats over and over, not at every place of that stretch). Equal texts are one class from the start; copies
are returned as one passage that spans the whole text. Keys that occur in one text only (almost all) are gone after the first aggregation.

A near copy of a passage without `min_words` equal words in a row need not be in the elected text either. Of the members of a group, those whose
window lies in a verified passage of the elected text are connected by it. Any other is compared with all members, in blocks of
bounded size and on the tokens around the window: such a passage holds a piece of less than twice its least length that keeps the similarity, and
the longest run of that piece has a window of both texts. Members that a block has already connected are not compared again, and pairs that hold
a near copy there are verified on their texts like all others. Thus near copies that share a window are connected by returned rows too.
This compares pairs, so a very large group of texts that share a line and nothing else costs the square of its size, dealt over all tasks.

Defined results: null, empty and texts shorter than `min_words` have no passages. Repeats within one text are not reported. A null doc_id takes no part.
Repeated rows of one doc_id and text are one document. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import _power_tables, maybe_broadcast, mix64, save, shingle_hashes, small_enough, spaced

MIN_WORDS = 50
#: Tokens that a gap between two runs of equal tokens costs at least (one word put in or left out, with width 5).
GAP = 4
#: Largest table of shared values that is broadcast.
BROADCAST_ROWS = 100_000
#: Members of a group that meet its elected text in one task.
PART = 512
_WINDOWS = "doc_id long, key binary, n_words long, value array<long>, c array<int>, l array<int>, r array<int>"


def compact_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(centre, left, right) of the windows of at least `least` tokens: Cartesian tree nodes with that reach.

    Equal smallest tokens of one range are one node, centred on the first, so that constant texts do not grow deep trees.
    """
    out, todo = [], [(0, len(h))]
    while todo:
        a, b = todo.pop()
        if b - a < least:
            continue
        own = h[a:b]
        c = int(own.argmin())
        ties = np.flatnonzero(own == own[c])
        out.append((a + c, a, b - 1))
        edge = a
        for x in ties.tolist():
            if a + x - edge >= least:
                todo.append((edge, a + x))
            edge = a + x + 1
        if b - edge >= least:
            todo.append((edge, b))
    return out


def least_run(least: int, num: int, den: int, gap: int = GAP) -> int:
    """The longest run of equal tokens that a passage of `least` tokens or more with a similarity of num/den holds at least.

    Of n tokens a side, m with m / (2n - m) >= num / den are in common, and the n - m others make (n - m) / gap gaps at most.
    """
    runs = []
    for n in range(least, 8 * least):
        m = -(-2 * n * num // (num + den))
        runs.append(-(-m // ((n - m) // gap + 1)))
    return max(1, min(runs))


def range_hashes(h: np.ndarray, first: np.ndarray, size: int, salt: int) -> np.ndarray:
    """64-bit hashes of the `size` tokens from each place in first."""
    power, inverse = _power_tables(len(h) + 1)
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(mix64(h, 9) * power[: len(h)], out=sums[1:])
    return mix64((sums[first + size] - sums[first]) * inverse[first], salt)


def _windows(width: int, least: int, reach: int):
    half = reach // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, values, places, counts = [], [], [], [], [0]
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                words = spaced(raw or b"")
                h = shingle_hashes(words, width)
                n = len(h) + width - 1 if len(h) else 0
                total = counts[-1]
                if len(h) >= least:
                    place = mix64(h + np.arange(len(h), dtype=np.uint64), 3)
                    keys.append(place.sum(dtype=np.uint64).tobytes() + np.bitwise_xor.reduce(mix64(place, 5)).tobytes() + len(words).to_bytes(8, "little"))
                    got = np.array(compact_windows(mix64(h, 100), reach), np.int32).reshape(-1, 3)
                    # A run of `reach` tokens around the centre holds all of the half before it or all of the half after it.
                    for side, use in ((0, got[got[:, 0] - half >= got[:, 1]]), (1, got[got[:, 0] + half <= got[:, 2]])):
                        values.append(range_hashes(h, use[:, 0] if side else use[:, 0] - half, half + 1, 100 + side))
                        places.append(use)
                        total += len(use)
                else:
                    keys.append(None)
                sizes.append(n)
                counts.append(total)
            flat = np.concatenate(values).astype(np.int64) if values else np.empty(0, np.int64)
            at = np.concatenate(places) if places else np.empty((0, 3), np.int32)
            offsets = pa.array(counts, pa.int32())
            lists = [flat, *(np.ascontiguousarray(x) for x in (at[:, 0], at[:, 0] - at[:, 1], at[:, 2] - at[:, 0]))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists)],
                names=["doc_id", "key", "n_words", "value", "c", "l", "r"],
            )

    return run


def match_passages(a: np.ndarray, b: np.ndarray, seeds: list[tuple[int, int]], least: int, share: float) -> list[tuple]:
    """(first a, last a, first b, last b, similarity, runs in b) of passages of two token arrays, grown from seed positions.

    From a seed, equal tokens extend a run along its diagonal. Runs are chained into a passage over gaps in which the tokens differ,
    as long as the similarity over the passage (tokens in common / all tokens of both) stays at `share` or above.
    """
    done: list[tuple[int, int, int, int]] = []
    runs = set()
    for i, j in sorted(set(seeds)):
        if any(p <= i <= q and u <= j <= v for p, q, u, v in done) or a[i] != b[j]:
            continue
        left = a[i - min(i, j) : i][::-1] != b[j - min(i, j) : j][::-1]
        stop = np.flatnonzero(left)
        back = int(stop[0]) if len(stop) else len(left)
        m = min(len(a) - i, len(b) - j)
        stop = np.flatnonzero(a[i : i + m] != b[j : j + m])
        ahead = int(stop[0]) if len(stop) else m
        runs.add((i - back, i + ahead - 1, j - back, j + ahead - 1))
        done.append((i - back, i + ahead - 1, j - back, j + ahead - 1))
    out = []
    for run in sorted(runs):
        if any(p <= run[0] and run[1] <= q and u <= run[2] and run[3] <= v for p, q, u, v, *_ in out):
            continue
        p, q, u, v = run
        same, equal = q - p + 1, [(u, v)]
        for step in (1, -1):  # grow to the right, then to the left, over gaps
            while True:
                got = _next_run(a, b, q if step > 0 else p, v if step > 0 else u, step, int((q - p + 1) * (1 - share) / share) + 8)
                if got is None:
                    break
                x, y, n = got
                np_, nq, nu, nv = (p, x, u, y) if step > 0 else (x, q, y, v)
                both = same + n
                if both < share * ((nq - np_ + 1) + (nv - nu + 1) - both):
                    break
                p, q, u, v, same = np_, nq, nu, nv, both
                equal.append((y - n + 1, y) if step > 0 else (y, y + n - 1))
        if min(q - p, v - u) + 1 >= least:
            out.append((p, q, u, v, same / ((q - p + 1) + (v - u + 1) - same), equal))
    return out


def _next_run(a: np.ndarray, b: np.ndarray, i: int, j: int, step: int, reach: int):
    """(end in a, end in b, tokens) of the nearest run of equal tokens beyond (i, j) in a direction, within reach."""
    if step > 0:
        left, right = a[i + 1 : i + 1 + reach], b[j + 1 : j + 1 + reach]
    else:
        left, right = a[max(0, i - reach) : i][::-1], b[max(0, j - reach) : j][::-1]
    first: dict[int, int] = {}
    for e, token in enumerate(right.tolist()):
        first.setdefault(token, e)
    best = None
    for d, token in enumerate(left.tolist()):
        if best is not None and d >= best[0]:
            break
        e = first.get(token)
        if e is not None and (best is None or max(d, e) < best[0]):
            best = (max(d, e), d, e)
    if best is None:
        return None
    x, y = i + step * (best[1] + 1), j + step * (best[2] + 1)
    if step > 0:
        m = min(len(a) - x, len(b) - y)
        differ = np.flatnonzero(a[x : x + m] != b[y : y + m])
    else:
        m = min(x, y) + 1
        differ = np.flatnonzero(a[x - m + 1 : x + 1][::-1] != b[y - m + 1 : y + 1][::-1])
    n = int(differ[0]) if len(differ) else m
    return x + step * (n - 1), y + step * (n - 1), n


def candidates(hits: list[dict]) -> list[list[tuple[int, int]]]:
    """Interval join of the collisions of one pair of texts: seeds of hits on nearby diagonals whose windows overlap."""
    out: list[list] = []
    for h in sorted(hits, key=lambda h: (h["ca"] - h["cb"], h["ca"])):
        a0, a1, d = h["ca"] - h["la"], h["ca"] + h["ra"], h["ca"] - h["cb"]
        if out and d - out[-1][2] <= 16 and a0 <= out[-1][1] and out[-1][0] <= a1:
            out[-1][0], out[-1][1], out[-1][2] = min(a0, out[-1][0]), max(a1, out[-1][1]), d
            out[-1][3].append((h["ca"], h["cb"]))
        else:
            out.append([a0, a1, d, [(h["ca"], h["cb"])]])
    return [c[3] for c in out]


#: equal: the runs of b of a whole passage or more that are in a word for word (numbers of tokens).
_FOUND = "a long, b long, first_a long, last_a long, first_b long, last_b long, similarity double, equal array<struct<x:int,y:int>>"
_EQUAL = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))


def _verify(width: int, least: int, share: float):
    names = [c.split()[0] for c in _FOUND.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.float64(), _EQUAL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            memo: dict[bytes, np.ndarray] = {}  # by the text itself: an id may have several texts
            cols = [batch.column(i).to_pylist() for i in (0, 1, 2)]
            raws = [batch.column(i).cast(pa.binary()).to_pylist() for i in (3, 4)]
            rows = []
            for x, y, hits, tx, ty in zip(*cols, *raws):
                both = []
                for text in (tx, ty):
                    if text not in memo:
                        if len(memo) > 64:
                            memo.clear()
                        memo[text] = shingle_hashes(spaced(text), width)
                    both.append(memo[text])
                (first, other), seen = both, set()
                hits = [h for h in hits if h["ca"] < len(first) and h["cb"] < len(other)]
                for seeds in candidates(hits):
                    for p, q, u, v, s, equal in match_passages(first, other, seeds, least, share):
                        if (p, u) not in seen:
                            seen.add((p, u))
                            rows.append((x, y, p, q + width - 1, u, v + width - 1, s, [{"x": i, "y": j} for i, j in equal if j - i + 1 >= least]))
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=names)

    return run


_WINDOW = "value long, doc_id long, rank long, c int, l int, r int"


def _starts(width: int, least: int):
    """Rows (doc_id, rank, windows, equal, text) to the places where a passage around a window's centre may start, keyed by its tokens.

    Places of passages inside one of the runs in equal are left out, unless a text has the window several times. l is 0 and r ends the passage.
    """
    names = [c.split()[0] for c in _WINDOW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = []
            for doc, rank, own, equal, raw in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 3)), b.column(4).cast(pa.binary()).to_pylist()):
                h = shingle_hashes(spaced(raw), width)
                marks = np.zeros(max(0, len(h) - least + 1), bool)
                for several in (False, True):
                    for w in own:
                        if w["several"] == several:
                            marks[max(w["c"] - w["l"], w["c"] - least + 1, 0) : max(0, min(w["c"], w["c"] + w["r"] - least + 1) + 1)] = True
                    for e in () if several else equal or ():
                        marks[e["x"] : max(0, e["y"] - least + 2)] = False
                first = np.flatnonzero(marks)
                n, key = len(first), range_hashes(h, first, least, 200).astype(np.int64)
                parts.append((key, np.full(n, doc), np.full(n, rank), first.astype(np.int32), np.zeros(n, np.int32), np.full(n, least - 1, np.int32)))
            cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.int32)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return run


def _meetings(windows: DataFrame, label: str, all_places: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members of the groups of windows that share a value (value, doc_id, rank, low, parts, c, l, r), and the pairs with the elected texts (a, b, hits).

    With all_places, the further places of a value in its elected text meet one place in another text.
    """
    elected = windows.groupBy("value").agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count(F.lit(1)).alias("n")).filter("low != high")
    # Each member knows over how many parts its group is dealt, so that no task gets a whole large group and no join has to look the sizes up.
    elected = save(elected.select("value", "low", F.ceil(F.col("n") / PART).cast("long").alias("parts")), f"{label}-values")
    near = F.broadcast(elected) if small_enough(elected, BROADCAST_ROWS) else elected.hint("shuffle_hash")
    members = save(windows.join(near, "value"), f"{label}-members")
    heads = members.filter("rank = low").groupBy("value").agg(F.min(F.struct("doc_id", "c", "l", "r")).alias("h"), F.max("parts").alias("parts"))
    others = members.filter("rank != low").select("value", F.pmod(F.xxhash64("doc_id", "c", "l", "r"), "parts").alias("part"), "doc_id", "c", "l", "r")
    copies = heads.select("value", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pairs = others.join(copies, ["value", "part"]).select("h", "doc_id", "c", "l", "r")
    if all_places:
        places = members.filter("rank = low").select("value", F.struct("doc_id", "c", "l", "r").alias("h")).join(heads.select("value", F.col("h").alias("first")), "value").filter("h != first")
        opposite = others.groupBy("value").agg(F.min(F.struct("doc_id", "c", "l", "r")).alias("o"))
        pairs = pairs.unionByName(places.join(opposite, "value").select("h", "o.*"))
    hit = F.struct(F.col("h.c").alias("ca"), F.col("c").alias("cb"), F.col("h.l").alias("la"), F.col("h.r").alias("ra"))
    return members, pairs.groupBy(F.col("h.doc_id").alias("a"), F.col("doc_id").alias("b")).agg(F.collect_set(hit).alias("hits")).filter("a != b")


_PLACE = "value long, doc_id long, rank long, main boolean, parts long, c int, l int, r int, at int, tokens array<int>"
_NEAR = "a long, b long, ca int, cb int, la int, ra int"


def _surroundings(width: int, least: int):
    """Rows (doc_id, places, text) to the tokens around each place, as 32-bit numbers; `at` is where its centre is among them."""
    names = [c.split()[0] for c in _PLACE.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()] + [pa.int32()] * 4 + [pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, places, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                h = (shingle_hashes(spaced(raw), width) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
                for w in places:
                    if w["c"] < len(h):
                        low = max(0, w["c"] - 2 * least + 1)
                        rows.append((w["value"], doc, w["rank"], w["main"], w["parts"], w["c"], w["l"], w["r"], w["c"] - low, h[low : w["c"] + 2 * least]))
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)

    return run


def _common_tokens(tokens: list[np.ndarray]) -> np.ndarray:
    """[i, j]: how many tokens of i are in j too."""
    flat, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1  # a token that is there once is in no other
    owner, at = owner[n[at] > 1], number[at[n[at] > 1]]
    out = np.zeros((len(tokens), len(tokens)), np.float32)
    for first in range(0, int(number[-1]) + 1, 4096):
        use = (at >= first) & (at < first + 4096)
        times = np.zeros((len(tokens), 4096), np.float32)
        np.add.at(times, (owner[use], at[use] - first), 1)
        out += times @ (times > 0).T.astype(np.float32)
    return out


def _near_pairs(least: int, num: int, den: int):
    """A block of members of one group to pairs of them that hold a near copy around their windows and connect the block."""
    need, share = -(-2 * least * num // (num + den)), num / den
    names = [c.split()[0] for c in _NEAR.split(", ")]

    def run(block: pa.Table) -> pa.Table:
        doc, rank, main, part, c, l, r, at = (block.column(x).to_numpy() for x in ("doc_id", "rank", "main", "part", "c", "l", "r", "at"))
        tokens = [np.array(t, np.int32) for t in block.column("tokens").to_pylist()]
        both = _common_tokens(tokens)
        both = (both >= need) & (both.T >= need) & ~(main[:, None] & main) & (doc[:, None] != doc)
        if block.column("x")[0] != block.column("y")[0]:
            both &= part[:, None] != part
        root = np.where(main, len(doc), np.arange(len(doc)))
        rows = []
        for i, j in np.argwhere(np.triu(both)).tolist():
            if root[i] != root[j] and match_passages(tokens[i], tokens[j], [(int(at[i]), int(at[j]))], least, share):
                root[root == root[i]] = root[j]
                i, j = (i, j) if (rank[i], doc[i]) < (rank[j], doc[j]) else (j, i)
                rows.append((doc[i], doc[j], c[i], c[j], l[i], r[i]))
        return pa.table([pa.array(x, kind) for x, kind in zip(list(zip(*rows)) or [()] * 6, [pa.int64()] * 2 + [pa.int32()] * 4)], names=names)

    return run


def _near_meetings(members: DataFrame, first: DataFrame, texts: DataFrame, width: int, least: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b, hits) of members of a group that hold a near copy at its windows where the elected text connects them not."""
    ranks = members.select(F.col("doc_id").alias("a"), F.col("rank").alias("low")).distinct()
    spans = first.join(ranks, "a").groupBy(F.col("b").alias("id")).agg(F.collect_set(F.struct("low", "first_b", "last_b")).alias("spans"))
    met = F.exists("spans", lambda x: (x["low"] == F.col("low")) & F.col("c").between(x["first_b"], x["last_b"]))
    flags = members.join(spans, F.col("doc_id") == F.col("id"), "left").withColumn("main", (F.col("rank") == F.col("low")) | F.coalesce(met, F.lit(False)))
    flags = save(flags.select("value", "doc_id", "rank", "main", "c", "l", "r"), "met-members")
    groups = flags.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("main").alias("all"), F.countDistinct("doc_id").alias("docs")).filter("not all and docs > 1")
    groups = save(groups.select("value", F.ceil(F.col("n") / PART).cast("long").alias("parts")), "near-values")
    near = F.broadcast(groups) if small_enough(groups, BROADCAST_ROWS) else groups.hint("shuffle_hash")
    places = flags.join(near, "value").groupBy("doc_id").agg(F.collect_set(F.struct("value", "rank", "main", "parts", "c", "l", "r")).alias("places"))
    around = places.join(texts, F.col("doc_id") == F.col("id")).select("doc_id", "places", "text").mapInArrow(_surroundings(width, least), _PLACE)
    around = around.withColumn("part", F.pmod(F.xxhash64("doc_id", "c"), "parts")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    around = around.withColumn("x", F.least("part", "k")).withColumn("y", F.greatest("part", "k")).drop("k", "parts")
    found = save(around.groupBy("value", "x", "y").applyInArrow(_near_pairs(least, num, den), _NEAR), "near-pairs")
    return found.groupBy("a", "b").agg(F.collect_set(F.struct("ca", "cb", "la", "ra")).alias("hits"))


def repeated_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, num: int = 4, den: int = 5, width: int = 5
) -> DataFrame:
    """doc_id, first_word, last_word of each passage that repeats, with match_id, match_first, match_last, similarity and whole.

    match_id is a text that holds the passage too (of equal texts the one with the smallest doc_id; whole marks copies of it).
    Word numbers start at 0 and are inclusive.
    """
    least = min_words - width + 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    made = save(docs.mapInArrow(_windows(width, least, least_run(least, num, den)), _WINDOWS).filter("key is not null"), "windows")

    classes = made.groupBy("key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"))
    multi = save(classes.filter("copies > 1").select("key", "id"), "copied-texts")
    near = maybe_broadcast(multi, 500_000)
    copies = made.select("doc_id", "key", "n_words").join(near, "key").filter("doc_id != id").distinct()
    whole = copies.select(
        "doc_id", F.lit(0).cast("long").alias("first_word"), (F.col("n_words") - 1).alias("last_word"), F.col("id").alias("match_id"),
        F.lit(0).cast("long").alias("match_first"), (F.col("n_words") - 1).alias("match_last"), F.lit(1.0).alias("similarity"), F.lit(True).alias("whole"),
    )

    # Windows of one text of each class; the shorter a text, the smaller its rank.
    heads = made.join(near, "key", "left").filter("id is null or id = doc_id")
    short = F.least(F.col("n_words"), F.lit((1 << 22) - 1).cast("long"))
    rank = F.shiftleft(short, 40).bitwiseOR(F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)))
    windows = heads.select("doc_id", rank.alias("rank"), F.inline(F.arrays_zip("value", "c", "l", "r")))
    members, pairs = _meetings(windows, "shared")

    ids = save(members.select(F.col("doc_id").alias("id")).distinct(), "candidate-ids")
    texts = docs.withColumnRenamed("doc_id", "id").join(maybe_broadcast(ids, 2_000_000), "id", "left_semi")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        # The elected texts are the short ones: they go first, so that the second shuffle carries little.
        sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return save(sides.select("a", "b", "hits", "ta", "tb").mapInArrow(_verify(width, least, num / den), _FOUND), label)

    first = verified(pairs, "passages")
    equal = first.select(F.col("b").alias("id"), F.explode("equal").alias("e")).groupBy("id").agg(F.collect_set("e").alias("equal"))
    twice = members.groupBy("value", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("value").distinct()
    twice = maybe_broadcast(save(twice, "values-of-several-places").withColumn("several", F.lit(True)), 1_000_000)
    own = members.filter(F.col("l") + F.col("r") >= least - 1).join(twice, "value", "left").groupBy("doc_id").agg(
        F.min("rank").alias("rank"), F.max("rank").alias("top"), F.collect_set(F.struct("c", "l", "r", F.coalesce("several", F.lit(False)).alias("several"))).alias("windows")
    )
    own = own.join(equal, F.col("doc_id") == F.col("id"), "left").drop("id")
    own = own.withColumn("equal", F.when(F.col("rank") == F.col("top"), F.col("equal")))  # an id of several texts: whose runs they are is not known
    last = F.lit(least - 1)
    low = lambda w: w["c"] - F.least(w["l"], last)
    high = lambda w: w["c"] + F.least(w["r"], last)
    inside = lambda w: F.exists("equal", lambda e: (e["x"] <= low(w)) & (high(w) <= e["y"]))
    own = own.withColumn("windows", F.filter("windows", lambda w: w["several"] | ~F.coalesce(inside(w), F.lit(False)))).filter(F.size("windows") > 0)
    again = own.join(texts, F.col("doc_id") == F.col("id")).select("doc_id", "rank", "windows", "equal", "text")
    _, pairs = _meetings(save(again.mapInArrow(_starts(width, least), _WINDOW), "open-places"), "open", True)
    near = verified(_near_meetings(members, first, texts, width, least, num, den), "near-passages")
    found = first.unionByName(verified(pairs, "more-passages")).unionByName(near).drop("equal").distinct()
    parts = found.select(
        F.col("b").alias("doc_id"), F.col("first_b").alias("first_word"), F.col("last_b").alias("last_word"), F.col("a").alias("match_id"),
        F.col("first_a").alias("match_first"), F.col("last_a").alias("match_last"), "similarity", F.lit(False).alias("whole"),
    )
    return parts.unionByName(whole)
