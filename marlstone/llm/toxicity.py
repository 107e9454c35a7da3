"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled texts, discount their counts down to one shared backoff
distribution. An expression counts once for each text that holds it, so a text that repeats a word thousands of times is
one piece of evidence. Counts up to a discount (PAIR_DISCOUNT, WORD_DISCOUNT texts) are given to the shared counts, and both classes back
off with the same weight: hence an expression that is rare in both classes has the same probability in both and says nothing.

A text is scored by the length-normalised difference of its log-likelihoods, and by how that difference is spread: its mean over
distinct words, its three highest words, and what lies above one unit (a few expressions in a long text would vanish in
its mean alone). A logistic curve maps these to a probability. It is fitted on a sample of labelled texts, at most about FIT_ROWS / 2 of
each class, weighted back to the share of their class; the text's own counts are left out of its features.

Counts cover all labelled texts the caller allows; they are Spark aggregations and grow with the corpus, no share of it is cut off.
Entries that a discount reduces to nothing in both classes cannot change a score, and are not looked up. The others are broadcast
if their counted number is at most `max_broadcast`. Beyond it the sample of the fit is exploded to its distinct pairs and joined, and
a word or pair is broadcast as its key and log ratio alone, which is all a text's score needs: all of them at once, or in parts of the words
with the pairs that end with them, one part after another. A text's features are sums, maxima and highest values over its words, so those
of the parts, a few numbers a text, are put together by the digest of the text; no text and no word of a text is shuffled to be scored
(drop_toxic sends the digests of rejected texts to the texts; beyond two million of them Spark shuffles both sides).
All ways compute the same features.

Defined results: null and empty texts score the fitted curve at zero words. Rows with null or missing labels teach
nothing; of several labels of one doc_id the largest counts. Repeated rows are scored each, alike. Without labelled texts of both
classes every score is the share of toxic ones (0 without any). Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

from ._common import maybe_broadcast, mix64, salted_join, save, shingle_hashes, small_enough, spaced

PAIR_DISCOUNT = 3
WORD_DISCOUNT = 4
FIT_ROWS = 20_000
REJECT_AT = 0.7
CHUNK_BYTES = 200_000
#: Largest number of model entries that is broadcast (at most 56 bytes each).
MODEL_ROWS = 4_000_000
#: Largest number of entries that one part of the model holds as keys and log ratios (16 bytes each).
PART_ROWS = 8_000_000
#: Labels that are broadcast at once.
LABEL_ROWS = 2_000_000
START = np.uint64(1)
#: Byte table: ASCII capitals become small; other ASCII bytes than letters become blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
FEATURES = 8
#: Numbers of a text in one part of the model: see _sums.
SUMS = 9


@dataclass
class Chunk:
    """Words of some texts as 64-bit hashes, and their distinct pairs: text, word, word before, pair, times."""

    size: int
    words: np.ndarray  # of each text
    text: np.ndarray
    word: np.ndarray
    before: np.ndarray
    pair: np.ndarray
    times: np.ndarray


def chunks_of(raws: list[bytes | None]) -> Iterator[Chunk]:
    """Texts in order, at least one and about CHUNK_BYTES a chunk, so that a short text costs no array calls of its own."""
    own, size = [], 0
    for raw in raws:
        own.append(spaced(raw or b"", LETTERS))
        size += len(own[-1])
        if size > CHUNK_BYTES:
            yield _chunk(own)
            own, size = [], 0
    if own:
        yield _chunk(own)


def _chunk(texts: list[bytes]) -> Chunk:
    n = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    w = shingle_hashes(b" ".join(t for t in texts if t), 1)
    text = np.repeat(np.arange(len(texts)), n)
    before = np.roll(w, 1)
    before[(np.cumsum(n) - n)[n > 0]] = START
    pair = _pair(before, w)
    _, first, times = np.unique(mix64(pair ^ text.astype(np.uint64), 33), return_index=True, return_counts=True)
    return Chunk(len(texts), n, text[first], w[first], before[first], pair[first], times)


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(before ^ mix64(word, 31), 32)


def _summed(keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, where each occurs first, and how often in either class."""
    u, first, at = np.unique(keys, return_index=True, return_inverse=True)
    return u, first, [np.bincount(at[classes == c], minlength=len(u)) for c in (0, 1)]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, np.ndarray]]:
    for b in batches:
        toxic, at = b.column(1).to_numpy(), 0
        for c in chunks_of(b.column(0).cast(pa.binary()).to_pylist()):
            yield c, toxic[at : at + c.size][c.text]
            at += c.size


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with the pairs that end (u) and begin (p) with them, each pair once a text."""
    for c, toxic in _labelled(batches):
        for keys, kind in ((c.word, "u"), (c.before, "p")):
            u, _, n = _summed(keys, toxic)
            none = np.zeros(len(u), np.int64)
            cols = [*n, none, none] if kind == "u" else [none, none, *n]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *map(pa.array, cols)], names=["key", "u0", "u1", "p0", "p1"])


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c, toxic in _labelled(batches):
        u, first, n = _summed(c.pair, toxic)
        yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)) for x in (c.word, c.before)] + [*map(pa.array, n)], names=["word", "h", "c0", "c1"])


@arrow_udf(LongType())
def _pair_key(before: pa.Array, word: pa.Array) -> pa.Array:
    return pa.array(_pair(*(x.to_numpy().view(np.uint64) for x in (before, word))).view(np.int64))


@dataclass
class Model:
    """Counted tables (as DataFrames) and, if they are small enough, their rows; totals; the fitted curve."""

    words: DataFrame | None
    pairs: DataFrame | None
    weight: float  # of the shared distribution
    own: tuple[float, float]  # discounted words of each class
    total: float
    arrays: tuple[np.ndarray, ...] | None = None
    curve: tuple | None = None
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __getstate__(self):
        return self.__dict__ | {"words": None, "pairs": None}

    def ratio(self, u, c, lam, used, log, most):
        """log p(word | before, toxic) - log p(word | before, ordinary) from counts, in numpy or in columns."""
        shared = (u[0] + u[1] + 0.5) * (self.weight / self.total)
        p = []
        for k in (0, 1):
            low = most(u[k] - WORD_DISCOUNT, 0) * ((1 - self.weight) / self.own[k]) + shared
            p.append(lam * most(c[k] - PAIR_DISCOUNT, 0) / most(used[k], 1) + (1 - lam) * low)
        return log(p[1]) - log(p[0])

    def features(self, raws: list[bytes | None], own: np.ndarray | None = None) -> np.ndarray:
        """Features of texts; own holds their classes if their counts are in the model and must be left out."""
        out, at = [np.empty((0, FEATURES))], 0
        for c in chunks_of(raws):
            out.append(self._features(c, None if own is None else own[at : at + c.size]))
            at += c.size
        return np.concatenate(out)

    def _features(self, t: Chunk, own: np.ndarray | None) -> np.ndarray:
        u = _looked_up(self.arrays[0], self.arrays[1:3], t.word)
        c0, c1, lam, used0, used1 = _looked_up(self.arrays[3], self.arrays[4:], t.pair)
        c = [c0, c1]
        if own is not None:
            _, group, per = _by_word(t)
            for k in (0, 1):
                mine = own[t.text] == k
                c[k] = c[k] - mine
                u[k] = np.maximum(u[k] - mine * per[group], 0)
        return finished(_sums(t, self.ratio(u, c, lam, (used0, used1), np.log, np.maximum))[:, None])

    def score(self, features: np.ndarray) -> np.ndarray:
        mean, scale, w = self.curve
        x = np.column_stack([expand((features - mean) / scale), np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _by_word(t: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of each text: where one occurs first, which one each pair ends with, and how many pairs do."""
    return np.unique(mix64(t.word ^ t.text.astype(np.uint64), 34), return_index=True, return_inverse=True, return_counts=True)[1:]


def _sums(t: Chunk, r: np.ndarray) -> np.ndarray:
    """Of each text, by the log ratios r of its pairs: words, distinct words, sums of r and of what lies above one, the same over the
    best r of each distinct word, and the three highest of these (minus infinity where there are fewer)."""
    place, group, _ = _by_word(t)
    best = np.full(len(place), -np.inf)
    np.maximum.at(best, group, r)
    owner = t.text[place]
    order = np.lexsort((-best, owner))
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    top = np.full((t.size, 3), -np.inf)
    lead = rank < 3
    top[owner[order][lead], rank[lead]] = best[order][lead]
    total = lambda at, v: np.bincount(at, v, minlength=t.size)
    return np.column_stack(
        [t.words, np.bincount(owner, minlength=t.size), total(t.text, r * t.times), total(t.text, np.maximum(r - 1, 0) * t.times), total(owner, best), total(owner, np.maximum(best - 1, 0)), top]
    )


def finished(sums: np.ndarray) -> np.ndarray:
    """Features from the numbers of texts (texts, parts of the model, SUMS)."""
    words = sums[:, 0, 0]
    kinds, r, above, best, best_above = sums[:, :, 1:6].sum(1).T
    top = -np.sort(-sums[:, :, 6:].reshape(len(sums), -1), axis=1)[:, :3]
    n = np.maximum(words, 1)
    return np.column_stack([r / n, best / np.maximum(kinds, 1), np.where(np.isinf(top), 0, top), best_above, above / n, np.log1p(words)])


@dataclass
class Part:
    """Log ratios of the words that leave `index` modulo `parts`, and of the pairs that end with them: sorted keys and values."""

    index: int
    parts: int
    words: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]

    def sums(self, raws: list[bytes | None]) -> np.ndarray:
        out = [np.empty((0, SUMS))]
        for t in chunks_of(raws):
            if self.parts > 1:
                mine = t.word.view(np.int64) % self.parts == self.index
                t = replace(t, text=t.text[mine], word=t.word[mine], before=t.before[mine], pair=t.pair[mine], times=t.times[mine])
            r = _looked_up(self.words[0], self.words[1:], t.word)[0]
            out.append(_sums(t, _looked_up(self.pairs[0], self.pairs[1:], t.pair, r)[0]))
        return np.concatenate(out)


def _looked_up(keys: np.ndarray, values: tuple[np.ndarray, ...], wanted: np.ndarray, none: np.ndarray | float = 0.0) -> list[np.ndarray]:
    """Values at the wanted keys of sorted keys, `none` where there is none."""
    if not len(keys):
        return [np.zeros(len(wanted)) + none for _ in values]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return [np.where(hit, v[at], none) for v in values]


def expand(x: np.ndarray) -> np.ndarray:
    """Features and their products by pairs."""
    n = x.shape[1]
    return np.column_stack([x] + [x[:, i] * x[:, j] for i in range(n) for j in range(i, n)])


def fit_curve(features: np.ndarray, labels: np.ndarray, weights: np.ndarray, penalty: float = 1e-2, rounds: int = 60):
    """Weighted logistic regression by damped Newton steps."""
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack([expand((features - mean) / scale), np.ones(len(features))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (x * (weights * (p * (1 - p) + 1e-9))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(slope, x.T @ (weights * (labels - p)) - penalty * w)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def held_out(doc_id: Column) -> Column:
    """Rows no label of which may be learned: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _tables(rows: DataFrame) -> Model:
    """The model of labelled rows (text, toxic), without arrays and curve."""
    words = rows.mapInArrow(_count_words, "key long, u0 long, u1 long, p0 long, p1 long").groupBy("key")
    words = save(words.agg(*(F.sum(c).alias(c) for c in ("u0", "u1", "p0", "p1"))), "word-counts")
    pairs = rows.mapInArrow(_count_pairs, "word long, h long, c0 long, c1 long").groupBy("word", "h")
    pairs = pairs.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).filter(F.greatest("c0", "c1") > PAIR_DISCOUNT)
    pairs = save(pairs.withColumn("key", _pair_key("h", "word")), "pair-counts")
    left = lambda c, d: F.greatest(F.col(c) - d, F.lit(0))
    totals = words.agg(*(F.sum(c).alias(c) for c in ("u0", "u1")), *(F.sum(left(c, WORD_DISCOUNT)).alias(f"own{c}") for c in ("u0", "u1"))).first()
    n, own = (totals.u0, totals.u1), (totals.ownu0, totals.ownu1)
    weight = max(sum(1 - a / max(b, 1) for a, b in zip(own, n)) / 2, 1e-3)
    used = pairs.groupBy("h").agg(F.sum(left("c0", PAIR_DISCOUNT)).alias("used0"), F.sum(left("c1", PAIR_DISCOUNT)).alias("used1")).filter("used0 > 0 and used1 > 0")
    used = used.join(words.select(F.col("key").alias("h"), "p0", "p1"), "h")
    used = used.select("h", "used0", "used1", F.least(F.col("used0") / F.col("p0"), F.col("used1") / F.col("p1")).alias("lam"))
    pairs = save(pairs.join(used, "h").select("key", *(F.col(c).cast("double").alias(c) for c in ("c0", "c1", "lam", "used0", "used1")), "word"), "pair-model")
    heavy = words.filter(F.greatest("u0", "u1") > min(PAIR_DISCOUNT, WORD_DISCOUNT))
    heavy = save(heavy.select("key", *(F.col(c).cast("double").alias(c) for c in ("u0", "u1"))), "word-model")
    return Model(heavy, pairs, weight, (max(own[0], 1), max(own[1], 1)), float(max(sum(n), 1)))


def _loaded(model: Model) -> tuple[np.ndarray, ...]:
    """Sorted keys and values of both tables, on the driver; called behind a count of their rows."""
    out = []
    for df in (model.words, model.pairs.drop("word")):
        out += _sorted(df)
    return tuple(out)


def _sorted(df: DataFrame) -> list[np.ndarray]:
    t = df.toArrow()
    cols = [t.column(c).to_numpy() for c in df.columns]
    cols[0] = cols[0].view(np.uint64)
    order = np.argsort(cols[0])
    return [c[order] for c in cols]


def _ratios(model: Model) -> DataFrame:
    """word, key, paired, r of every entry of the model: the log ratio of a pair, and of a word behind one that makes no pair with it."""
    most = lambda x, y: F.greatest(x, F.lit(float(y)))
    none = F.lit(0.0)
    u = (F.col("u0"), F.col("u1"))
    alone = model.words.select(F.col("key").alias("word"), "key", F.lit(False).alias("paired"), model.ratio(u, (none, none), none, (none, none), F.ln, most).alias("r"))
    both = model.pairs.join(model.words.withColumnRenamed("key", "word"), "word", "left").na.fill(0.0)
    r = model.ratio(u, (F.col("c0"), F.col("c1")), F.col("lam"), (F.col("used0"), F.col("used1")), F.ln, most)
    return save(alone.unionByName(both.select("word", "key", F.lit(True).alias("paired"), r.alias("r"))), "log-ratios")


def _part(ratios: DataFrame, index: int, parts: int) -> Part:
    own = ratios.filter(F.pmod("word", F.lit(parts)) == index)
    return Part(index, parts, *(tuple(_sorted(own.filter(F.col("paired") == x).select("key", "r"))) for x in (False, True)))


TOKEN = "word long, pair long, n long, per long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, rid, own) to distinct pairs of each text: rid, own, word, pair, n (times), per (pairs of the text ending with the word)."""
    for b in batches:
        rid, at = b.column(1).to_numpy(), 0
        own = b.column(2).fill_null(-1).to_numpy()
        for c in chunks_of(b.column(0).cast(pa.binary()).to_pylist()):
            _, group, per = np.unique(mix64(c.word ^ c.text.astype(np.uint64), 34), return_inverse=True, return_counts=True)
            cols = [rid[at : at + c.size][c.text], own[at : at + c.size][c.text], c.word.view(np.int64), c.pair.view(np.int64), c.times, per[group]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["rid", "own", "word", "pair", "n", "per"])
            at += c.size


def joined_features(rows: DataFrame, model: Model) -> DataFrame:
    """rid, f (features) of rows (text, rid, own) that have words, by joins with the counted tables: for the sample of the fit, as
    the distinct pairs of a text take several times the room of the text.

    Frequent words make large join groups on the side of the texts only, which adaptive execution may split.
    """
    tokens = rows.select("text", "rid", "own").mapInArrow(_tokens, f"rid long, own long, {TOKEN}")
    j = tokens.join(model.pairs.drop("word").withColumnRenamed("key", "pair"), "pair", "left").join(model.words.withColumnRenamed("key", "word"), "word", "left").na.fill(0.0)
    mine = lambda k: F.when(F.col("own") == k, 1).otherwise(0)
    u = [F.greatest(F.col(f"u{k}") - mine(k) * F.col("per"), F.lit(0.0)) for k in (0, 1)]
    c = [F.col(f"c{k}") - mine(k) for k in (0, 1)]
    most = lambda x, y: F.greatest(x, F.lit(float(y)))
    r = model.ratio(u, c, F.col("lam"), (F.col("used0"), F.col("used1")), F.ln, most)
    above = lambda x: F.greatest(x - 1, F.lit(0.0))
    per = j.select("rid", "word", "n", r.alias("r")).groupBy("rid", "word").agg(
        F.max("r").alias("best"), F.sum(F.col("r") * F.col("n")).alias("s"), F.sum(above(F.col("r")) * F.col("n")).alias("a"), F.sum("n").alias("n")
    )
    top = F.slice(F.concat(F.slice(F.sort_array(F.collect_list("best"), False), 1, 3), F.array_repeat(F.lit(0.0), 3)), 1, 3)
    n = F.sum("n")
    return per.groupBy("rid").agg(
        F.concat(F.array(F.sum("s") / n, F.avg("best")), top, F.array(F.sum(above(F.col("best"))), F.sum("a") / n, F.log1p(n.cast("double")))).alias("f")
    )


def _features(box):
    @arrow_udf("array<double>")
    def features(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = box.value
        for texts, own in parts:
            x = model.features(texts.cast(pa.binary()).to_pylist(), own.to_numpy())
            yield pa.array(list(x), pa.list_(pa.float64()))

    return features


def _with_labels(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs joined to known by doc_id. Texts stay where they are: labels beyond LABEL_ROWS are broadcast in parts, each to the rows it may match."""
    parts = -(-known.count() // LABEL_ROWS)
    if parts < 2:
        return docs.join(F.broadcast(known), "doc_id")
    own = lambda df, i: df.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(parts)) == i)
    known = save(known, "labels")
    return reduce(DataFrame.unionByName, [own(docs, i).join(F.broadcast(own(known, i)), "doc_id") for i in range(parts)])


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_broadcast: int = MODEL_ROWS) -> Model | float:
    """The model of all labelled rows that are not held out; a bare share of toxic texts if a class is missing."""
    spark = docs.sparkSession
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    rows = _with_labels(docs.select("doc_id", "text"), known).select("text", "toxic", "doc_id")
    total, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not toxic or toxic == total:
        return toxic / total if toxic else 0.0
    model = _tables(rows.select("text", "toxic"))
    share = [min(1.0, fit_rows / 2 / n) for n in (total - toxic, toxic)]
    dice = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    sample = rows.filter(dice < F.when(F.col("toxic") == 1, int(1e6 * share[1])).otherwise(int(1e6 * share[0])))
    if small_enough(model.words.select("key").unionByName(model.pairs.select("key")), max_broadcast):
        model.arrays = _loaded(model)
        fitted = sample.select(_features(spark.sparkContext.broadcast(model))("text", "toxic").alias("f"), "toxic").toPandas()
    else:
        sample = save(sample.select("text", F.col("toxic").alias("own"), F.monotonically_increasing_id().alias("rid")), "fit-sample")
        found = sample.select("rid", "own").join(joined_features(sample, model), "rid", "left")
        fitted = found.select(F.coalesce("f", F.array_repeat(F.lit(0.0), FEATURES)).alias("f"), F.col("own").alias("toxic")).toPandas()
    y = fitted["toxic"].to_numpy(float)
    model.curve = fit_curve(np.array(fitted["f"].tolist()).reshape(-1, FEATURES), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def _digest(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def _part_sums(box):
    @arrow_udf("array<double>")
    def sums(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        part = box.value
        for texts in parts:
            yield pa.array(list(part.sums(texts.cast(pa.binary()).to_pylist())), pa.list_(pa.float64()))

    return sums


def _scores(docs: DataFrame, labels: DataFrame, fit_rows: int, max_broadcast: int, part_rows: int) -> Column | DataFrame:
    """The score of a row of docs as a column of its text or, where the model takes several parts, as a table (digest, score) of the distinct texts."""
    model = train(docs, labels, fit_rows, max_broadcast)
    if isinstance(model, float):
        return F.lit(model)
    sc = docs.sparkSession.sparkContext
    part = None
    if model.arrays is None:
        ratios = _ratios(model)
        parts = max(1, -(-ratios.count() // part_rows))
        if parts > 1:
            return _scores_by_parts(docs, ratios, parts, model)
        part = _part(ratios, 0, 1)
    box = sc.broadcast((model, part))

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, part = box.value
        for cells in batches:
            raws = cells.cast(pa.binary()).to_pylist()
            yield pa.array(model.score(model.features(raws) if part is None else finished(part.sums(raws)[:, None])), pa.float64())

    return score(F.coalesce("text", F.lit("")))


def _scores_by_parts(docs: DataFrame, ratios: DataFrame, parts: int, model: Model) -> DataFrame:
    """digest, score of the distinct texts, one part of the model in memory at a time."""
    sc = docs.sparkSession.sparkContext
    text = F.coalesce("text", F.lit(""))
    found = []
    for i in range(parts):
        box = sc.broadcast(_part(ratios, i, parts))
        found.append(save(docs.select(_digest(F.col("text")).alias("digest"), _part_sums(box)(text).alias("s")), "text-sums").withColumn("part", F.lit(i)))
        box.destroy()
    found = reduce(DataFrame.unionByName, found)
    # A text that is there twice has the same numbers twice but for their last digits.
    found = found.groupBy("digest").agg(F.array(*(F.min(F.when(F.col("part") == i, F.col("s"))) for i in range(parts))).alias("s"))
    box = sc.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = box.value
        for cells in batches:
            yield pa.array(model.score(finished(cells.flatten().flatten().to_numpy().reshape(-1, parts, SUMS))), pa.float64())

    return save(found.select("digest", score("s").alias("score")), "text-scores")


def toxicity(docs: DataFrame, labels: DataFrame, max_broadcast: int = MODEL_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    how = _scores(docs, labels, FIT_ROWS, max_broadcast, part_rows)
    if isinstance(how, DataFrame):
        out = salted_join(save(docs.select("doc_id", _digest(docs["text"]).alias("digest")), "text-digests"), how, "digest")
    else:
        out = docs.select("doc_id", how.alias("score"))
    out = out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= REJECT_AT, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame, max_broadcast: int = MODEL_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """The rows of docs that score below REJECT_AT, with the columns of docs."""
    how = _scores(docs, labels, FIT_ROWS, max_broadcast, part_rows)
    if isinstance(how, Column):
        return docs.filter(how < REJECT_AT)
    rejected = maybe_broadcast(how.filter(F.col("score") >= REJECT_AT).select(F.col("digest").alias("rejected")), 2_000_000)
    return docs.join(rejected, _digest(docs["text"]) == rejected["rejected"], "left_anti")
