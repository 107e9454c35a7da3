"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and international phone numbers. They are the seeds. Around
each seed, and around every other identifier-like token, lexical contexts are read: the two words before it, and the
word before with the word after. Contexts and instances form a bipartite graph, which Spark scores in rounds: a context
scores, for a kind, the mean belief that its distinct instances are of that kind, damped by small support; an unknown instance is
believed as much as its best context. Rounds go on until scores settle. Contexts with MIN_SUPPORT distinct seeds and a score of at least MIN_SCORE mark the unseen
identifiers within them, as further spans of that kind. Base spans always stay; added spans overlap no base span.

One pass reads the texts; the graph holds only identifiers and contexts, aggregated to distinct pairs before each
join, so a context shared by very many rows is one edge for each distinct instance.

Defined results: null counts as empty; empty texts have no spans. Rows are processed each, repeated rows alike. Offsets are code
points of the original text, end exclusive. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import maybe_broadcast, save, small_enough

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
MIN_SCORE = 0.8
#: Scores count as settled when none moves by more; they rise from round to round and are at most 1, so they do settle.
SETTLED = 1e-3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Runs of digits are tried from their first digit only: a match from inside a run would also be one from its start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9@._+-]*[0-9@][A-Za-z0-9@._+-]*")
_GROUPS = re.compile(r"\(?[0-9]{2,}\)?(?:[ ./-]?\(?[0-9]{2,}\)?)+")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, walked from sign to sign so that long words cost nothing more."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            yield start, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) < 4 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def _words_before(text: str, at: int, n: int) -> list[str]:
    """The last n whole words before a place, however long."""
    out: list[str] = []
    while at and len(out) < n:
        end = at
        while end and text[end - 1].isspace():
            end -= 1
        at = end
        while at and not text[at - 1].isspace():
            at -= 1
        if at < end:
            out.insert(0, text[at:end])
    return out


def contexts(text: str, start: int, end: int) -> tuple[str, str]:
    """The two lexical contexts of a span: two words before it; one before and one after. Figures are masked; long words are named by a digest."""
    before, m = _words_before(text, start, 2), _WORD.search(text, end)
    after = [m[0]] if m else []

    def mask(w: str) -> str:
        w = "#" if any(c.isdigit() or c == "@" for c in w) else w.lower()
        return w if len(w) <= 64 else hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()

    before, after = [mask(w) for w in before], [mask(w) for w in after]
    return "2 " + " ".join(before), "1 " + " ".join([*before[-1:], "_", *after])


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What may be an unseen identifier: tokens and runs of digit groups (joined by one blank, hyphen, point, slash or bracket) of seven characters
    or more, with four figures or a sign in between, that meet no base span. Of overlapping ones the longer, then the earlier."""
    found = []
    for m in chain(_TOKEN.finditer(text), _GROUPS.finditer(text)):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] in ".-_+":
            b -= 1
        if b - a >= 7 and (sum(c.isdigit() for c in text[a:b]) >= 4 or "@" in text[a + 1 : b - 1]):
            found.append((a, b))
    starts, ends = [s for _, s, _ in taken], list(accumulate((e for _, _, e in taken), max))
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(found), key=lambda s: (s[0], -s[1])):
        k = bisect_left(starts, b)
        if k and ends[k - 1] > a:
            continue
        if not out or out[-1][1] <= a:
            out.append((a, b))
        elif b - a > out[-1][1] - out[-1][0]:
            out[-1] = (a, b)
    return out


MENTION = "struct<kind:string,start:long,end:long,value:string,before:string,around:string>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("before", pa.string()), ("around", pa.string())]))


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column(1).to_pylist():
            own = []
            if text and ("@" in text or _DIGIT.search(text)):
                base = base_spans(text)
                found = base + [("", *c) for c in candidates(text, base)]
                for kind, s, e in found:
                    before, around = contexts(text, s, e)
                    own.append({"kind": kind, "start": s, "end": e, "value": text[s:e], "before": before, "around": around})
            out.append(own)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, _TYPE)], names=["doc_id", "found"])


def _graph(mentions: DataFrame) -> DataFrame:
    """Distinct (context, value, kind) edges; kind is empty for instances that no base pattern knows."""
    return mentions.select(
        F.explode(F.array("before", "around")).alias("context"), "value", "kind"
    ).groupBy("context", "value").agg(F.max("kind").alias("kind"))


def score_contexts(edges: DataFrame) -> DataFrame:
    """context, kind, score, support after rounds of mutual scoring, until scores settle. edges as of _graph().

    A context scores, for a kind, the mean belief of its distinct instances, damped by 1 - 1 / (3 * support): three seeds
    alone score 8/9, three seeds with three unknown instances settle at 0.8. Beliefs only rise and stay below 1, so rounds end.
    """
    edges = save(edges, "contexts")
    total = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("kind != ''")).alias("seeds"))
    total = save(total.filter(F.col("seeds") >= MIN_SUPPORT), "context-sizes")
    live = save(edges.join(maybe_broadcast(total, 500_000), "context"), "live-contexts")
    seeds = live.filter("kind != ''").groupBy("context", "n", "kind").agg(F.count(F.lit(1)).alias("support"))
    seeds = save(seeds, "seed-counts")
    damped = lambda mass: mass / F.col("n") * (1 - 1 / (3 * F.col("support")))
    scores = save(seeds.select("context", "kind", "support", "n", damped(F.col("support")).alias("score")), "context-scores")
    unknown = live.filter("kind = ''").select("context", "value")
    if small_enough(unknown, 0):
        return scores
    unknown = save(unknown, "unknown-instances")
    while True:
        belief = unknown.join(maybe_broadcast(scores, 500_000), "context").groupBy("value", "kind").agg(F.max("score").alias("belief"))
        mass = unknown.join(belief, "value").groupBy("context", "kind").agg(F.sum("belief").alias("more"))
        new = scores.join(mass, ["context", "kind"], "left").select(
            "context", "kind", "support", "n", damped(F.col("support") + F.coalesce("more", F.lit(0.0))).alias("new"), "score"
        )
        new = save(new, "context-scores")
        scores = new.select("context", "kind", "support", "n", F.col("new").alias("score"))
        if small_enough(new.filter(F.abs(F.col("new") - F.col("score")) > SETTLED), 0):
            return scores


def find_personal_data(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Per row of docs: doc_id, base and spans (arrays of start, rank of the kind in KINDS, end), spans with the added ones."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_mentions, f"doc_id {kind}, found array<{MENTION}>")
    found = save(found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "found"), "mentions")
    mentions = found.select("rid", F.explode("found").alias("m")).select("rid", "m.*")
    strong = score_contexts(_graph(mentions)).filter((F.col("score") >= min_score) & (F.col("support") >= MIN_SUPPORT))
    strong = save(strong.groupBy("context").agg(F.max(F.struct("score", "kind")).alias("best")), "strong-contexts")
    rank = lambda k: F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), k), F.lit(0))
    span = lambda m, k: F.struct(m["start"].alias("start"), rank(k).alias("kind"), m["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("found", lambda m: m["kind"] != ""), lambda m: span(m, m["kind"])))
    rows = found.select("rid", "doc_id", base.alias("base"))
    none = F.array().cast("array<struct<start:bigint,kind:bigint,end:bigint>>")
    if small_enough(strong, 0):
        return rows.select("doc_id", "base", F.col("base").alias("spans"))
    unseen = mentions.filter("kind = ''").withColumn("context", F.explode(F.array("before", "around")))
    hits = unseen.join(maybe_broadcast(strong, 500_000), "context").groupBy("rid", "start", "end").agg(F.max("best").alias("best"))
    added = hits.groupBy("rid").agg(F.collect_list(F.struct("start", rank(F.col("best.kind")).alias("kind"), "end")).alias("added"))
    return rows.join(added, "rid", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("spans")
    )


def digest(spans) -> F.Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
