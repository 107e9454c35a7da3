"""Site-relative line dedup, in DataFrame functions only.

Lines are compared after trimming blanks and tabs; blank lines are never boilerplate. A page is one distinct text of a site, and
pages count for a line once for each company it is in: the least digest of the page's other lines. Copies and near copies of a page have the
same one, so they are no evidence against the lines they share, however many they are. A line is boilerplate on a site when
the pages that count for it exceed `ratio` of the site's pages and are at least `min_pages`. Boilerplate lines
are dropped from every text of that site; the other lines keep their order and bytes.

Per page each line is reduced to a 128-bit digest once, so shuffles carry digests and counts only, and counts are
combined before the shuffle; a hot line or site is no hot task. The boilerplate of one site is an array: it holds at
most (lines of a page) / ratio digests. It meets the documents by site, broadcast only when its counted
size allows.

Defined results: a null text stays null; an empty one stays empty. Null sites form one site of their own. Repeated
rows are all returned. A text whose lines are all dropped becomes empty. Empty tables give empty results. All columns
of the input are returned as they were (but the text); names clash with nothing, as internal columns live in structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._common import save, small_enough

RATIO = 0.07
MIN_PAGES = 3


def _site(name: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("null"))


def _digest(line) -> F.Column:
    return F.unhex(F.md5(F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "").cast("binary")))


BLANK = "unhex('d41d8cd98f00b204e9800998ecf8427e')"


def boilerplate_lines(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site_key, digest, n_pages, site_pages of each boilerplate line."""
    digests = F.array_sort(F.array_distinct(F.transform(F.split("text", "\n"), _digest)))
    pages = docs.filter(F.col("text").isNotNull()).select(
        _site(site).alias("site_key"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("page"), F.filter(digests, lambda d: d != F.expr(BLANK)).alias("digests")
    )
    least = [F.coalesce(F.try_element_at("digests", F.lit(i)), F.expr(BLANK)) for i in (1, 2)]
    lines = pages.select("site_key", least[0].alias("m1"), least[1].alias("m2"), F.explode("digests").alias("digest"))
    company = F.when(F.col("digest") == F.col("m1"), F.col("m2")).otherwise(F.col("m1"))
    counts = lines.groupBy("site_key", "digest").agg(F.count_distinct(company).alias("n_pages"))
    totals = pages.groupBy("site_key").agg(F.count_distinct("page").alias("site_pages"))
    counts = counts.filter(F.col("n_pages") >= min_pages)
    return counts.join(totals, "site_key").filter(F.col("n_pages") > F.lit(ratio) * F.col("site_pages"))


def drop_boilerplate(
    docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, max_broadcast: int = 200_000
) -> DataFrame:
    """struct column `row` (the input row) and `text`, `n_lines`, `n_dropped` beside it."""
    found = save(boilerplate_lines(docs, site, ratio, min_pages).select("site_key", "digest"), "boilerplate")
    lists = found.groupBy("site_key").agg(F.collect_list("digest").alias("drops"))
    if small_enough(found, max_broadcast):
        lists = F.broadcast(lists)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _site(site).alias("key"))
    joined = rows.join(lists, F.col("key") == F.col("site_key"), "left")
    lines = F.split(F.col("row.text"), "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("drops"), _digest(x)))
    joined = joined.select("row", lines.alias("lines"), F.when(F.col("drops").isNull(), lines).otherwise(kept).alias("left"))
    return joined.select(
        "row",
        F.array_join("left", "\n").alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup(docs: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines dropped from `text` and n_chars (where present) counted anew; same columns."""
    out = drop_boilerplate(docs, site, ratio, min_pages)
    new = {"text": F.col("text"), "n_chars": F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))}
    new["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("row.n_chars")).otherwise(new["n_chars"]) if "n_chars" in docs.columns else None
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
