"""The registered queries of the numbered operators, over whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import read_table
from .chat_format import format_chats, loss_text, parse
from .decontaminate import find_contamination, judge
from .exact_dedup import exact_dedup
from .html_extract import extract_main_text
from .line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from .minhash_dedup import near_duplicates
from .pii import digest, find_personal_data
from .sentencepiece_codec import Codec, encode_documents
from .substring_dedup import repeated_passages
from .toxicity import toxicity

#: Default place of the public vocabulary; a parameter of the functions below.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(n) AS text_sha256, CAST(strlen(n) AS BIGINT) AS n_bytes
FROM t WINDOW w AS (PARTITION BY n)
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(read_table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP3_SQL = rf"""
WITH pages AS (SELECT doc_id, coalesce('=' || source, 'null') AS site, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT site, count(DISTINCT text) AS n FROM pages GROUP BY site),
bare AS (SELECT DISTINCT site, text, list_filter(list_sort(list_distinct(list_transform(ls, lambda x: md5(regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g'))))), lambda x: x <> md5('')) AS ds FROM pages WHERE text IS NOT NULL),
met AS (SELECT site, ds[1] AS m1, coalesce(ds[2], md5('')) AS m2, unnest(ds) AS line FROM bare),
hot AS (SELECT site, line FROM met JOIN totals USING (site) GROUP BY site, line, n
        HAVING count(DISTINCT CASE WHEN line = m1 THEN m2 ELSE m1 END) >= {MIN_PAGES} AND count(DISTINCT CASE WHEN line = m1 THEN m2 ELSE m1 END) > {RATIO} * n),
drops AS (SELECT site, list(line) AS d FROM hot GROUP BY site),
done AS (SELECT doc_id, ls, CASE WHEN d IS NULL THEN ls ELSE
         list_filter(ls, lambda x: NOT list_contains(d, md5(regexp_replace(x, '^[ \t\r]+|[ \t\r]+$', '', 'g')))) END AS k
         FROM pages LEFT JOIN drops USING (site))
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(k), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string(k, chr(10)), '')) AS text_sha256
FROM done
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", ids, "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
wins AS (SELECT item_id, CASE WHEN len(w) < 13 THEN len(w) ELSE 13 END AS n, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' ')) END) AS s FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM spots),
hits AS (SELECT doc_id, g.n, i, item_id FROM grams g JOIN wins USING (n, s)),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), 85, 100)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = format_chats(table.unionByName(probe)).select(
        "conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(16 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&nl;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), Codec.load(vocabulary))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        n(1).alias("n_email"),
        n(2).alias("n_ip"),
        n(3).alias("n_card"),
        n(4).alias("n_phone"),
        F.sha2(digest("base").cast("binary"), 256).alias("base_sha256"),
        digest("spans").alias("spans"),
    )


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_html_extract": op6_html_extract,
    "op7_chat_format": op7_chat_format,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_pii": op9_pii,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op7_chat_format": OP7_SQL}
