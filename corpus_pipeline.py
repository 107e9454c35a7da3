"""The corpus pipeline: five of the training-data operators in turn, each on all that its predecessor kept.

Defined results: rows with a null text or null doc_id stay in every stage (they score as an empty text, have no lines, no set and no words),
and have null ids at the end. Of repeated rows with the kept doc_id all stay. Other columns of documents pass through all stages but the last,
whatever their names. An empty table gives an empty result; without labels or benchmark items those stages keep every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm._common import bound_batches, read_table, save
from marlstone.llm.decontaminate import drop_contaminated
from marlstone.llm.line_dedup import line_dedup
from marlstone.llm.minhash_dedup import drop_near_duplicates
from marlstone.llm.queries import VOCABULARY
from marlstone.llm.sentencepiece_codec import Codec, encode_documents
from marlstone.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic (0.7 or more) go."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; every document stays."""
    return line_dedup(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays (five words, similarity 0.8)."""
    bound_batches(spark)
    return drop_near_duplicates(docs, 4, 5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    bound_batches(spark)
    return encode_documents(docs, Codec.load(VOCABULARY))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: Model scores and signatures are not for SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
