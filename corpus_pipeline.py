"""Corpus pipeline over ``documents``: language, repeated lines, near-duplicates, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.

Null texts and texts without a letter go in the first stage, so no later one meets them.  Null ids are
ids like any other to the first, second and fourth stage; the third links no row without an id and keeps it.
Rows that share an id are rows of their own, each with its own text.  Very long texts are worked on alone and
as a whole.  Other columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.llm.common import passing, work_path
from tarnbeck.llm.decontaminate import without_leaks
from tarnbeck.llm.jaccard import first_of_groups, text_key
from tarnbeck.llm.language_id import UNKNOWN, identify, train
from tarnbeck.llm.line_dedup import dedup_lines
from tarnbeck.llm.pieces import encode

LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6.  Documents without a letter, or that no language codes clearly shortest, go.

    Where nothing can be learnt (no labelled text), every document goes.
    """
    trees = train(docs.select("doc_id", "text", "lang").where("not coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"))
    kept = identify(docs, trees).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4.  Lines that an earlier line matches go, short ones when they have the same words; a
    document that loses all its words goes too, and so does every exact copy of an earlier one.  Of rows with
    equal id and text, which lose no line to each other, the third stage keeps each."""
    lean = dedup_lines(docs, short=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return lean.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10.  Of each component of near copies the row with the smallest id stays (of one id, the smallest text
    hash; rows equal in id and text stay together), and so do rows without an id.  A text that resembles no other stays."""
    first = first_of_groups(docs)
    same = (docs["doc_id"].cast("long") == first["doc_id"]) & (text_key(docs["doc_id"], docs["text"]) == first["key"])
    return docs.where("doc_id is not null").join(first, same, "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2.  Documents that hold a benchmark item, or one asked again with other values, go."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8.  ``doc_id, lang, source, n_pieces, score, ids, round_trip`` of each whole text."""
    out = encode(docs.select("doc_id", "lang", "source", "text"), n=3)
    return out.select("doc_id", "lang", "source", "n_pieces", "score", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", keep_one_of_near_copies),
    ("decontamination", remove_leaks),
    ("sentencepiece", to_pieces),
]
#: The language model, the edit distances and the piece lattice are beyond SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made, path = stage(spark, docs, sf_dir), work_path(spark, name)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(passing(spark, path))
    return STAGES[-1][1](spark, docs, sf_dir)
