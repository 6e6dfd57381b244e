"""The queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment_digests
from .compaction import OP7_SQL, TARGET_BYTES, compact_arrivals
from .decontaminate import find_leaks
from .jaccard import jaccard_components
from .language_id import language_scores
from .line_dedup import duplicate_lines
from .pieces import encode
from .prefix_trie import OP11_SQL, conversation_trie
from .quality_qda import quality_scores
from .quality_rules import quality_rules
from .quoting import NESTED_SQL, OP5_SQL, link_quotes, nested_quotes
from .token_files import token_files
from .warc import OP1_SQL, archive_and_read_back


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, found through the index, and read back."""
    return archive_and_read_back(_table(spark, sf_dir, "pages"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it leaks."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line that goes, with the earlier line that it repeats."""
    return duplicate_lines(_table(spark, sf_dir, "documents"), short=True)


def op5_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its parent and its text without quotes."""
    return link_quotes(_table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op5, over the conversations with earlier turns quoted in them at two levels (the table itself has no quotes)."""
    return link_quotes(nested_quotes(_table(spark, sf_dir, "conversations")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(_table(spark, sf_dir, "documents"))


def op7_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as it is read back once all arrivals are appended and compacted, and whether its shard is as it should be."""
    rows = compact_arrivals(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", F.sha1("text").alias("text_sha1"), "lang", "source", "n_chars",
        F.coalesce(F.col("doc_id").between(F.col("shard_min_id"), F.col("shard_max_id")), F.lit(True)).alias("id_in_range"),
        ((F.col("shard_bytes") <= TARGET_BYTES * 3 // 2) | (F.col("shard_rows") == 1)).alias("shard_fits"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every document (a digest of the ids of each), and whether they decode to the text."""
    out = encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, with_ids=False)
    digest = [F.get("nbest_sha1", F.lit(k)).alias(f"ids_sha1_{k + 1}") for k in range(3)]
    return out.select("doc_id", "n_pieces", "score", F.get("losses", F.lit(0)).alias("loss_2"), F.get("losses", F.lit(1)).alias("loss_3"), *digest, "round_trip")


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of the rebuilt conversations."""
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and read back."""
    return token_files(_table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document."""
    return alignment_digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_index, op2_template_decontamination, op3_quality_rules, op4_line_dedup, op5_quote_linking, op6_language_id, op7_compaction, op8_sentencepiece, op9_quality_qda, op10_ngram_jaccard, op11_prefix_trie, op12_token_files, op13_tokenizer_alignment, quoted_conversations, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op5_quote_linking": OP5_SQL, "op7_compaction": OP7_SQL, "op11_prefix_trie": OP11_SQL, "quoted_conversations": NESTED_SQL}
