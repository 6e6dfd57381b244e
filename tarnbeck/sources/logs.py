"""Run logs: blocks between rule lines, read with patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_LINE = "=" * 100


def parse_blocks(texts: DataFrame, column: str = "text") -> DataFrame:
    """``clip, path, heard, decision``: the transcripts of each block with the decision on the next line.

    A block counts if one of its marker lines is there; its first line names the clip.  Rows of single
    sentences (their decision says so) are left out.  A transcript stands in single quotes, or in double
    ones where it has an apostrophe; a quote after a backslash is part of it.
    """
    blocks = texts.select(F.explode(F.split(column, RULE_LINE)).alias("b")).select(F.trim(F.regexp_replace("b", r"^\s+|\s+$", "")).alias("b"))
    blocks = blocks.where(F.col("b").rlike(r"(?m)^\s*(expected:|RESULT:|heard)")).withColumn("clip", F.trim(F.regexp_extract("b", r"^([^\n]*)", 1)))
    pattern = r"""(?m)^\s+heard(?: \[(\w+)\])?: (['"])([^\n]*)\2\n\s*(?:->\s*)?([^\n]*)"""
    found = F.arrays_zip(*[F.regexp_extract_all("b", F.lit(pattern), F.lit(k)).alias(n) for k, n in ((1, "p"), (3, "h"), (4, "d"))])
    rows = blocks.select("clip", F.explode(found).alias("x"))
    path = F.when(F.col("x.p") == "", "whisper").otherwise(F.col("x.p"))
    return rows.where(~F.col("x.d").contains("/sentence")).select("clip", path.alias("path"), F.regexp_replace("x.h", r"""\\(['"\\])""", "$1").alias("heard"), F.trim("x.d").alias("decision"))
