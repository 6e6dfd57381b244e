"""File round trips, lenient JSON lines, binary files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    All paths of an application lie in one folder, which is deleted when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/tarnbeck"
    root = f"{base.rstrip('/')}/run-{spark.sparkContext.applicationId}"
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def through_files(df: DataFrame, kind: str, **options) -> DataFrame:
    """``df`` written in a format and read back under its own schema."""
    path = scratch(df.sparkSession, kind)
    df.write.options(**options).format(kind).save(path)
    return df.sparkSession.read.schema(df.schema).options(**options).format(kind).load(path)


def lenient_jsonl(lines: DataFrame, schema: str, category: str | Column) -> DataFrame:
    """Objects from lines (``value``) that may be fenced, indented, or end in a comma.

    Lines that are no object, cannot be parsed, or have no text or a label other than 0 and 1 are
    dropped; a missing category is the given one.
    """
    line = F.regexp_replace(F.trim("value"), r",\s*$", "")
    rows = lines.select(line.alias("value")).where(F.col("value").startswith("{"))
    rows = rows.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    default = F.lit(category) if isinstance(category, str) else category
    return rows.where("text is not null and text <> '' and label in (0, 1)").withColumn("category", F.coalesce("category", default))


def binary_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``category, stem, length, content`` of the files below a folder whose names match."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("category"), F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), "length", "content")


def pages_as_binary(pages: DataFrame) -> DataFrame:
    """Pages kept as binary parts (one column of bytes) and scanned back: ``page_id, length, digest``."""
    stored = through_files(pages.select("page_id", F.encode("html", "utf-8").alias("content")), "parquet")
    return stored.select("page_id", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("digest"))
