"""Payloads for sinks outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kafka_payload(events: DataFrame, key: str) -> DataFrame:
    """``key`` and ``value`` as the Kafka writer takes them."""
    return events.select(F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*events.columns)).cast("binary").alias("value"))


def append_audit(rows: DataFrame, path: str) -> None:
    """Add rows to an audit table; nothing there is ever changed."""
    rows.write.mode("append").parquet(path)


def finish_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replace the partitions of a table that ``rows`` has, each as a whole; the others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def deliver_once(batch: DataFrame, path: str, key: str) -> int:
    """Append the rows of ``batch`` whose key is not yet in the table at ``path``; how many were new.

    For ``foreachBatch``: a batch that is run again adds nothing.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates([key])
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        rows = rows.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti").select(*batch.columns)
    rows = rows.persist()
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    rows.unpersist()
    return n
