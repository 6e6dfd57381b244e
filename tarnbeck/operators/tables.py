"""Keyed tables without in-place updates: upserts, first-wins inserts, deletes, chunk stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_latest(changes: DataFrame, key: str, version: list[str], fixed: list[str], changing: list[str]) -> DataFrame:
    """One row per key: ``fixed`` columns from its first change, ``changing`` ones from its last."""
    v = F.struct(*version)
    return changes.groupBy(key).agg(*[F.min_by(c, v).alias(c) for c in fixed], *[F.max_by(c, v).alias(c) for c in changing])


def first_wins(rows: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """Insert-or-ignore: of rows with one key, the first to arrive (aggregated map-side)."""
    rest = [c for c in rows.columns if c != key]
    g = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("_r"))
    return g.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Delete by key: the rows whose key is not in ``gone``."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def chunk_writes(chunks: DataFrame, keys: list[str], body: Column, arrival: list[str]) -> DataFrame:
    """``keys, checksum, n_writes, conflict``: what an idempotent store holds after all writes.

    The first write of a key stays; a repeat of it is no change; other bytes under the key conflict.
    """
    sums = chunks.withColumn("checksum", F.sha2(body, 256))
    return sums.groupBy(*keys).agg(F.min_by("checksum", F.struct(*arrival)).alias("checksum"), F.count("*").alias("n_writes"), (F.min("checksum") != F.max("checksum")).alias("conflict"))
