"""Ordered analytics: gaps, runs, episodes, chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RULES


def episodes(alerts: DataFrame, keys: list[str], at: str, order: list[str], gap_s: float = RULES.episode_gap_s) -> DataFrame:
    """``episode``: numbered from 1; a new one starts when the gap to the alert before is ``gap_s`` or more."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) >= gap_s, F.lit(True))
    return alerts.withColumn("_new", new.cast("long")).withColumn("episode", F.sum("_new").over(w)).drop("_new")


def runs(rows: DataFrame, keys: list[str], order: list[str], label: Column) -> DataFrame:
    """``run``: numbered from 1 within the keys; consecutive rows with an equal label share one (null equals null)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_label", label)
    before = F.lag(F.struct("_label")).over(w)
    new = F.when(before.isNull() | ~before["_label"].eqNullSafe(F.col("_label")), 1).otherwise(0)
    return rows.withColumn("_new", new.cast("long")).withColumn("run", F.sum("_new").over(w)).drop("_new", "_label")


def missing_seqs(chunks: DataFrame, key: str, seq: str) -> DataFrame:
    """``key, seq`` of every number between a key's least and greatest that it lacks: those between a number
    and the next one there is."""
    after = F.lead(seq).over(Window.partitionBy(key).orderBy(seq))
    gaps = chunks.select(key, seq).where(F.col(seq).isNotNull()).distinct().withColumn("_next", after).where(F.col("_next") - F.col(seq) > 1)
    return gaps.select(key, F.explode(F.sequence(F.col(seq) + 1, F.col("_next") - 1)).alias(seq))


def contiguous_prefix(chunks: DataFrame, key: str, seq: str, first: int) -> DataFrame:
    """``key, n_prefix``: how many of first, first + 1, ... a key has without a gap."""
    w = Window.partitionBy(key).orderBy(seq)
    inside = chunks.select(key, seq).where(F.col(seq) >= first).distinct().withColumn("_n", F.row_number().over(w))
    kept = inside.groupBy(key).agg(F.count_if(F.col(seq) == F.col("_n") + (first - 1)).alias("n_prefix"))
    return chunks.select(key).distinct().join(kept, key, "left").select(key, F.coalesce("n_prefix", F.lit(0)).alias("n_prefix"))


def first_per(rows: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def confirmation_streak(checks: DataFrame, keys: list[str], order: list[str], value: str, current: str, times: int = 3) -> DataFrame:
    """``streak`` and ``switches``: a candidate other than the current value switches when it was seen
    ``times`` times in a row; a check that agrees with the current value starts over."""
    candidate = F.when(F.col(value) != F.col(current), F.col(value))
    rows = runs(checks, keys, order, candidate)
    w = Window.partitionBy(*keys, "run").orderBy(*order)
    streak = F.when(candidate.isNotNull(), F.row_number().over(w)).otherwise(0)
    return rows.withColumn("streak", streak.cast("long")).withColumn("switches", F.col("streak") == times).drop("run")


def rank_split(rows: DataFrame, groups: list[str], key: Column, share: float = 0.15, least: int = 3) -> DataFrame:
    """``split``: the first ``max(1, round(share * n))`` by md5 of the key are test, the next so many dev."""
    w = Window.partitionBy(*groups)
    n = F.count("*").over(w)
    size = F.when(n >= least, F.greatest(F.lit(1), F.bround(n * share, 0).cast("int"))).otherwise(0)
    k = F.row_number().over(w.orderBy(F.md5(key), key))
    return rows.withColumn("split", F.when(k <= size, "test").when(k <= 2 * size, "dev").otherwise("train"))


def rate_limit(requests: DataFrame, key: str, at: str, most: int, window_s: float) -> DataFrame:
    """``allowed``: a fixed window per key that starts anew with the first request after it has run out.

    Each window's start depends on the one before, so a key's requests are folded in order (sorted by
    Spark, taken in batches; the state carried is two numbers).
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: tuple = (None, 0.0, 0)
        for b in batches:
            out = []
            for k, t in zip(b[key], b[at], strict=True):
                name, start, n = state
                if name != k or t - start > window_s:
                    start, n = t, 0
                state = (k, start, n + 1)
                out.append(n + 1 <= most)
            yield b.assign(allowed=out)

    order = [c for c in requests.columns if c not in (key, at)]  # equal times: by the other columns
    ordered = requests.repartition(F.col(key)).sortWithinPartitions(key, at, *order)
    return ordered.mapInPandas(fold, f"{', '.join(f'{n} {t}' for n, t in requests.dtypes)}, allowed boolean")


class _Tiles:
    """Segments over runs of speech frames that come in order; what it keeps is one open segment.

    A segment takes the speech from its first frame on until a pause of more than ``post`` frames or, at
    the latest, until it has ``most`` frames, and ``post`` frames more.  The next one begins with the first
    speech after that.
    """

    def __init__(self, pre: int, post: int, most: int):
        self.pre, self.post, self.most = pre, post, most
        self.speech = self.last = None
        self.floor = self.end = 0

    def add(self, a: int, b: int):
        """Speech in frames a to b (exclusive); yields the segments that this ends, as [start, end)."""
        while True:
            if self.speech is not None and a > self.last + self.post:
                yield self.close()
            if self.speech is None:
                a = max(a, self.end)
                if a >= b:
                    return
                self.speech, self.last = a, a
            limit = self.speech + self.most
            if b <= limit:
                self.last = b - 1
                return
            self.last = max(self.last, limit - 1) if a < limit else self.last
            yield self.close()

    def close(self) -> tuple[int, int]:
        start = max(0, self.speech - self.pre, self.floor)
        self.end = self.last + 1 + self.post
        # padding may reach back into a segment that was cut, not into one that ended by itself
        self.floor = 0 if self.speech + self.most <= self.last + self.post else self.end
        self.speech = None
        return start, self.end


def speech_runs(frames: DataFrame, key: str, index: str, flag: str) -> DataFrame:
    """``key, a, b``: speech frames without a gap, as [a, b)."""
    speech = frames.where(flag).select(key, F.col(index).cast("long").alias("_at"))
    run = F.col("_at") - F.row_number().over(Window.partitionBy(key).orderBy("_at"))
    return speech.withColumn("_run", run).groupBy(key, "_run").agg(F.min("_at").alias("a"), (F.max("_at") + 1).alias("b")).drop("_run")


def vad_segments(frames: DataFrame, key: str, index: str, flag: str, pre: int, post: int, most: int) -> DataFrame:
    """``key, start_frame, end_frame`` per segment: speech with ``pre`` frames before and ``post`` after it, joined
    over shorter pauses and cut after ``most`` frames (see ``_Tiles``), inside the stream's frames.

    The runs of speech of a stream pass in order, so no stream is held as a whole.
    """
    kind = dict(frames.dtypes)[key]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiles, of, out = None, None, []
        for batch in batches:
            for k, a, b in zip(batch[key].tolist(), batch["a"].tolist(), batch["b"].tolist(), strict=True):
                if tiles is None or k != of:
                    out += [(of, *tiles.close())] if tiles is not None and tiles.speech is not None else []
                    tiles, of = _Tiles(pre, post, most), k
                out += [(k, *x) for x in tiles.add(a, b)]
            yield pd.DataFrame(out, columns=[key, "start_frame", "end_frame"])
            out = []
        if tiles is not None and tiles.speech is not None:
            yield pd.DataFrame([(of, *tiles.close())], columns=[key, "start_frame", "end_frame"])

    runs_in_order = speech_runs(frames, key, index, flag).repartition(F.col(key)).sortWithinPartitions(key, "a")
    found = runs_in_order.mapInPandas(fold, f"{key} {kind}, start_frame long, end_frame long")
    length = frames.groupBy(key).agg((F.max(index) + 1).cast("long").alias("_n"))
    return found.join(length, key).select(key, "start_frame", F.least("end_frame", "_n").alias("end_frame"))


def vad_islands(frames: DataFrame, key: str, index: str, flag: str, post: int) -> DataFrame:
    """As ``vad_segments`` without padding and cap: runs of speech frames joined over pauses of up to ``post``."""
    speech = frames.where(flag).select(key, index)
    w = Window.partitionBy(key).orderBy(index)
    new = F.coalesce(F.col(index) - F.lag(index).over(w) > post + 1, F.lit(True)).cast("long")
    marked = speech.withColumn("_new", new).withColumn("island", F.sum("_new").over(w))
    return marked.groupBy(key, "island").agg(F.min(index).alias("start_frame"), (F.max(index) + 1).alias("end_frame"))
