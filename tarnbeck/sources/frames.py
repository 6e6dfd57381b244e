"""Binary frames (number, client time, sound), a Python data source of them, and reference banks."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Fixed value: the header of a frame, an unsigned number and a double, most significant byte first.
HEADER = ">Qd"
SIZE = struct.calcsize(HEADER)
SCHEMA = "journey_id string, seq long, client_ts double, pcm binary"


def pack(seq: Column, client_ts: Column, body: Column) -> Column:
    @F.pandas_udf("binary")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(HEADER, int(x), y) + z for x, y, z in zip(a, b, c, strict=True)])

    return run(seq, client_ts, body)


def unpack(rows: DataFrame, frame: str) -> DataFrame:
    """``rows`` with ``seq, client_ts, pcm`` from the frame; a frame shorter than its header gives nulls."""

    @F.pandas_udf("double")
    def when(f: pd.Series) -> pd.Series:
        return f.map(lambda x: None if x is None or len(x) < SIZE else struct.unpack(HEADER, x[:SIZE])[1]).astype("float64")

    whole = F.octet_length(frame) >= SIZE
    seq = F.when(whole, F.conv(F.hex(F.substring(frame, 1, 8)), 16, 10).cast("long"))
    pcm = F.when(whole, F.substring(F.col(frame), F.lit(SIZE + 1), F.octet_length(frame)))
    return rows.withColumns({"seq": seq, "client_ts": when(frame), "pcm": pcm})


def plan_frame(journey: int, seq: int) -> tuple[str, int, float, bytes]:
    body = (np.sin(np.arange(160) * (1 + journey) / 10) * 8000).astype("<i2").tobytes()
    return f"j{journey}", seq, 1000.0 * journey + seq * 0.5, body


class _Part(InputPartition):
    def __init__(self, journey: int):
        self.journey = journey


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.journeys, self.frames = int(options.get("journeys", 2)), int(options.get("frames", 10))

    def partitions(self) -> list[_Part]:
        return [_Part(j) for j in range(self.journeys)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for seq in range(self.frames):
            yield plan_frame(partition.journey, seq)


class _Stream(SimpleDataSourceStreamReader):
    """Each micro-batch holds the next frame of every journey; offsets are frame numbers, so it can start again."""

    def __init__(self, options: dict):
        self.journeys, self.frames = int(options.get("journeys", 2)), int(options.get("frames", 10))

    def initialOffset(self) -> dict:
        return {"seq": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        seq = start["seq"]
        if seq >= self.frames:
            return iter([]), start
        return self.readBetweenOffsets(start, {"seq": seq + 1}), {"seq": seq + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([plan_frame(j, s) for s in range(start["seq"], end["seq"]) for j in range(self.journeys)])


class FrameSource(DataSource):
    """``format("tarnbeck_frames")``; options ``journeys`` and ``frames``."""

    @classmethod
    def name(cls) -> str:
        return "tarnbeck_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)


def bank_summary(vectors: DataFrame, phrase: str, number: str, values: str, width: int) -> DataFrame:
    """References stored as npz archives of one array each and loaded again, counted by phrase.

    An array's key is ``<phrase>__<number>``; the phrase is what stands before the last mark.
    """

    @F.pandas_udf("binary")
    def store(key: pd.Series, x: pd.Series) -> pd.Series:
        def one(k: str, a: list) -> bytes:
            out = io.BytesIO()
            np.savez(out, **{k: np.asarray(a, np.float32).reshape(-1, width)})
            return out.getvalue()

        return pd.Series([one(k, a) for k, a in zip(key, x, strict=True)])

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, a.shape[0]) for raw in b["npz"] for k, a in np.load(io.BytesIO(raw)).items()]
            yield pd.DataFrame(rows, columns=["key", "frames"])

    key = F.concat(F.col(phrase).cast("string"), F.lit("__"), F.col(number).cast("string"))
    bank = vectors.select(store(key, F.col(values)).alias("npz")).mapInPandas(load, "key string, frames int")
    name = F.regexp_extract("key", r"^(.*)__[^_]*$", 1).cast("int")
    return bank.groupBy(name.alias("phrase_id")).agg(F.count("*").cast("int").alias("n_references"), F.sum("frames").cast("int").alias("n_frames"))
