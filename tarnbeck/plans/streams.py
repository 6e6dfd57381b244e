"""Streaming operators run to the end of their input (trigger: available now), as batch results.

The input is written as files first and streamed from there, a few files a batch; the checkpoint is in
the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import scratch
from ..sources.sinks import deliver_once
from ..streaming import processors as p
from .base import Registry, Tables, confidence, seconds
from .ordered import DRAINED, HITS, WINDOW, _alerts
from .rules import CRC32

R = Registry()


def through_stream(rows: DataFrame, f: Callable[[DataFrame], DataFrame], files: int = 3, mode: str = "append", order: Column | None = None) -> DataFrame:
    """``f`` over ``rows`` as a stream of ``files`` files, one a batch; what it wrote.

    With ``order`` (a number) the files are ranges of it and come one after another.
    """
    spark = rows.sparkSession
    source, out, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    if order is None:
        rows.repartition(files).write.parquet(source)
    else:
        low, high = rows.agg(F.min(order), F.max(order)).first()
        step = (float(high or 0) - float(low or 0)) / files
        for k in range(files):
            mine = (order >= float(low or 0) + k * step if k else F.lit(True)) & (order < float(low or 0) + (k + 1) * step if k < files - 1 else F.lit(True))
            rows.where(mine).coalesce(1).write.mode("append").parquet(source)
    stream = f(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source))
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@R.add("""select l_orderkey as journey, cast(s - 1 as bigint) as seq from (select l_orderkey, s, row_number() over (partition by l_orderkey order by s) as n from (select distinct l_orderkey, l_linenumber as s from lineitem)) where s = n""")
def stream_reorder(d: Tables) -> DataFrame:
    """Chunks in any order: what is released is each journey's run of numbers from the first without a gap."""
    li = d.lineitem.select(F.col("l_orderkey").alias("journey"), (F.col("l_linenumber") - 1).cast("long").alias("seq"), F.col("l_returnflag").alias("body"))
    return through_stream(li, lambda s: p.reorder(s, "journey", "seq", "body")).select("journey", "seq")


@R.add("select user_id, cast(event_id * 10 as bigint) as start, cast(event_id * 10 + 5 as bigint) as \"end\" from events qualify row_number() over (partition by user_id order by event_id desc) > 1")
def stream_finalize(d: Tables) -> DataFrame:
    """Segments are passed on once more sound has come; each journey's last one is still open."""
    e = d.events.select("user_id", (F.col("event_id") * 10).alias("start"), (F.col("event_id") * 10 + 5).alias("end"))
    last = F.expr("lead(start) over (partition by user_id order by start)")
    seen = e.withColumn("total", F.coalesce(last, F.col("end"))).unionByName(e.withColumn("total", F.col("end")))
    return through_stream(seen, lambda s: p.finalize(s, "user_id", "start", "end", "total"), order=F.col("total"))


@R.add(f"""select a.event_id, a.user_id, cast(count(case when a.event_type = b.event_type then 1 end) as bigint) as n_same, cast(count(distinct b.event_type) as bigint) as n_distinct from ({HITS}) a
  join ({HITS}) b on a.user_id = b.user_id and b.t between a.t - {WINDOW} and a.t and (b.t < a.t or b.event_id <= a.event_id) group by 1, 2""")
def stream_escalation(d: Tables) -> DataFrame:
    h = d.events.select("event_id", "user_id", "event_type", seconds().alias("t"), confidence().alias("c")).where("c >= 0.6").drop("c")
    out = through_stream(h, lambda s: p.escalate(s, "user_id", "t", "event_id", "event_type", WINDOW), order=F.col("t"))
    return out.select("event_id", "user_id", "n_same", "n_distinct")


@R.add(f"select * from ({DRAINED}) where delivered_by is not null")
def stream_outbox_drain(d: Tables) -> DataFrame:
    """Alerts leave the stream when they are delivered, at once or at a later heartbeat."""
    return through_stream(_alerts(d), lambda s: p.drain(s, "user_id", ["t", "event_id"], "event_id"), order=F.col("t"))


@R.add("""select a.conv_id, a.turn, coalesce(string_agg(b.text, ' ' order by b.turn), '') as context from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn < a.turn and b.turn >= a.turn - 2 group by 1, 2""")
def stream_context(d: Tables) -> DataFrame:
    """Each turn's recent transcripts, from a state pruned to the window: the batch query's rows, as a stream."""
    c = d.conversations.select("conv_id", "turn", F.col("turn").cast("double").alias("t"), "text")
    return through_stream(c, lambda s: p.recent_context(s, "conv_id", "t", "turn", "text", 2.0), order=F.col("turn"))


@R.add()
def stream_timeout(d: Tables) -> DataFrame:
    """Silent journeys as the watermark passes their grace."""
    b = d.events.select("user_id", F.expr("cast(ts as timestamp)").alias("ts"), (F.col("event_type") == "error").alias("triggered"))
    return through_stream(b, lambda s: p.timeouts(s, "user_id", "ts", "triggered"), order=F.unix_micros("ts")).select("user_id", "status", "last_ms")


@R.add("select event_id, user_id, event_type from events")
def stream_dedup(d: Tables) -> DataFrame:
    """Every event twice, delivered at least once: each comes out one time."""
    e = d.events.select("event_id", "user_id", "event_type", F.expr("cast(ts as timestamp)").alias("ts"))
    return through_stream(e.union(e), lambda s: p.dedup(s, "event_id", "ts", "40 days")).select("event_id", "user_id", "event_type")


@R.add("select event_id, event_type, value from events")
def stream_restart(d: Tables) -> DataFrame:
    """A stream stopped after one batch and started again from its checkpoint, into an idempotent sink."""
    spark = d.spark
    source, out, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows = d.events.select("event_id", "event_type", "value")
    rows.repartition(4).write.parquet(source)

    def run(stop_after: int | None) -> None:
        seen = [0]

        def sink(batch: DataFrame, number: int) -> None:
            deliver_once(batch, out, "event_id")
            seen[0] += 1
            if stop_after and seen[0] == stop_after:
                raise RuntimeError("stopped")  # after the write, before the batch counts as done

        q = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception as e:
            if not stop_after or "stopped" not in str(e):
                raise

    run(2)
    run(None)
    return spark.read.schema(rows.schema).parquet(out)


@R.add("select event_type, cast(epoch_us(ts) // 86400000000 as bigint) as day, count(*) as n from events group by 1, 2 having day < (select max(epoch_us(ts)) // 86400000000 from events)")
def stream_late(d: Tables) -> DataFrame:
    """Daily counts: late rows within the lateness are counted, and a day comes out when it can no longer change."""
    e = d.events.select("event_type", F.expr("cast(ts as timestamp)").alias("ts"))
    out = through_stream(e, lambda s: p.counts_with_late(s, "ts", "1 day", "1 seconds", "event_type"), order=F.unix_micros("ts"))
    return out.select("event_type", F.floor(F.unix_seconds("window.start") / 86400).alias("day"), "n")


@R.add()
def stream_language_streak(d: Tables) -> DataFrame:
    """Language checks (here: event types); a change needs three in a row."""
    c = d.events.select("user_id", "event_id", F.col("event_type").alias("v"))
    return through_stream(c, lambda s: p.language_streak(s, "user_id", "event_id", "v", 3, "click"), order=F.col("event_id"))


#: Of a hundred events 10 are accepted at the third try, 20 at the second, 67 at once, and 3 never while the receiver is down.
REFUSED = [[10, 3], [30, 2], [97, 1], [100, 0]]


@R.add(f"""select event_id, case when lot < 10 then 3 when lot < 30 then 2 else 1 end::int as attempts, lot >= 97 as was_dead, 1::bigint as posts, user_id
  from (select event_id, user_id, {CRC32.format("event_id::varchar")} % 100 as lot from events)""")
def delivered_once(d: Tables) -> DataFrame:
    """Events streamed to a receiver that refuses a stated share; dead letters go out again once it is up."""
    from ..sources import delivery as dl

    spark = d.spark
    spark.dataSource.register(dl.Delivery)
    source, to, letters, state = (scratch(spark, n) for n in ("stream-in", "receiver", "letters", "stream-state"))
    rows = d.events.select("event_id", "user_id", "event_type", "value")
    rows.repartition(4).write.parquet(source)
    common = {"endpoint": to, "key": "event_id", "letters": letters, "secret": "s", "pause": "0"}
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.writeStream.format("delivery").options(**common, refuse=json.dumps(REFUSED)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    dead = dl.dead_letters(spark, letters)
    again = dead.select(F.from_json("body", rows.schema).alias("e")).select("e.*")
    again.write.format("delivery").mode("append").options(**{**common, "letters": letters + "-again"}).save()
    got = dl.received(spark, to).withColumn("e", F.from_json("body", rows.schema))
    was = dead.select("key").distinct().withColumn("was_dead", F.lit(True))
    return got.join(was, "key", "left").select("e.event_id", "attempts", F.coalesce("was_dead", F.lit(False)).alias("was_dead"), "posts", "e.user_id")
