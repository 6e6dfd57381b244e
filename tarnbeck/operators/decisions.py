"""From matches to three-state decisions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RULES

TIERS = ("NO_ACTION", "TRIGGER_VERIFY", "TRIGGER_ALL")


def tier(confidence: Column) -> Column:
    return F.when(confidence >= RULES.trigger_all, TIERS[2]).when(confidence >= RULES.trigger_verify, TIERS[1]).otherwise(TIERS[0])


def tier_rank(decision: Column) -> Column:
    return F.when(decision == TIERS[2], 2).when(decision == TIERS[1], 1).otherwise(0)


def stt_suspect(avg_logprob: Column, temperature: Column) -> Column:
    """A missing signal is no suspicion."""
    return F.coalesce(avg_logprob < RULES.logprob_floor, F.lit(False)) | F.coalesce(temperature > 0.0, F.lit(False))


def veto_cap(confidence: Column, vetoed: Column, corroborated: Column, layer: Column) -> Column:
    capped = vetoed & ~corroborated & (layer != "kws")
    return F.when(capped, F.least(confidence, F.lit(RULES.trigger_verify - 0.01))).otherwise(confidence)


def event_id(journey: Column, start_ms: Column, phrase: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", journey.cast("string"), start_ms.cast("string"), F.coalesce(phrase.cast("string"), F.lit("none"))), 256), 1, 16)


def audio_time(started_at: Column, start_ms: Column) -> Column:
    return started_at + start_ms / 1000.0


def repeats(hits: DataFrame, keys: list[str], phrase: str, at: str, order: list[str], window_s: float = RULES.window_s) -> DataFrame:
    """``n_same`` and ``n_distinct``: hits of the same phrase, and different phrases, in the window that
    ends with each hit (its start included), counting the hit and those before it in order only.

    Rows that share a time come one after another, so the frames are by row, not by range.
    """
    # a range frame also holds the later rows of this row's time; they are taken off again
    in_span = F.expr(f"count(*) over (partition by {', '.join([*keys, phrase])} order by {at} range between {float(window_s)}D preceding and current row)")
    peers = Window.partitionBy(*keys, phrase, at)
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy(*order))
    out = hits.withColumn("n_same", in_span).withColumn("n_same", F.col("n_same") - later)
    # a phrase counts from a hit that has none of the phrase in the window before it, until the window after its
    # last such hit has passed; the running sum of those starts and ends is the number of phrases
    hit, same = F.col(phrase).isNotNull(), Window.partitionBy(*keys, phrase).orderBy(at, *order)
    before, after = F.lag(at).over(same), F.lead(at).over(same)
    starts = hit & F.coalesce(before + window_s < F.col(at), F.lit(True))
    ends = hit & F.coalesce(F.col(at) + window_s < after, F.lit(True))
    out = out.withColumns({"_starts": starts.cast("long"), "_ends": ends}).withColumn("_end", F.explode(F.when(F.col("_ends"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    out = out.withColumn("_at", F.when(F.col("_end"), F.col(at) + window_s).otherwise(F.col(at)))
    so_far = Window.partitionBy(*keys).orderBy("_at", "_end", *order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("n_distinct", F.sum(F.when(F.col("_end"), F.lit(-1)).otherwise(F.col("_starts"))).over(so_far))
    return out.where(~F.col("_end")).drop("_starts", "_ends", "_end", "_at")


def escalate(hits: DataFrame) -> DataFrame:
    """``decision`` and ``reason`` by precedence: agreement, distinct phrases, repetition, sound, threshold.

    Needs ``confidence, verify_by_default, corroborated, scream, n_same, n_distinct``.
    """
    repeated, distinct = F.col("n_same") >= 2, F.col("n_distinct") >= RULES.distinct_count
    strong = F.col("corroborated") | distinct | repeated | F.col("scream")
    decision = (
        F.when(F.col("confidence") < RULES.trigger_verify, TIERS[0])
        .when(F.col("verify_by_default") & ~strong, TIERS[1])
        .when(strong | (F.col("confidence") >= RULES.trigger_all), TIERS[2])
        .otherwise(TIERS[1])
    )
    reason = (
        F.when(F.col("confidence") < RULES.trigger_verify, "below")
        .when(F.col("corroborated"), "agreement").when(distinct, "distinct").when(repeated, "repeated").when(F.col("scream"), "sound")
        .when(F.col("verify_by_default"), "verify_by_default").when(F.col("confidence") >= RULES.trigger_all, "confident").otherwise("between")
    )
    return hits.withColumn("repeated", repeated).withColumn("decision", decision).withColumn("reason", reason)


def fuse(stt: DataFrame, spotted: DataFrame, key: list[str]) -> DataFrame:
    """Both branches of a segment: the more confident one (text first on ties) and whether they agree.

    ``stt``: key, phrase, confidence; ``spotted``: key, spotted, distance.
    """
    both = stt.join(spotted, key, "full_outer")
    spot_conf = F.when(F.col("spotted").isNotNull(), RULES.spotted_confidence).otherwise(0.0)
    text_conf = F.coalesce("confidence", F.lit(0.0))
    text_wins = text_conf >= spot_conf
    return both.select(
        *key, F.when(text_wins, F.col("phrase")).otherwise(F.col("spotted")).alias("phrase"),
        F.when(text_wins, text_conf).otherwise(spot_conf).alias("confidence"),
        F.when(text_wins & F.col("phrase").isNotNull(), "text").when(~text_wins, "kws").otherwise("none").alias("layer"),
        F.coalesce((F.col("phrase") == F.col("spotted")) & (F.col("distance") <= RULES.corroboration_distance), F.lit(False)).alias("agree"),
    )


def drain(rows: DataFrame, key: str, order: list[str], row_id: str, alert: Column, sent: Column, beat: Column, up: Column) -> DataFrame:
    """``key, row_id, delivered_by, attempts`` of each alert: one that is not sent at once is tried again at every
    later heartbeat of its key until the receiver is up (null: it is still waiting).

    One pass back and one forth over each key in order; no pairs of alerts and heartbeats are made.
    """
    rows = rows.select(key, *[c for c in order if c != row_id], row_id, alert.alias("_alert"), sent.alias("_sent"), beat.alias("_beat"), (beat & up).alias("_up"))
    w = Window.partitionBy(key)
    rows = rows.withColumn("_n", F.count_if("_beat").over(w.orderBy(*order))).withColumn("_all", F.count_if("_beat").over(w))
    taker = F.last(F.when(F.col("_up"), F.struct(F.col(row_id).alias("id"), F.col("_n").alias("n"))), ignorenulls=True)
    rows = rows.withColumn("_by", taker.over(w.orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1))).where("_alert")
    tried = F.coalesce("_by.n", "_all") - F.col("_n")
    return rows.select(key, row_id, F.when(F.col("_sent"), F.col(row_id)).otherwise(F.col("_by.id")).alias("delivered_by"), F.when(F.col("_sent"), 1).otherwise(1 + tried).cast("long").alias("attempts"))
