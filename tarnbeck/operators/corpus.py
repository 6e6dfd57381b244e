"""Building and checking text corpora."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import fuzzyjoin

#: Sound-alikes that a recogniser confuses (no negation is among them).
CONFUSIONS = {
    "help": ["health", "hell", "held"],
    "away": ["a way", "way"],
    "touch": ["tough", "dutch"],
    "police": ["please", "polish"],
    "scared": ["scarred", "skated"],
    "safe": ["save", "say"],
    "following": ["falling", "follow in"],
    "hurt": ["heard", "hot"],
    "hurting": ["hurdling", "hurting"],
    "leave": ["live", "leaf"],
    "danger": ["dangerous", "ranger"],
    "stay": ["say", "stray"],
    "back": ["pack", "bag"],
    "let": ["led", "late"],
    "someone": ["some one", "someday"],
    "go": ["goal", "so"],
    "me": ["mean", "m"],
    "scream": ["stream", "cream"],
    "grabbing": ["grab in", "crabbing"],
}
#: What a recogniser puts in front.
FILLERS = ("uh ", "um ", "so ", "like ")


def parse_rules(rows: DataFrame, column: str) -> DataFrame:
    """``udk, layer, confidence, stt`` from rules like ``UDK UDK_14 (fuzzy 0.65, whisper)``; other rows go."""
    pattern = r"^UDK (UDK_\d+) \(([\w/]+) ([\d.]+), (\w+)\)"
    at = lambda k: F.regexp_extract(column, pattern, k)
    return rows.where(F.col(column).rlike(pattern)).select("*", at(1).alias("udk"), at(2).alias("layer"), at(3).cast("double").alias("confidence"), at(4).alias("stt"))


def near_held_out(rows: DataFrame, text: str, held: DataFrame, held_text: str, least: float) -> DataFrame:
    """``rows`` with ``near``: whether a held-out text has a word-set ratio of ``least`` with the row's.

    Both sides are normalised.  A similarity join finds the pairs, so work follows texts that share rare grams; none is lost.
    """
    return _near(rows, text, held, held_text, least, fuzzyjoin.alike_words)


def unlike_held_out(rows: DataFrame, text: str, held: DataFrame, held_text: str, least: float) -> DataFrame:
    """The rows whose text has a plain ratio under ``least`` with every held-out text (or under three words)."""
    out = _near(rows, text, held, held_text, least, fuzzyjoin.alike_ratio)
    return out.where(~F.col("near") | (F.size(tx.words(tx.normalize(F.col(text)))) < 3)).drop("near")


def _near(rows: DataFrame, text: str, held: DataFrame, held_text: str, least: float, pairs) -> DataFrame:
    every = rows.select(F.col(text), tx.normalize(F.col(text)).alias("_t")).where(F.col(text).isNotNull()).distinct()
    hits = pairs(every.select("_t"), held.select(tx.normalize(F.col(held_text))), least).select(F.col("a").alias("_t")).distinct()
    found = every.join(hits, "_t").select(text).withColumn("near", F.lit(True))
    return rows.join(found, text, "left").withColumn("near", F.coalesce("near", F.lit(False)))


def fill(spark: SparkSession, template: str, slots: dict[str, DataFrame], most: int | None = None) -> DataFrame:
    """``text``: the template with its ``{slots}`` filled from one-column tables of values.

    All combinations, or the first ``most`` by a hash of the text.
    """
    out = spark.range(1).select(F.lit(template).alias("text"))
    for name in re.findall(r"{(\w+)}", template):
        values = slots[name].toDF("_v")
        out = out.crossJoin(values).select(F.replace("text", F.lit("{" + name + "}"), F.col("_v")).alias("text"))
    return out if most is None else out.orderBy(F.xxhash64("text"), "text").limit(most)


def _chance(text: Column, seed: int, k: int) -> Column:
    return F.pmod(F.xxhash64(text, F.lit(seed), F.lit(k)), F.lit(1000)) / 1000.0


def asr_noise(text: Column, seed: int) -> Column:
    """Case, punctuation, a filler, contractions and a doubled word, each by a hash of the text and the seed."""
    t = F.when(_chance(text, seed, 1) < 0.7, F.lower(text)).otherwise(text)
    t = F.when(_chance(text, seed, 2) < 0.6, F.regexp_replace(t, r"[!-&(-/:-@\[-`{-~]", "")).otherwise(t)
    filler = F.element_at(F.array(*[F.lit(f) for f in FILLERS]), (F.pmod(F.xxhash64(text, F.lit(seed + 1)), F.lit(len(FILLERS))) + 1).cast("int"))
    t = F.when(_chance(text, seed, 3) < 0.3, F.concat(filler, t)).otherwise(t)
    t = F.when(_chance(text, seed, 4) < 0.3, F.replace(F.replace(F.replace(t, F.lit("I'm"), F.lit("I am")), F.lit("don't"), F.lit("dont")), F.lit("i'm"), F.lit("im"))).otherwise(t)
    w = F.filter(F.split(t, r"\s+"), lambda x: x != "")
    at = (F.pmod(F.xxhash64(text, F.lit(seed + 2)), F.greatest(F.size(w), F.lit(1))) + 1).cast("int")
    doubled = F.concat(F.slice(w, F.lit(1), at), F.slice(w, at, F.greatest(F.size(w) - at + 1, F.lit(0))))
    return F.array_join(F.when((_chance(text, seed, 5) < 0.25) & (F.size(w) > 2), doubled).otherwise(w), " ")


def asr_heavy(text: Column, seed: int) -> Column:
    """Words with sound-alikes swapped for one of them, by a hash; no other word changes."""
    table = F.create_map(*[x for k, v in CONFUSIONS.items() for x in (F.lit(k), F.array(*[F.lit(o) for o in v]))])
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^a-z0-9']+|[^a-z0-9']+$", "")

    def swap(w: Column) -> Column:
        other = table[bare(w)]
        return F.when(other.isNotNull(), F.element_at(other, (F.pmod(F.xxhash64(w, text, F.lit(seed)), F.greatest(F.size(other), F.lit(1))) + 1).cast("int"))).otherwise(w)

    return F.lower(F.array_join(F.transform(F.split(text, r"\s+"), swap), " "))


def lint(rows: DataFrame, text: str, context: str, label: str) -> DataFrame:
    """``check, value, n``: repeated texts and contexts, and four-word openings met more than twice."""
    opening = F.array_join(F.slice(F.split(text, r"\s+"), 1, 4), " ")
    counts = lambda name, c, least: rows.groupBy(c.alias("value")).agg(F.count("*").alias("n")).where(F.col("n") > least).select(F.lit(name).alias("check"), "value", "n")
    return counts("text", F.col(text), 1).unionByName(counts("context", F.col(context), 1)).unionByName(counts("opening", opening, 2))
