"""Transcripts against a phrase dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FUNCTION_WORDS, LEAD_SKIP, RULES
from ..functions import similarity as sim
from ..functions import text as tx
from ..sources.files import through_files
from .dictionary import Dictionary
from .fuzzyjoin import alike_ratio

#: Phrases that are broadcast at once; a dictionary of more is met in blocks of about so many.
MOST_PHRASES = 2_000


def derived_phrases(texts: DataFrame, column: str, n_words: int = 3, n: int = 20) -> DataFrame:
    """A dictionary from data: the most frequent openings of ``n_words`` words (``udk_id, phrase, ord``)."""
    w = tx.words(tx.normalize(F.col(column)))
    opening = texts.select(F.array_join(F.slice(w, 1, n_words), " ").alias("phrase")).where(F.size(F.split("phrase", " ")) == n_words)
    top = opening.groupBy("phrase").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "phrase").limit(n)
    rows = [(f"UDK_{k:02d}", r["phrase"], k) for k, r in enumerate(top.collect(), 1)]
    return texts.sparkSession.createDataFrame(rows, "udk_id string, phrase string, ord int")


def _normalized(texts: DataFrame, text: str) -> DataFrame:
    """``text, t``: each different text and its normalised form; nulls, empty ones and fillers alone go."""
    # normalised before the distinct: an aggregate is not inlined, so each text is normalised once
    t = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), tx.normalize(F.col(text)).alias("t")).distinct()
    return t.where((F.col("t") != "") & ~tx.is_non_distinctive(F.col("t")))


def anchored_phrases(texts: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """``text, udk_id, phrase``: the phrases that each different text is anchored in, by joins on words.

    A content word of the phrase is like one of the text (``RULES.word_similarity``), or the text opens with a "dont" that
    the phrase has.  Each pair of different words is scored once, however many texts have them.
    """
    t = through_files(_normalized(texts, text).withColumn("id", F.monotonically_increasing_id()), "parquet")  # ids that last, so that no text is shuffled with its words
    of_text = t.select("id", F.explode(F.array_distinct(tx.words(F.col("t")))).alias("w"))
    own = phrases.select("udk_id", "phrase", F.explode(F.array_distinct(tx.words(tx.normalize(F.col("phrase"))))).alias("w")).distinct()
    content = own.where(~F.col("w").isin(list(FUNCTION_WORDS)))
    same = alike_ratio(of_text.select("w"), content.select("w"), RULES.word_similarity).select(F.col("a").alias("w"), F.col("b").alias("of_phrase"))
    same = through_files(same.join(content.withColumnRenamed("w", "of_phrase"), "of_phrase").select("w", "udk_id", "phrase").distinct(), "parquet")  # written, so that Spark knows its size before it joins
    by_word = of_text.join(same, "w").select("id", "udk_id", "phrase")
    opening = F.filter(tx.words(F.col("t")), lambda w: ~w.isin(list(LEAD_SKIP)))
    dont = t.where(F.get(opening, F.lit(0)) == "dont").join(F.broadcast(own.where("w = 'dont'")), F.lit(True)).select("id", "udk_id", "phrase")  # phrases with one word, a part of the dictionary
    return by_word.union(dont).distinct().join(t.select("id", "text"), "id").select("text", "udk_id", "phrase")


SCANNED = "text string, t string, place int, kind string, n_holding int, anchored boolean, words double, part double, covered double"


def scan(texts: DataFrame, text: str, phrases: DataFrame, threshold: float | None = None, most: int = MOST_PHRASES) -> DataFrame:
    """``text, t, udk_id, phrase, ord, p, kind, n_holding, anchored, words, part, covered``: the hits of each different text.

    ``kind`` is ``inside`` (the text holds the phrase), ``fragment`` (the phrase holds the text, which is shorter) and,
    with a ``threshold``, ``loose`` (alike enough in words).  ``n_holding`` phrases hold the text.  Nulls, empty texts and
    fillers alone have no hits; phrases that are empty once normalised go.  The dictionary is broadcast in blocks of about
    ``most`` phrases, each of which meets every text once.
    """
    t = _normalized(texts, text)
    p = phrases.select("udk_id", "phrase", "ord", tx.normalize(F.col("phrase")).alias("p")).where("p <> ''").distinct()
    blocks = max(1, -(-p.count() // most))
    made = None
    for b in range(blocks):
        rows = p.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b).orderBy("ord", "udk_id", "phrase").collect()  # a block of the dictionary, sent to the tasks
        known = texts.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(rows)], "place int, udk_id string, phrase string, ord int, p string")
        hits = t.mapInPandas(_scanner([r["p"] for r in rows], threshold), SCANNED).join(F.broadcast(known), "place").drop("place")
        made = hits if made is None else made.unionByName(hits)
    if blocks > 1:  # phrases that hold a text lie in several blocks
        all_ = t.select("text", "t").where(F.length("t") <= max([r[0] or 0 for r in p.select(F.max(F.length("p"))).collect()]))
        held = made.where("kind = 'fragment' or t = p").groupBy("text").agg(F.count("*").alias("n")).join(all_.select("text"), "text", "left_semi")
        made = made.drop("n_holding").join(held, "text", "left").withColumn("n_holding", F.coalesce("n", F.lit(0)).cast("int")).drop("n")
    return made.select("text", "t", "udk_id", "phrase", "ord", "p", "kind", "n_holding", "anchored", "words", "part", "covered")


def _scanner(phrases: list[str], threshold: float | None):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Dictionary(phrases)
        for part in parts:
            out = []
            for text, t in zip(part["text"], part["t"], strict=True):
                inside, holding = known.inside(t), known.holding(t)
                out += [(text, t, k, "inside", len(holding), True, None, None, None) for k in inside]
                out += [(text, t, k, "fragment", len(holding), sim.has_anchor(phrases[k], t), None, None, None) for k in holding if k not in inside]
                if threshold is not None:
                    out += [(text, t, k, "loose", len(holding), anchored, words, share, covered) for k, words, share, covered, anchored in known.loose(t, inside.union(holding), threshold)]
            made = pd.DataFrame(out, columns=["text", "t", "place", "kind", "n_holding", "anchored", "words", "part", "covered"])
            yield made.astype({"words": "float64", "part": "float64", "covered": "float64", "anchored": "object"})

    return run


def exact_layer(texts: DataFrame, text: str, phrases: DataFrame, most: int = MOST_PHRASES) -> DataFrame:
    """The hits of the exact layer with their ``confidence``: the phrase in the text, or the text a fragment of the phrase.

    A fragment needs an anchor, and one that several phrases hold is capped.
    """
    hits = scan(texts, text, phrases, most=most).where("kind = 'inside' or anchored")
    low = F.when(F.col("n_holding") > 1, RULES.spotted_confidence).otherwise(1.0)
    return hits.withColumn("confidence", F.when(F.col("kind") == "inside", 1.0).otherwise(low))


def fuzzy_scores(texts: DataFrame, text: str, phrases: DataFrame, threshold: float = RULES.text_threshold, most: int = MOST_PHRASES) -> DataFrame:
    """Pairs alike enough in words, exact ones too, with ``words, part, covered, anchored`` as far as each got."""
    hits = scan(texts, text, phrases, threshold, most)
    loose = hits.where("kind = 'loose'")
    scored = hits.where("kind <> 'loose'").drop("words", "part", "covered", "anchored").withColumn("_s", sim.fuzzy_gate_col(F.col("p"), F.col("t"), threshold))
    return loose.unionByName(scored.where(F.col("_s.words") >= threshold).select(*[c for c in hits.columns if c not in ("words", "part", "covered", "anchored")], "_s.*"))


def passes_fuzzy(threshold: float = RULES.text_threshold) -> Column:
    return (F.col("part") >= threshold) & (F.col("covered") >= RULES.word_coverage)


def best_match(texts: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """``text, udk_id, layer, confidence``: the best phrase of each different text (none: nulls and 0).

    The exact layer comes first for a pair; the others score fuzzy similarity at a discount, and the
    word-set similarity that stands in for a model of meaning.  Ties go to the earlier phrase, and there
    to the earlier layer.
    """
    hits = scan(texts, text, phrases, RULES.text_threshold)
    cap = lambda c: F.when(F.col("n_holding") > 1, F.least(c, F.lit(RULES.spotted_confidence))).otherwise(c)
    exact = hits.where("kind = 'inside' or kind = 'fragment' and anchored")
    exact = exact.select("text", "udk_id", "ord", F.lit("exact").alias("layer"), F.lit(0).alias("k"), F.when(F.col("kind") == "inside", 1.0).otherwise(cap(F.lit(1.0))).alias("confidence"))
    loose = hits.where("kind = 'loose'")
    short = F.size(tx.words(F.col("t"))) <= F.size(tx.words(F.col("p")))
    by_fuzzy = F.when(passes_fuzzy() & ~(short & ~F.col("anchored")), cap(F.col("part") * RULES.discount))
    by_words = F.col("words") * RULES.discount
    fuzzy_wins = by_fuzzy.isNotNull() & (by_fuzzy >= by_words)
    layer, k = F.when(fuzzy_wins, "fuzzy").otherwise("semantic"), F.when(fuzzy_wins, 1).otherwise(2)
    loose = loose.select("text", "udk_id", "ord", layer.alias("layer"), k.alias("k"), F.when(fuzzy_wins, by_fuzzy).otherwise(by_words).alias("confidence"))
    best = exact.unionByName(loose).groupBy("text").agg(F.max_by(F.struct("udk_id", "layer", "confidence"), F.struct("confidence", -F.col("ord"), -F.col("k"))).alias("m"))
    every = texts.select(F.col(text).alias("text")).where(F.col(text).isNotNull()).distinct()
    out = every.join(best, "text", "left")
    return out.select("text", "m.udk_id", F.coalesce("m.layer", F.lit("none")).alias("layer"), F.coalesce("m.confidence", F.lit(0.0)).alias("confidence"))
