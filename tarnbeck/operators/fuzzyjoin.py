"""Similarity joins that lose no pair: an inverted index of q-grams with prefix, length and count filters.

A text's *bag* holds the two-letter grams of its words, each word with a space on either side, with their numbers.
It is the same for every order of the words, so one bag serves scores over whole texts, sorted words and word sets.
A letter that one text lacks costs at most two grams of the text that has it and one of the other, so two texts
whose longest common subsequence is L share at least 3 L - |a| - |b| + 1 grams (without the two that stand at a
stretch's edges two less).  A score of at least S bounds L from below, which gives the least number of shared
grams as a function of the shorter text's length: ``whole``, ``stretch`` and ``words`` below.

Of two texts that share ``need`` grams, one is among any ``size - need + 1`` grams of the shorter one; its rarest are
taken.  So the shorter text is listed by these, the other by all its grams, and only pairs that meet are scored.
Texts so short that the bound falls under one gram are listed by their letters.

Where one side is a dictionary of few texts, blocks of it go to the tasks instead, and each text of the other side is met with
a block's index there: shared grams are counted in full, so few pairs are scored, and no pair is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..sources.files import through_files

Need = Callable[[Column], Column]
HOT_PAIRS = 100_000  # a gram with more pairs of listings is dealt out to so many parts of about this size
MOST_PARTS = 1_024
#: A side of so many different texts at most is met in blocks, of about so many texts and characters; each is sent to the tasks.
FEW, BLOCK_TEXTS, BLOCK_CHARS = 16_384, 2_048, 1 << 20


def whole(score: float) -> Need:
    """Both texts (or their words in some order) have a ratio of ``score`` at least."""
    return lambda n: F.ceil((1.5 * score / 100 - 1) * 2 * n + 1 - 1e-9)


def stretch(score: float) -> Need:
    """The shorter text has a ratio of ``score`` at least with a stretch of the other, no longer than itself."""
    r = score / 100
    return lambda n: F.ceil((1.5 * r - 1) * 2 * n / (2 - r) - 1 - 1e-9) if r <= 1 else n + 1


def words(score: float) -> Need:
    """Word sets: either the ratio of all words, or that of the shared ones with one side's, is ``score`` at least.

    The second means that the shared words make up ``score / (200 - score)`` of that side (all, if it is a subset).
    """
    return lambda n: F.least(whole(score)(n), F.ceil(score / (200 - score) * n + 1 - 1e-9))


def least_of(*needs: Need) -> Need:
    return lambda n: F.least(*[f(n) for f in needs]) if len(needs) > 1 else needs[0](n)


def bag(text: str) -> list[str]:
    """The grams of a text as a set: the k-th of equal grams has the number k.  White space beside white space is a gram too."""
    seen: Counter = Counter()
    out = []
    for w in text.split():
        for i in range(len(w) + 1):
            g = f" {w} "[i : i + 2]
            seen[g] += 1
            out.append(g + str(seen[g]))
    blank = [c.isspace() for c in f" {text} "]
    return out + [f"  {k}" for k in range(1, sum(map(and_, blank, blank[1:])) + 1)]


def _listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Length, length of the distinct words joined, number of grams, the grams and the distinct letters of each text."""
    for part in parts:
        rows = []
        for t in part["t"]:
            own, grams = set(t.split()), bag(t)
            if own:
                rows.append((t, len(t), sum(map(len, own)) + len(own) - 1, len(grams), grams, sorted({c for w in own for c in w})))
        yield pd.DataFrame(rows, columns=["t", "len", "n", "size", "grams", "letters"])


def _pairs(short: DataFrame, long: DataFrame, order: Column) -> DataFrame:
    """``a, b`` of the listings that meet, hot grams dealt out: part of the prefix side in each of several tasks."""
    counts = short.groupBy("g").agg(F.count("*").alias("ns")).join(long.groupBy("g").agg(F.count("*").alias("nl")), "g")
    parts = F.least(F.lit(MOST_PARTS), F.ceil(F.col("ns") * F.col("nl") / HOT_PAIRS)).cast("int")
    hot = counts.select("g", parts.alias("parts")).where("parts > 1")
    s = short.join(hot, "g", "left").withColumn("part", F.pmod(F.xxhash64("s"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    rows = long.join(hot, "g", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return s.join(rows, ["g", "part"]).where(order).select("s", "l").distinct()


def alike(left: DataFrame, right: DataFrame, need: Need, score: Callable[[str, str], float], least: float, possible: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``a, b, score``: every pair of a text of ``left`` and one of ``right`` with a ``score`` of ``least`` at least.

    ``left`` and ``right`` have one column each; nulls, texts without a word and repeats go.  ``need`` must hold for all
    such pairs, and ``possible``, over the lengths of both, may rule others out.  Pairs are made of texts that
    share a rare gram, each once.
    """

    def listed(rows: DataFrame) -> DataFrame:
        return rows.toDF("t").where("t is not null").distinct().mapInPandas(_listed, "t string, len int, n int, size int, grams array<string>, letters array<string>")

    a, b = (through_files(listed(side), "parquet") for side in (left, right))  # each is read three times
    short_of_grams = need(F.col("n")) < 1
    spread = lambda r: r.select("t", "len", "n", F.explode(F.concat("grams", "letters")).alias("g"))
    known = spread(a).select("g").unionByName(spread(b).select("g")).groupBy("g").agg(F.count("*").alias("df"))

    def prefix(rows: DataFrame) -> DataFrame:
        own = rows.select("t", "len", "n", "size", short_of_grams.alias("tiny"), F.explode(F.when(short_of_grams, F.col("letters")).otherwise(F.col("grams"))).alias("g"))
        rare = F.row_number().over(Window.partitionBy("t").orderBy("df", "g"))
        own = own.join(known, "g").withColumn("k", rare)
        return own.where(F.col("tiny") | (F.col("k") <= F.col("size") - need(F.col("n")) + 1)).select("t", "len", "n", "g")

    named = lambda r, p: r.select(F.col("t").alias(p), F.col("len").alias("len_" + p), F.col("n").alias("n_" + p), "g")
    apart = possible or (lambda la, lb: F.lit(True))
    first = _pairs(named(prefix(a), "s"), named(spread(b), "l"), (F.col("n_s") <= F.col("n_l")) & apart(F.col("len_s"), F.col("len_l"))).toDF("a", "b")
    second = _pairs(named(prefix(b), "s"), named(spread(a), "l"), (F.col("n_s") < F.col("n_l")) & apart(F.col("len_l"), F.col("len_s"))).toDF("b", "a")
    met = first.unionByName(second)
    return met.mapInPandas(_scorer(score, least), "a string, b string, score double")


def _scorer(score: Callable[[str, str], float], least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(a, b, s) for a, b in zip(part["a"], part["b"], strict=True) if (s := score(a, b)) >= least]
            yield pd.DataFrame(found, columns=["a", "b", "score"])

    return run


#: Whether a text may be alike with each of a block's, by arrays: shared grams, lengths of both, lengths of their distinct
#: words joined, and of the words they share joined.
Bound = Callable[[np.ndarray, int, np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


def ratio_bound(score: float) -> Bound:
    near = within((200 - score) / score + 1e-9)
    return lambda shared, la, lb, na, nb, common: near(la, lb) & (shared >= (1.5 * score / 100 - 1) * (la + lb) + 1 - 1e-9)


def words_bound(score: float) -> Bound:
    """As ``words``: all words are alike, or those shared make up enough of either side."""
    near = within((200 - score) / score + 1e-9)
    return lambda shared, la, lb, na, nb, common: near(na, nb) & (shared >= (1.5 * score / 100 - 1) * (na + nb) + 1 - 1e-9) | (common >= score / (200 - score) * np.minimum(na, nb) - 1e-9)


class Block:
    """An inverted index of some texts, each with a word at least, by grams and by words."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.len, self.n = np.array([len(t) for t in texts], int), np.array([_joined(t) for t in texts], int)
        self.masks = [(sim._masks(t), len(t)) for t in texts]
        self.grams, self.words = self._index(bag), self._index(lambda t: set(t.split()))

    def _index(self, parts: Callable) -> dict[str, np.ndarray]:
        at: dict[str, list[int]] = {}
        for k, t in enumerate(self.texts):
            for g in parts(t):
                at.setdefault(g, []).append(k)
        return {g: np.array(ks) for g, ks in at.items()}

    def met(self, text: str, bound: Bound) -> list[int]:
        """The places of the texts that may be alike with ``text``."""
        n = _joined(text)
        if n < 0 or not self.texts:
            return []
        lists = [self.grams[g] for g in bag(text) if g in self.grams]
        shared = np.bincount(np.concatenate(lists), minlength=len(self.texts)) if lists else np.zeros(len(self.texts), int)
        common = np.full(len(self.texts), -1)
        for w in set(text.split()):
            if w in self.words:
                common[self.words[w]] += len(w) + 1
        return np.flatnonzero(bound(shared, len(text), self.len, n, self.n, common)).tolist()

    def scores(self, text: str, places: list[int], score: Callable[[str, str], float]) -> list[float]:
        if score is not sim.ratio:
            return [score(text, self.texts[k]) for k in places]
        return [s for at in range(0, len(places), 64) for s in sim.ratio_many(text, [self.masks[k] for k in places[at : at + 64]])]


def _joined(text: str) -> int:
    """The length of a text's distinct words joined; -1 without a word."""
    own = set(text.split())
    return sum(map(len, own)) + len(own) - 1


def _dictionary(right: DataFrame) -> tuple[DataFrame, int] | None:
    """The different texts of ``right`` that have a word, and in how many blocks they are met; None if they are not few."""
    texts = right.toDF("t").where(F.col("t").isNotNull()).distinct()
    n, size = texts.agg(F.count("*"), F.sum(F.length("t"))).first()
    blocks = max(1, -(-n // BLOCK_TEXTS), -(-(size or 0) // BLOCK_CHARS))
    return (texts, blocks) if n <= FEW and blocks <= -(-FEW // BLOCK_TEXTS) else None


def alike_few(left: DataFrame, texts: DataFrame, blocks: int, bound: Bound, score: Callable[[str, str], float], least: float) -> DataFrame:
    """As ``alike``, for a side ``texts`` that ``_dictionary`` gives: each different text of ``left`` meets it block by block."""
    rows = left.toDF("t").where(F.col("t").isNotNull()).distinct()
    if blocks > 1:
        rows = through_files(rows, "parquet")
    made = None
    for b in range(blocks):
        own = sorted(r["t"] for r in texts.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect() if r["t"].split())  # a block of the dictionary, sent to the tasks
        pairs = rows.mapInPandas(_meeting(own, bound, score, least), "a string, b string, score double")
        made = pairs if made is None else made.unionByName(pairs)
    return made


def _meeting(texts: list[str], bound: Bound, score: Callable[[str, str], float], least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = Block(texts)
        for part in parts:
            found = [(a, texts[k], s) for a in part["t"] if (places := block.met(a, bound)) for k, s in zip(places, block.scores(a, places, score), strict=True) if s >= least]
            yield pd.DataFrame(found, columns=["a", "b", "score"])

    return run


def within(factor: float) -> Callable[[Column, Column], Column]:
    """Lengths no further apart than ``factor``."""
    return lambda la, lb: (la * factor >= lb) & (lb * factor >= la)


def alike_ratio(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs with a plain ratio of ``least`` (over 66.7) at least."""
    few = _dictionary(right)
    if few:
        return alike_few(left, *few, ratio_bound(_sure(least)), sim.ratio, least)
    return alike(left, right, whole(_sure(least)), sim.ratio, least, within((200 - least) / least + 1e-9))


def alike_words(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs with a word-set ratio of ``least`` (over 66.7) at least."""
    few = _dictionary(right)
    if few:
        return alike_few(left, *few, words_bound(_sure(least)), sim.token_set_ratio, least)
    return alike(left, right, words(_sure(least)), sim.token_set_ratio, least)


def _sure(least: float) -> float:
    if least <= 200 / 3:
        raise ValueError("under two thirds two texts may be alike without a common gram")
    return least


#: The weighted score's factors: word sets and sorted words, texts of unlike lengths (to 8 times, beyond).
BY_WORDS, UNLIKE, FAR = 0.95, 0.9, 0.6
LIKE_LENGTH, FAR_LENGTH = 1.5, 8.0
SHARED_WORD = 100.0 * BY_WORDS * UNLIKE  # what a common word gives two texts of unlike lengths


def weighted_need(score: float) -> Need:
    """Shared grams of two texts whose weighted ratio is ``score`` at least, but for what a common word alone gives."""
    parts = [whole(score), words(min(100.0, score / BY_WORDS))] if score <= 100 * BY_WORDS else [whole(score)]
    if score <= 100 * UNLIKE:
        parts.append(stretch(score / UNLIKE))
    return least_of(*parts)


def best_weighted(left: DataFrame, right: DataFrame, least: float = 75.0) -> DataFrame:
    """``a, b, score``: for each text of ``left`` the text of ``right`` with the best weighted ratio of ``least`` (over
    66.7) at least, ties to the last by name; texts without one have no row.

    High scores are looked for first, where the filters are sharp; only texts that found nothing go on to the next
    lower bound.  A common word makes every two texts whose lengths differ by 1.5 to 8 times score ``SHARED_WORD``, so
    there the last name of each word and length stands for all others: it is an equi-join with one row per word and length.
    """
    _sure(least)
    left, right = left.toDF("a").where("a is not null").distinct(), right.toDF("b").where("b is not null").distinct()
    steps = sorted({s for s in (95.0, SHARED_WORD) if s > least} | {least}, reverse=True)
    open_, found = left, None
    for step in steps:
        pairs = alike(open_, right, weighted_need(step), sim.weighted_ratio, step, within(FAR_LENGTH + 1e-9))
        if step <= SHARED_WORD:
            pairs = pairs.unionByName(_by_word(open_, right))
        best = through_files(pairs.groupBy("a").agg(F.max(F.struct("score", "b")).alias("m")).select("a", "m.b", "m.score"), "parquet")
        found = best if found is None else found.unionByName(best)
        open_ = left.join(found.select("a"), "a", "left_anti")
    return found


def _by_word(left: DataFrame, right: DataFrame) -> DataFrame:
    word = lambda c: F.explode(F.array_distinct(F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != ""))).alias("w")
    last = right.select(word(F.col("b")), F.length("b").alias("lb"), "b").groupBy("w", "lb").agg(F.max("b").alias("b"))
    longer = F.greatest("la", "lb") / F.least("la", "lb")
    met = left.select("a", F.length("a").alias("la"), word(F.col("a"))).join(last, "w").where((longer >= LIKE_LENGTH) & (longer <= FAR_LENGTH))
    return met.groupBy("a").agg(F.max("b").alias("b")).select("a", "b", F.lit(SHARED_WORD).alias("score"))
