"""Language identification by prediction by partial matching (PPM).

One byte context tree per language, of depth ``ORDER``, with escape probabilities by method C and
full exclusion.  The statistics are frozen after training, so the code length of a byte depends only
on the bytes before it: the tree walk, escapes included, is worked out once per (node, byte,
language) and scoring a text is two table look-ups per byte.  A text belongs to the language that
codes it shortest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import Texts, enter, slices, trim

ORDER = 3
MOST_TRAINING_DOCS = 1_500  # per language; a documented bound on the sample that the trees are grown on
MOST_LANGUAGES = 50  # the most frequent ones are learnt; a documented bound on the labels, and so on the model
UNKNOWN = "und"
_PAD = 10  # the byte before a text's first
_CHUNK = 2_048  # longest contexts worked out at once


@dataclass(frozen=True)
class Trees:
    """The frozen statistics as tables; every context that training saw has its exact costs.

    ``codes``: byte to symbol.  ``node``: last two symbols to a node.  ``cost``: nats per language, first of each
    (node, symbol), then the entries of the longest contexts.  ``deep``: last three symbols to a longest context
    (-1: not seen).  ``rank``: (node, symbol) to the place among a longest context's entries, which start at
    ``begin`` (-1: none, so the node's cost and the context's ``shift`` hold).
    """

    languages: list[str]
    codes: np.ndarray
    node: np.ndarray
    rank: np.ndarray
    deep: np.ndarray
    begin: np.ndarray
    shift: np.ndarray
    cost: np.ndarray

    @property
    def symbols(self) -> int:
        return self.rank.shape[1]


def contexts(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """For each byte, the bytes one, two and three places before it in its text (padded at the start)."""
    out, start = [], offs[:-1]
    for back in range(1, ORDER + 1):
        before = np.full(len(data), _PAD, data.dtype)
        before[back:] = data[:-back]
        for j in range(back):
            at = start + j
            before[at[at < offs[1:]]] = _PAD
        out.append(before)
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each (context, byte) of ``ORDER + 1`` bytes occurs in each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language_id")
        held: dict[str, list] = {}
        for batch in batches:
            for part in slices(batch, 1):
                t = Texts(pc.utf8_lower(part.column(1)))
                one, two, three = (x.astype(np.int64) for x in contexts(t.data, t.offs))
                grams = ((three << 8 | two) << 8 | one) << 8 | t.data
                langs = np.repeat(np.arange(t.n), np.diff(t.offs))
                names = part.column(0).to_pylist()
                for lang in sorted(set(names)):
                    mine = np.array([x == lang for x in names])
                    held.setdefault(lang, []).append(np.unique(grams[mine[langs]], return_counts=True))
        for lang, found in held.items():
            gram, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in found]), len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram, pa.int64()), pa.array(n)], ["lang", "gram", "n"])

    return docs.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_trees(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Trees:
    """Freeze the counts into the node and cost tables.  ``lang`` indexes ``languages``."""
    used = np.unique(np.concatenate([(gram >> s) & 255 for s in (0, 8, 16, 24)] + [np.array([_PAD])]))
    size = len(used) + 1  # symbol 0: a byte that training has not seen
    codes = np.zeros(256, np.int32)
    codes[used] = np.arange(1, size)
    parts = [codes[(gram >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0)]
    symbol = parts[3]
    # contexts of each length as numbers; the shorter ones are suffixes of the longer ones
    ctx = [np.zeros(len(gram), np.int64), parts[2], parts[1] * size + parts[2], (parts[0] * size + parts[1]) * size + parts[2]]
    kept, counts = [], []
    for k in range(ORDER):
        found, slot = np.unique(ctx[k], return_inverse=True)
        table = np.zeros((len(languages), len(found), size), np.float32)
        np.add.at(table, (lang, slot, symbol), n)
        kept.append(found)
        counts.append(table)
    costs, escapes = [], []
    for k in range(ORDER):
        up = [np.searchsorted(kept[j], kept[k] % size**j) for j in range(k + 1)]
        cost = np.zeros((len(kept[k]), size, len(languages)), np.float32)
        own = np.zeros((len(kept[k]), len(languages)), np.float32)
        for one in range(len(languages)):
            escape, out, known = np.zeros(len(kept[k])), np.zeros((len(kept[k]), size)), np.zeros((len(kept[k]), size), bool)
            for j in range(k, -1, -1):
                c = np.where(known, 0, counts[j][one][up[j]]).astype(np.float64)
                seen, leave = _method_c(c)
                out = np.where(c > 0, escape[:, None] + seen, out)
                escape = escape + leave
                if j == k:
                    own[:, one] = leave
                known |= c > 0
            cost[:, :, one] = np.where(known, out, (escape + np.log(np.maximum(256 - known.sum(1), 1)))[:, None])
        costs.append(cost)
        escapes.append(own)
    first = np.cumsum([0, *(len(x) for x in kept)])
    every = np.arange(size ** (ORDER - 1))
    node = np.zeros(len(every), np.int32)  # the root
    for k in range(1, ORDER):
        at = np.searchsorted(kept[k], every % size**k).clip(0, len(kept[k]) - 1)
        node = np.where(kept[k][at] == every % size**k, first[k] + at, node).astype(np.int32)
    # of a longest context, the symbols that its suffix was seen with (in any language) have entries; for all
    # others the walk goes on below the suffix, so the suffix's cost differs by the escapes only
    listed = (counts[-1] > 0).any(0)
    rank = np.full((first[-1], size), -1, np.int16)
    rank[first[ORDER - 1] :] = np.where(listed, np.cumsum(listed, 1) - 1, -1)
    longest, slot = np.unique(ctx[ORDER], return_inverse=True)
    parent = np.searchsorted(kept[-1], longest % size ** (ORDER - 1))
    begin = np.cumsum(np.concatenate([[0], listed.sum(1)[parent]]))
    entry = np.zeros((begin[-1], len(languages)), np.float32)
    shift = np.zeros((len(longest), len(languages)), np.float32)
    order = np.argsort(slot, kind="stable")
    bounds = np.searchsorted(slot[order], np.arange(0, len(longest) + _CHUNK, _CHUNK))
    for part in range(len(bounds) - 1):
        low, high, rows = part * _CHUNK, min((part + 1) * _CHUNK, len(longest)), order[bounds[part] : bounds[part + 1]]
        table = np.zeros((len(languages), high - low, size))
        np.add.at(table, (lang[rows], slot[rows] - low, symbol[rows]), n[rows])
        up, inside = parent[low:high], listed[parent[low:high]]
        for one in range(len(languages)):
            here, leave = _method_c(table[one])
            below, leave_below = _method_c(np.where(table[one] > 0, 0, counts[-1][one][up]).astype(np.float64))
            shift[low:high, one] = leave + leave_below - escapes[-1][up, one]
            out = np.where(counts[-1][one][up] > 0, leave[:, None] + below, costs[-1][up, :, one] + shift[low:high, one][:, None])
            entry[begin[low] : begin[high], one] = np.where(table[one] > 0, here, out)[inside]
    deep = np.full(size**ORDER, -1, np.int32)
    deep[longest] = np.arange(len(longest))
    cost = np.concatenate([*(x.reshape(-1, len(languages)) for x in costs), entry])
    return Trees(languages, codes, node, rank, deep, begin[:-1] + first[-1] * size, shift, cost)


def _method_c(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context (row): nats of each symbol that has a count (others: infinite), and of the escape (0 without any)."""
    total, kinds = counts.sum(1), (counts > 0).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = np.log((total + kinds)[:, None] / counts)
        return seen, np.where(kinds > 0, np.log((total + kinds) / np.maximum(kinds, 1)), 0.0)


def train(docs: DataFrame, most: int = MOST_TRAINING_DOCS, most_languages: int = MOST_LANGUAGES) -> Trees | None:
    """Grow the trees on a bounded, hash-chosen sample per language of ``docs`` (doc_id, text, lang).

    Rows with a null text or language teach nothing; of more than ``most_languages`` labels the most frequent
    are learnt (ties: the first by name).  None when there is nothing to learn from.
    """
    rows = docs.where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, most / v))])
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share[F.col("lang")] * (1 << 40))
    t = count_grams(sample.select("lang", "text")).toArrow()
    if not len(t):
        return None
    languages = sorted(set(t.column("lang").to_pylist()))
    lang = np.searchsorted(languages, t.column("lang").to_numpy())
    trees = build_trees(languages, lang, t.column("gram").to_numpy(), t.column("n").to_numpy())
    del t, lang
    trim()
    return trees


def code_lengths(trees: Trees, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Nats that each language's tree needs for each text, and the texts' lengths in bytes."""
    t = Texts(pc.utf8_lower(column))
    size, c = trees.symbols, trees.codes[t.data]
    one, two, three = (trees.codes[x] for x in contexts(t.data, t.offs))
    at = trees.node[two * size + one] * size + c
    deep, place = trees.deep[(three * size + two) * size + one], trees.rank.ravel()[at]
    entered = (deep >= 0) & (place >= 0)
    shifted = np.flatnonzero((deep >= 0) & ~entered)
    at = np.where(entered, trees.begin[deep] + place, at)
    total, length = np.zeros((t.n, len(trees.languages))), np.diff(t.offs)
    if len(at):
        cost = trees.cost[at]
        cost[shifted] += trees.shift[deep[shifted]]
        full = np.flatnonzero(length)
        total[full] = np.add.reduceat(cost, t.offs[full], 0, np.float64)
    return total, length


def identify(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``lang_score`` (posterior under equal priors) and
    ``lang_bits`` (bits per byte in the best language).

    Null texts, texts without a letter, and all texts where nothing was learnt are ``und`` with score
    0.  Ties go to the first language by name.  Rows are kept as they are, repeated ones too;
    columns of ``docs`` with these three names are replaced.
    """
    spark, docs = docs.sparkSession, docs.drop("lang_pred", "lang_score", "lang_bits")
    held = spark.sparkContext.broadcast(trees)  # bounded by MOST_TRAINING_DOCS and MOST_LANGUAGES; grows with neither rows nor texts scored
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("language_id")
        model = held.value
        for batch in batches:
            for part in slices(batch, column, 1 << 20):
                text = part.column(column)
                known = np.asarray(pc.match_substring_regex(text.cast(pa.large_string()), r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False), bool)
                if model is None:
                    pred, score, bits = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
                else:
                    nats, length = code_lengths(model, text)
                    best = nats.argmin(1)
                    least = nats.min(1)
                    score = np.where(known, 1 / np.exp(np.maximum(least[:, None] - nats, -700)).sum(1), 0.0)
                    bits = least / np.maximum(length, 1) / np.log(2)
                    pred = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(bits)], [*part.schema.names, "lang_pred", "lang_score", "lang_bits"])

    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_bits", DoubleType())])
    return docs.mapInArrow(run, schema)


def language_scores(docs: DataFrame, most: int = MOST_TRAINING_DOCS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: trained outside the held-out fold, applied to every row.

    Only the text is an input of a prediction; a document's own ``lang`` is read in training alone.
    """
    fold = "coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)"
    trees = train(docs.select("doc_id", "text", "lang").where(f"not {fold}"), most)
    out = identify(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", F.expr(fold).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_bits").alias("bits_per_byte"))
