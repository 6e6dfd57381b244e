"""Statistics of whole texts, the common input of the two quality models.

One pass over the texts; everything is counted with prefix sums over the byte array of a slice of
rows, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, enter, slices, windows

#: The symbols counted by ``n_symbols``.
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbol_rate", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "exclaim_rate", "pipe_rate", "stop_rate", "non_ascii_share", "distinct_share", "same_next_share", "log_line_length",
)
STATS_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
_U = np.uint64


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL, _PIPE, _EXCLAIM, _DIGIT = _table(SYMBOLS), _table("|"), _table("!"), _table("0123456789")
_UPPER, _LETTER, _STOP = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), _table(".,;:?")
_LEADS = np.ones(256, bool)
_LEADS[0x80:0xC0] = False  # the other bytes of a character
_WIDE = np.zeros(256, bool)
_WIDE[0xC0:] = True


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offs])


def _first_of_each(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """True where (owner, h) is the first of its kind."""
    key = h ^ (owner.astype(_U) * _U(0xA24BAED4963EE407))
    _, first = np.unique(key, return_index=True)
    out = np.zeros(len(h), bool)
    out[first] = True
    return out


def text_stats(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The contract's counts, and the feature matrix, of a column of texts (null as empty)."""
    t = Texts(column).words()
    n, offs, word_offs = t.n, t.offs, t.word_offs
    n_words = np.diff(word_offs)
    owner = np.repeat(np.arange(n), n_words)
    h = t.word_hashes()
    leads = _LEADS[t.data]
    lead_sum = np.zeros(len(leads) + 1, np.int64)
    np.cumsum(leads, out=lead_sum[1:])
    in_words = np.zeros(len(h) + 1, np.int64)
    np.cumsum(lead_sum[t.end] - lead_sum[t.start], out=in_words[1:])
    word_chars = np.diff(in_words[word_offs])

    # a line runs from its text's start, or the byte after a \n, to the next \n or its text's end
    breaks = np.flatnonzero(t.data == 10)
    line_start = np.concatenate([offs[:-1], breaks + 1])
    line_owner = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, "right") - 1])
    line_end = np.minimum(np.append(breaks, offs[-1])[np.searchsorted(breaks, line_start)], offs[line_owner + 1])
    has_word = np.searchsorted(t.start, line_end) > np.searchsorted(t.start, line_start)
    order = np.argsort(line_start[has_word], kind="stable")
    ls, le, lo = (v[has_word][order] for v in (line_start, line_end, line_owner))
    dup = ~_first_of_each(lo, t.hashes(ls, le))
    n_lines = np.bincount(lo, minlength=n)
    n_dup = np.bincount(lo[dup], minlength=n)

    w, first = windows(h, word_offs, 3)
    repeated = np.zeros(len(h), bool)
    if len(w):
        key = w ^ (owner[first].astype(_U) * _U(0xA24BAED4963EE407))
        order = np.argsort(key, kind="stable")
        k = key[order]
        eq = np.zeros(len(k), bool)
        eq[1:] = k[1:] == k[:-1]
        eq[:-1] |= k[1:] == k[:-1]
        at = first[order[eq]]
        for j in range(3):
            repeated[at + j] = True
    n_repeat = _per_text(repeated, word_offs)
    counts = dict(zip(COUNTS, (n_words, word_chars, _per_text(_SYMBOL[t.data], offs), n_dup, n_repeat), strict=True))

    next_same = np.zeros(len(h), bool)
    if len(h) > 1:
        next_same[:-1] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    words1, chars1, lines1 = np.maximum(n_words, 1), np.maximum(word_chars, 1), np.maximum(n_lines, 1)
    f = np.column_stack([
        np.log1p(n_words), word_chars / words1, counts["n_symbols"] / words1, n_dup / lines1, n_repeat / words1,
        _per_text(_UPPER[t.data], offs) / np.maximum(_per_text(_LETTER[t.data], offs), 1), _per_text(_DIGIT[t.data], offs) / chars1,
        _per_text(_EXCLAIM[t.data], offs) / words1, _per_text(_PIPE[t.data], offs) / words1, _per_text(_STOP[t.data], offs) / words1,
        _per_text(_WIDE[t.data], offs) / chars1, _per_text(_first_of_each(owner, h), word_offs) / words1,
        _per_text(next_same, word_offs) / words1, np.log1p(n_words / lines1),
    ]).astype(np.float64)
    return counts, f


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and features per document (a null text counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("doc_stats")
        for batch in batches:
            for part in slices(batch, 1):
                counts, f = text_stats(part.column(1))
                lists = pa.ListArray.from_arrays(np.arange(len(f) + 1, dtype=np.int32) * f.shape[1], f.ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[c], pa.int64()) for c in COUNTS), lists], ["doc_id", *COUNTS, "features"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, STATS_SCHEMA)


def labelled(stats: DataFrame, labels: DataFrame, label_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a bounded sample of labelled rows outside the held-out fold.

    ``most`` rows at most, the first by a hash of the id; a document labelled twice counts once
    (the smaller label), and null labels teach nothing.
    """
    one = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y is not null and crc32(cast(doc_id as string)) % 4 <> 2")
        .groupBy("doc_id").agg(F.min("y").alias("y"))
    )
    rows = stats.select("doc_id", "features").join(one, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("features", "y").toArrow()
    x = np.asarray(rows.column("features").combine_chunks().flatten(), np.float64).reshape(len(rows), len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    return x, (np.asarray(rows.column("y"), np.int64) > 0).astype(np.float64)
