"""Benchmark decontamination by template canonicalisation.

Words lose surrounding punctuation and case; numbers, units, quantities and names become typed
placeholders.  Windows of five template words of the benchmark are hashed into a table; every window
of every whole document is probed against it.  Hits near one diagonal (document position minus item
position) are taken together; in them a placeholder's value in the item must always stand for the
same value in the document: a question asked again with other numbers is caught, a text that merely
has the same shape is not.  A capitalised word that begins a sentence may be a name or not: windows with
one are indexed and probed under both readings.

Placeholders say little, so windows with few plain words are no evidence as templates.  Windows of the
lower-cased words themselves are therefore indexed and probed too, whatever the words are: a verbatim
copy is found in any case and of any item.  An item of fewer than five words is one key, the whole of it.

The table is sent to the executors only up to ``MOST_BYTES`` of benchmark text, which is measured;
a larger benchmark is worked through in blocks of that size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, enter, slices, windows

WINDOW = 5
LEAST_COVER = 0.4  # of an item's windows, on one diagonal and those beside it
LEAST_RUN = 13  # or so many consecutive template words
LEAST_PLAIN = 3  # words of a template window that are no placeholders; emptier windows match anything
LEAST_MATCHED = 8  # words of an item, or all of a shorter one, however few windows it has
LEAST_INSIDE = 3  # words of an item that leaks as a sentence or line among others; a shorter one only as the whole text
MOST_BYTES = 32 << 20
LEAKS = "doc_id long, item_id long, n_matched long, n_windows long, longest_run long, n_slots long"

#: Unit words (a unit only after a number).
UNITS = (
    "mm cm m km in ft yd mi g kg mg lb oz t l ml s sec min h hr hrs hour hours day days week weeks month months year years "
    "minutes seconds meters metres miles feet inches grams kilograms pounds liters litres percent dollars euros usd eur"
).split()
_U = np.uint64
PLAIN, NUMBER, UNIT, QUANTITY, NAME = range(5)
_MARK = np.random.default_rng(77).integers(1, 2**63, 5, dtype=np.int64).astype(np.uint64)


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_EDGE = _flags(bytes(i for i in range(33, 127) if not chr(i).isalnum()))
_DIGIT = _flags(b"0123456789")
_ALPHA = _flags(bytes(i for i in range(256) if i >= 0x80 or chr(i).isalpha()))
_STOP = _flags(b".!?:")


def _unit_hashes() -> np.ndarray:
    t = Texts(pa.array(UNITS)).words()
    return np.sort(t.word_hashes())


@dataclass
class Tokens:
    """Words of a column of texts: plain hashes, types, template hashes, where each text's words are, which
    of them begin a sentence or line, and which plain ones may be names there."""

    value: np.ndarray
    kind: np.ndarray
    template: np.ndarray
    offs: np.ndarray
    opens: np.ndarray
    maybe: np.ndarray


def tokenise(column: pa.Array) -> Tokens:
    """Template words of each text.  Words of punctuation alone are left out (but end a sentence)."""
    t = Texts(column).words()
    low = Texts(pc.utf8_lower(column.cast(pa.large_string()))).words()
    n, m = len(t.data), len(low.data)
    inner = np.flatnonzero(~_EDGE[t.data])
    inner_low = np.flatnonzero(~_EDGE[low.data])
    start = np.append(inner, n)[np.searchsorted(inner, t.start)]
    full = start < t.end
    end = np.append(inner, 0)[np.searchsorted(inner, t.end) - 1] + 1
    begins_sentence = np.ones(len(t.start), bool)
    if len(t.start):
        begins_sentence[1:] = _STOP[t.data[t.end[:-1] - 1]]
        begins_sentence[t.word_offs[:-1][np.diff(t.word_offs) > 0]] = True
    owner = np.repeat(np.arange(t.n), np.diff(t.word_offs))
    start, end, begins_sentence = start[full], end[full], begins_sentence[full]
    offs = np.concatenate([[0], np.cumsum(np.bincount(owner[full], minlength=t.n))]).astype(np.int64)
    low_start = np.append(inner_low, m)[np.searchsorted(inner_low, low.start)]
    low_end = np.append(inner_low, 0)[np.searchsorted(inner_low, low.end) - 1] + 1
    value = low.hashes(low_start[full], low_end[full])

    def any_in(table: np.ndarray) -> np.ndarray:
        total = np.zeros(n + 1, np.int64)
        np.cumsum(table[t.data], out=total[1:])
        return total[end] > total[start]

    # the marks between the words left in: a stop or a line's end there begins another sentence or line
    marks = np.zeros(n + 1, np.int64)
    np.cumsum(_STOP[t.data] | (t.data == 10), out=marks[1:])
    opens = np.ones(len(start), bool)
    opens[1:] = marks[start[1:]] > marks[end[:-1]]
    opens[offs[:-1][np.diff(offs) > 0]] = True

    digit, alpha = any_in(_DIGIT), any_in(_ALPHA)
    kind = np.where(digit & ~alpha, NUMBER, np.where(digit & _DIGIT[t.data[start]], QUANTITY, PLAIN)) if len(start) else np.zeros(0, np.int64)
    maybe = np.zeros(len(start), bool)
    if len(start):
        units = _unit_hashes()
        unit = units[np.searchsorted(units, value).clip(0, len(units) - 1)] == value
        unit[1:] &= kind[:-1] == NUMBER
        unit[offs[:-1][np.diff(offs) > 0]] = False
        one = t.data[start]
        two = t.data[np.minimum(start + 1, n - 1)]
        upper = ((one >= 65) & (one <= 90)) | ((one == 0xC3) & (two >= 0x80) & (two <= 0x9E))
        kind = np.where(unit, UNIT, np.where((kind == PLAIN) & upper & ~begins_sentence, NAME, kind))
        maybe = (kind == PLAIN) & upper
    return Tokens(value, kind, np.where(kind == PLAIN, value, _MARK[kind]), offs, opens, maybe)


class _Table:
    """Hashed windows of the benchmark, sorted, with the place of each one's first word."""

    def __init__(self, parts: Iterator[tuple[np.ndarray, np.ndarray]], offs: np.ndarray):
        h, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]
        self.item = np.searchsorted(offs, self.at, "right") - 1
        once = np.unique(self.at)  # a place counts once, however many readings its window has
        self.n_windows = np.bincount(np.searchsorted(offs, once, "right") - 1, minlength=len(offs) - 1)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.hash & _U((1 << 22) - 1)).astype(np.int64)] = True

    def hits(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the texts, item, place in the benchmark) of equal windows."""
        out = [(np.zeros(0, np.int64),) * 3]
        for h, at in parts:
            maybe = self.seen[(h & _U((1 << 22) - 1)).astype(np.int64)]
            h, at = h[maybe], at[maybe]
            first, last = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            n = last - first
            k = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out.append((np.repeat(at, n), self.item[k], self.at[k]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Index:
    """The benchmark's windows; its size is bounded by the caller."""

    def __init__(self, item_ids: list[int], texts: pa.Array):
        self.ids, self.tokens = np.asarray(item_ids, np.int64), tokenise(texts)
        own = self.tokens
        self.size = np.diff(own.offs)
        named = np.flatnonzero(own.kind == NAME)
        self.names = set(zip((np.searchsorted(own.offs, named, "right") - 1).tolist(), own.value[named].tolist(), strict=True))
        self.template, self.plain = _Table(_windows(own), own.offs), _Table(_plain_windows(own), own.offs)
        self.short = {k: _Table(_whole(own, k, own.offs), own.offs) for k in range(1, WINDOW) if (self.size == k).any()}

    def leaks(self, column: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(text, item, matched windows, longest run in words, slots) of every leak in a column of texts."""
        return [x[:2] + x[3:] for x in self.found(column)]

    def found(self, column: pa.Array) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, windows of the item, matched windows, longest run in words, slots) of every leak.

        A leak by its template is given as such, or else by its plain words, or else as a short item.
        """
        if not len(self.tokens.value):
            return []
        doc = tokenise(column)
        out = {(x[0], x[1]): x for x in self._along(doc, self.plain, _plain_windows(doc), False)}
        out |= {(x[0], x[1]): x for x in self._along(doc, self.template, _windows(doc), True)}
        for k, table in self.short.items():
            at, item, _ = table.hits(_whole(doc, k, doc.offs if k < LEAST_INSIDE else None))
            text = np.searchsorted(doc.offs, at, "right") - 1
            out |= {(t, i): (t, i, 1, 1, k, 0) for t, i in zip(text.tolist(), item.tolist(), strict=True)}
        return [out[k] for k in sorted(out)]

    def _along(self, doc: Tokens, table: _Table, parts: Iterator[tuple[np.ndarray, np.ndarray]], slots: bool) -> Iterator[tuple]:
        at, item, there = table.hits(parts)
        text = np.searchsorted(doc.offs, at, "right") - 1
        order = np.lexsort((there, at, item, text))
        text, item, there, at = (x[order] for x in (text, item, there, at))
        new = np.ones(len(at), bool)  # one hit of two windows, however many readings they share
        new[1:] = (at[1:] != at[:-1]) | (there[1:] != there[:-1])
        text, item, there, at = (x[new] for x in (text, item, there, at))
        diagonal = at - there
        if not len(at):
            return
        edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]), [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            i = int(item[a])
            windows = int(table.n_windows[i])
            if len(np.unique(there[a:b])) < LEAST_COVER * windows and b - a + WINDOW - 1 < LEAST_RUN:
                continue
            # the best diagonal, and those beside it that an inserted or lost word would lead to
            ways, counts = np.unique(diagonal[a:b], return_counts=True)
            near = np.abs(diagonal[a:b] - ways[counts.argmax()]) <= max(2, windows // 4)
            matched, run, n_slots, words = self._consistent(doc, i, at[a:b][near], there[a:b][near], slots)
            if (matched >= LEAST_COVER * windows and words >= min(LEAST_MATCHED, int(self.size[i]))) or run >= LEAST_RUN:
                yield int(text[a]), i, windows, matched, run, n_slots

    def _consistent(self, doc: Tokens, item: int, at: np.ndarray, there: np.ndarray, slots: bool) -> tuple[int, int, int, int]:
        """Item windows whose slots agree with those before, the longest run in words, the slots, and the item's words matched."""
        means: dict[tuple[int, int], int] = {}
        runs: dict[int, tuple[int, int]] = {}
        seen, words, longest = set(), set(), 0
        for x, y in zip(at.tolist(), there.tolist(), strict=True):
            pairs = []
            for j in range(WINDOW if slots else 0):
                kind, v, w = int(self.tokens.kind[y + j]), int(self.tokens.value[y + j]), int(doc.value[x + j])
                if self.tokens.maybe[y + j] and (v != w or (item, v) in self.names):
                    kind = NAME  # it stands for another word, or is a name inside a sentence of the item
                if kind != PLAIN:
                    pairs.append((kind, v, w))
            if all(means.get((kind, v), w) == w for kind, v, w in pairs):
                means.update({(kind, v): w for kind, v, w in pairs})
                seen.add(y)
                words.update(range(y, y + WINDOW))
                last, run = runs.get(x - y, (-2, 0))
                run = run + 1 if x == last + 1 else WINDOW
                runs[x - y] = x, run
                longest = max(longest, run)
        return len(seen), longest, len(means), len(words)


def _plain_windows(t: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of the words themselves."""
    yield windows(t.value, t.offs, WINDOW)


def _whole(t: Tokens, k: int, offs: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The texts of ``k`` words, or without ``offs`` the sentences and lines (or runs of them)."""
    h, at = windows(t.value, t.offs, k)
    if offs is None:
        fits = t.opens[at] & np.append(t.opens, True)[at + k]
    else:
        text = np.searchsorted(t.offs, at, "right") - 1
        fits = offs[text + 1] - offs[text] == k
    yield h[fits], at[fits]


def _windows(t: Tokens) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows with enough plain words, under each reading of the words that may be names."""
    h, at = windows(t.template, t.offs, WINDOW)
    plain = np.concatenate([[0], np.cumsum(t.kind == PLAIN)])
    count = plain[np.minimum(at + WINDOW, len(plain) - 1)] - plain[at]
    enough = count >= LEAST_PLAIN
    yield h[enough], at[enough]
    for k in range(1, WINDOW - LEAST_PLAIN + 1):
        for places in combinations(range(WINDOW), k):
            own = at[count - k >= LEAST_PLAIN]
            for j in places:
                own = own[t.maybe[own + j]]
            words = [np.full(len(own), _MARK[NAME]) if j in places else t.template[own + j] for j in range(WINDOW)]
            yield windows(np.stack(words, 1).ravel(), np.arange(len(own) + 1) * WINDOW, WINDOW)[0], own


def _blocks(benchmark: DataFrame, most: int) -> Iterator[Index]:
    """The benchmark's index, in as many blocks as its measured size asks for."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null and item_id is not null")
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        t = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        yield Index(t.column("item_id").to_pylist(), pa.concat_arrays(t.column("text").chunks) if len(t) else pa.array([], pa.string()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """One row per (document, item) that leaks.

    Null and empty texts leak nothing.  An item of three or four words leaks where it is a whole sentence
    or line, one of one or two words where it is the whole text (``n_windows`` is 1); repeated rows give repeated rows; an empty benchmark or table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in _blocks(benchmark, most):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            index = held.value
            for batch in batches:
                for part in slices(batch, 1):
                    found = index.found(part.column(1))
                    ids = part.column(0).to_pylist()
                    rows = [(ids[t], int(index.ids[i]), m, n, r, s) for t, i, n, m, r, s in found]
                    names = [f.strip().split(" ")[0] for f in LEAKS.split(",")]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names)

        one = docs.mapInArrow(run, LEAKS)
        out = one if out is None else out.unionByName(one)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs`` (all columns) that leak no item; no row is shuffled."""
    for index in _blocks(benchmark, most):
        held, column = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], held=held, column=column) -> Iterator[pa.RecordBatch]:
            enter("decontaminate")
            for batch in batches:
                for part in slices(batch, column):
                    keep = np.ones(part.num_rows, bool)
                    keep[[x[0] for x in held.value.leaks(part.column(column))]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
