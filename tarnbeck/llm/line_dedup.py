"""Line deduplication by a deletion-neighbourhood join.

The unit of an edit is a word, or a character in scripts that put no spaces between words, and the
bound is one edit: two lines match when one becomes the other by replacing, inserting or deleting at
most one unit (called word below).  A line of n words has n + 1 variants: itself,
and itself without one word.  Lines that differ by a replacement share the variant without that word
(same hash, same position); lines that differ by an insertion share the shorter line.  So the
earliest match of a line is a minimum over rows with an equal hashed key: no pairs are made.

Lines with the same words are one class, which stands at its earliest place; the join is between
classes, and each line then takes the earlier of its class's first line and its class's earliest match.
So the result is that of all lines against all earlier ones, whatever files or slices they lie in.

What is no variant of anything else is not sent: a match leaves the first or the last half of the
words untouched, so only lines that share a half with another distinct line have variants emitted
(behind a Bloom filter sized by their number, up to 128 MB; where it is full, more is sent, never less).
Of equal keys in a slice only the earliest is sent at first; the keys that several classes have, with the
earliest of each, then meet their classes in a second pass, where a hot key is dealt out to many tasks.
Candidates are verified on the words themselves.  Lines too short for an edit to tell anything are
matched as they are, where that is asked for: they have hashes, but no halves and no variants.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _IS_SPACE, Texts, bloom, bloom_bits, discard, enter, inside, join_split, materialise, mix, signed, slices, trim

LEAST_WORDS = 5  # shorter lines match none that differs; a character of UNSPACED counts half a word
#: Scripts without spaces (Thai to Tibetan, Myanmar, Khmer, kana and ideographs, full-width forms).
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3001, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFF9F), (0x20000, 0x3FFFF))
_CHARS = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED)
_UNIT = re.compile(rf"[{_CHARS}]|[^\x20\x09-\x0D{_CHARS}]+")
NO_ID = 2**63 - 1  # stands for a null id, which comes last
_U = np.uint64
_C = 0xD1B54A32D192ED03
_E = 0x8CB92BA72F3D8DD7
LINES = "doc_id long, row long, line_no long, h long, g long, p1 long, s1 long, p2 long, s2 long"
_powers: list[np.ndarray] = [np.ones(1, _U)] * 4


def _tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_C, pow(_C, -1, 2**64), _E, pow(_E, -1, 2**64))):
            x = np.full(1 << max(16, (n - 1).bit_length()), _U(base))
            x[0] = _U(1)
            _powers[k] = np.cumprod(x)
    return _powers


class _Units(Texts):
    """Texts whose words are cut around each character of ``UNSPACED``; sets ``half``, the words that are one."""

    def words(self) -> "_Units":
        super().words()
        d = self.data
        lead = np.flatnonzero(d >= 0xE0)
        more = [d[np.minimum(lead + k, len(d) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
        first, long = d[lead].astype(np.int64), d[lead] >= 0xF0
        code = ((first & 0x0F) << 12) | (more[0] << 6) | more[1]
        code = np.where(long, ((first & 0x07) << 18) | (more[0] << 12) | (more[1] << 6) | more[2], code)
        own = np.zeros(len(lead), bool)
        for a, b in UNSPACED:
            own |= (code >= a) & (code <= b)
        at, after = lead[own], (lead + 3 + long)[own]
        self.half = np.zeros(len(self.start), bool)
        if len(at):
            follows = after[after < len(d)]
            follows = follows[~_IS_SPACE[d[follows]]]
            precedes = at[at > 0]
            precedes = precedes[~_IS_SPACE[d[precedes - 1]]]
            self.start = np.unique(np.concatenate([self.start, at, follows]))
            self.end = np.unique(np.concatenate([self.end, after, precedes]))
            self.word_offs = np.searchsorted(self.start, self.offs)
            self.half = np.isin(self.start, at)
        return self


class Lines:
    """The lines of a column of texts that can match with an edit (``near``), or all with a word, and hashes of their parts."""

    def __init__(self, column: pa.Array, short: bool = False, least: int = LEAST_WORDS):
        self.t = t = _Units(column).words()
        breaks = np.flatnonzero(t.data == 10)
        start = np.concatenate([t.offs[:-1], breaks + 1])
        owner = np.concatenate([np.arange(t.n), np.searchsorted(t.offs, breaks, "right") - 1])
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        end = np.minimum(np.append(breaks, t.offs[-1])[np.searchsorted(breaks, start)], t.offs[owner + 1])
        number = np.arange(len(start)) - np.searchsorted(owner, owner)
        a, b = np.searchsorted(t.start, start), np.searchsorted(t.start, end)
        halves = np.concatenate([[0], np.cumsum(t.half)])
        near = 2 * (b - a) - (halves[b] - halves[a]) >= 2 * least
        keep = (b > a) if short else near
        self.near = near[keep]
        self.start, self.end, self.owner, self.number, self.a, self.b = (x[keep] for x in (start, end, owner, number, a, b))
        self.n = self.b - self.a
        w = t.word_hashes()
        self.up, self.down, other, self.back = _tables(len(w) + 1)
        self.sums, self.more = np.zeros(len(w) + 1, _U), np.zeros(len(w) + 1, _U)
        np.cumsum(w * self.up[: len(w)], out=self.sums[1:])
        np.cumsum(mix(w) * other[: len(w)], out=self.more[1:])

    def words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The plain polynomial of words a to b, as if they came first."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def second(self) -> np.ndarray:
        """Another hash of each line's words, of other word values and another multiplier."""
        return mix((self.more[self.b] - self.more[self.a]) * self.back[self.a] + self.n.astype(_U))


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _emit_lines(docs: DataFrame, short: bool, least: int) -> DataFrame:
    """Every line with its hashes; those of its halves are null where no edit is allowed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("line_dedup")
        for batch in batches:
            for part in slices(batch, 1):
                x = Lines(part.column(1), short, least)
                h = mix(x.words(x.a, x.b) + x.n.astype(_U))
                owner = pa.array(x.owner)
                cols = [part.column(0).take(owner), part.column(2).take(owner), x.number, signed(h), signed(x.second())]
                for half in (x.n // 2, (x.n - 1) // 2):
                    salt = half.astype(_U) * _U(0x9E3779B97F4A7C15)
                    first, last = mix(x.words(x.a, x.a + half) + salt), mix(x.words(x.b - half, x.b) + salt + _U(1))
                    cols += [pa.array(signed(first), mask=~x.near), pa.array(signed(last), mask=~x.near)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], _names(LINES))

    return docs.mapInArrow(run, LINES)


class _Variants:
    """The variants of a slice's classes that are in a filter, each class at its earliest line in the slice.

    ``at``: the lines, in order of place.  ``line``: for each variant, its line's place in ``at``.
    ``key``: hash of the variant's words and of what was cut from where; ``v``: of its words alone.
    """

    def __init__(self, part: pa.RecordBatch, least: int, filled: np.ndarray):
        self.x = x = Lines(part.column(1), least=least)
        h = mix(x.words(x.a, x.b) + x.n.astype(_U))
        ids, rows = np.asarray(part.column(0), np.int64), np.asarray(part.column(2), np.int64)
        at = np.flatnonzero(inside(filled, h))
        at = at[np.lexsort((x.number[at], rows[x.owner[at]], ids[x.owner[at]]))]
        at = self.at = at[np.sort(np.unique(h[at], return_index=True)[1])]
        self.h, self.ids, self.rows = h[at], ids[x.owner[at]], rows[x.owner[at]]
        n, a, b = x.n[at], x.a[at], x.b[at]
        self.line = line = np.repeat(np.arange(len(at)), n + 1)
        p = np.arange(len(line)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1) - 1  # -1: the line itself
        la, lb = a[line], b[line]
        cut = la + np.maximum(p, 0)
        without = x.words(la, cut) + x.words(np.minimum(cut + 1, lb), lb) * x.up[cut - la]
        self.v = np.where(p < 0, self.h[line], mix(without + (lb - la - 1).astype(_U)))
        self.whole = p < 0
        self.key = self.v ^ mix((p + 2).astype(_U))


VARIANTS = "v long, key long, whole boolean, doc_id long, row long, line_no long, h long, times long"


def _emit_variants(docs: DataFrame, least: int, filled) -> DataFrame:
    """Of each key in a slice the earliest class, with the number of classes there that have the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("line_dedup")
        for batch in batches:
            for part in slices(batch, 1):
                y = _Variants(part, least, filled.value)
                _, first, times = np.unique(y.key, return_index=True, return_counts=True)  # variants lie in order of place
                line = y.line[first]
                cols = signed(y.v[first]), signed(y.key[first]), y.whole[first], y.ids[line], y.rows[line], y.x.number[y.at[line]], signed(y.h[line]), times.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], _names(VARIANTS))

    return docs.mapInArrow(run, VARIANTS)


def _emit_shared(docs: DataFrame, least: int, filled, shared) -> DataFrame:
    """``key, h, line``: the keys of each class in a slice that are in the filter ``shared``, and (without a key) its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("line_dedup")
        for batch in batches:
            for part in slices(batch, 1):
                y = _Variants(part, least, filled.value)
                own = inside(shared.value, y.key)
                key, line = y.key[own], y.line[own]
                with_one = np.unique(line)
                raw, at = y.x.t.data.tobytes(), y.at[with_one]
                texts = [raw[s:e].decode() for s, e in zip(y.x.start[at].tolist(), y.x.end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(y.h[line])), pa.nulls(len(key), pa.string())], ["key", "h", "line"])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(signed(y.h[with_one])), pa.array(texts, pa.string())], ["key", "h", "line"])

    return docs.mapInArrow(run, "key long, h long, line string")


def _one_edit(a: str, b: str) -> bool:
    """Whether at most one word is replaced, inserted or deleted between two lines."""
    x, y = _split(a), _split(b)
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    if len(x) == len(y):
        return x[i + 1 :] == y[i + 1 :]
    return x[i + 1 :] == y[i:] if len(x) > len(y) else x[i:] == y[i + 1 :]


def _split(line: str) -> list[str]:
    return _UNIT.findall(line)


def _near(docs: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """``h, near``: for each class the earliest (doc_id, row, line_no) of another class within one edit."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    halves = firsts.where("p1 is not null").select("h", F.explode(F.array_distinct(F.array("p1", "s1", "p2", "s2"))).alias("half"))
    several = halves.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("half")
    some = materialise(spark, halves.join(several, "half", "left_semi").select("h").distinct(), "line-halves")
    near_filter = sc.broadcast(bloom(some, "h", bloom_bits(some.count())))
    discard(some)

    # the earliest class of each key; what only one class has is dropped (one shuffle, by the variant)
    place = F.struct("doc_id", "row", "line_no", "h")
    by_key = _emit_variants(docs, least, near_filter).repartition("v").groupBy("v", "key", "whole").agg(F.min(place).alias("m"), F.min("h").alias("low"), F.max("h").alias("high"), F.sum("times").alias("times"), F.max("times").alias("most"))
    of_variant = Window.partitionBy("v")
    keys = (
        by_key.withColumn("as_whole", F.min(F.when(F.col("whole"), F.col("m"))).over(of_variant)).withColumn("as_cut", F.min(F.when(~F.col("whole"), F.col("m"))).over(of_variant))
        .where("low <> high or most > 1 or (whole and as_cut is not null) or (not whole and as_whole is not null)")
        .select("key", F.when(F.col("whole"), F.col("as_cut")).otherwise(F.least("m", "as_whole")).alias("best"), "times")
    )
    keys = materialise(spark, keys, "line-keys")

    key_filter = sc.broadcast(bloom(keys, "key", bloom_bits(keys.count())))
    met = materialise(spark, _emit_shared(docs, least, near_filter, key_filter), "line-classes")
    key_filter.destroy()  # what they helped to make is written
    near_filter.destroy()
    trim()
    found = join_split(met.where("key is not null").select("key", "h"), keys, "key", "times", F.col("h")).where("best.h <> h").groupBy("h").agg(F.min("best").alias("best"))
    found = materialise(spark, found, "line-candidates")

    texts = met.where("key is null").groupBy("h").agg(F.min("line").alias("line"))
    asked = found.groupBy(F.col("best.h").alias("other")).agg(F.count("*").alias("asked"))
    others = texts.select(F.col("h").alias("other"), F.col("line").alias("other_line")).join(asked, "other")
    pairs = join_split(found.withColumn("other", F.col("best.h")).join(texts, "h"), others, "other", "asked", F.col("h"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([_one_edit(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], pa.bool_())).select([0, 1, 2, 3])

    sure = pairs.select("h", "best.doc_id", "best.row", "best.line_no", "line", "other_line").mapInArrow(verify, "h long, doc_id long, row long, line_no long")
    sure = materialise(spark, sure.select("h", F.struct("doc_id", "row", "line_no").alias("near")), "line-near")
    discard(keys, met, found)
    return sure


def _prepared(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row``: what identifies a row is its id and its text, so ``row`` is a hash of the text."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))


def _found(docs: DataFrame, short: bool, least: int) -> DataFrame:
    """``doc_id, row, line_no, m``: each line that goes, with its earliest match (of_doc_id, of_row, of_line_no, edits)."""
    spark = docs.sparkSession
    lines = materialise(spark, _emit_lines(docs.where("text is not null"), short, least), "lines")
    place = F.struct("doc_id", "row", "line_no")
    firsts = lines.groupBy("h", "g").agg(F.min(place).alias("first"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("p1", "s1", "p2", "s2")])
    firsts = materialise(spark, firsts, "line-firsts")
    near = _near(docs.where("text is not null"), firsts.select("h", "p1", "s1", "p2", "s2"), least)

    of = firsts.select("h", "g", "first", "times").join(near, "h", "left").where("times > 1 or near is not null")
    of = materialise(spark, of.withColumn("class", F.struct("h", "g")).drop("h", "g"), "line-of")
    discard(firsts, near)
    each = join_split(lines.select("doc_id", "row", "line_no", F.struct("h", "g").alias("class")), of, "class", "times", place)

    def match(earlier: str, edits: int) -> Column:
        x = F.col(earlier)
        return F.when(x < place, F.struct(x["doc_id"].alias("of_doc_id"), x["row"].alias("of_row"), x["line_no"].alias("of_line_no"), F.lit(edits).alias("edits")))

    return each.select("doc_id", "row", "line_no", F.least(match("first", 0), match("near", 1)).alias("m")).where("m is not null")


def duplicate_lines(docs: DataFrame, short: bool = False, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, text_hash, line_no, of_doc_id, of_text_hash, of_line_no, edits``: each line that goes, with the earliest it matches.

    A line goes when an earlier one, by (doc_id, hash of the text, line number from 0), matches it: has
    the same words (0 edits) or differs in one (1 edit).  Lines of fewer than ``least`` words go only
    with ``short``, and only when an earlier one has the same words.  Lines without a word and documents
    with a null text take no part.  Null ids come after all others.  Rows that share an id but not the text
    are documents of their own; rows that share both are one document, which is given once for each of
    them and loses no line to itself.  Other columns are ignored; an empty table gives no rows.  A very
    long text is worked on alone; its lines are found like all others.
    """
    rows = _found(_prepared(docs), short, least)
    plain = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c.removeprefix("m."))
    return rows.select(plain("doc_id"), F.col("row").alias("text_hash"), "line_no", plain("m.of_doc_id"), F.col("m.of_row").alias("of_text_hash"), "m.of_line_no", "m.edits")


def dedup_lines(docs: DataFrame, short: bool = False, least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` (all columns, all rows) with the lines of ``duplicate_lines`` cut from their texts.

    Lines are cut from the row that they are in, by its id and text, so rows that share an id lose only
    their own lines.
    """
    mark = "_gone"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = "_" + mark
    gone = _found(_prepared(docs), short, least).groupBy("doc_id", "row").agg(F.collect_set("line_no").alias(mark)).withColumnsRenamed({"doc_id": f"{mark}_id", "row": f"{mark}_row"})
    kept = F.expr(f"array_join(transform(filter(transform(split(text, '\\n', -1), (x, i) -> struct(x, cast(i as bigint) as i)), y -> not array_contains({mark}, y.i)), y -> y.x), '\\n')")
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col(f"{mark}_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{mark}_row"))
    out = docs.join(gone, same, "left")
    return out.withColumn("text", F.when(F.col(mark).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
