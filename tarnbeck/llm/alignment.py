"""Alignment of two tokenizers over the same texts, relationally.

A text (with one space before it) is cut where both vocabularies must end a token: between a character that is no
white space and a space, line feed or tab.  ``cut_before`` proves this from the vocabularies: the byte-level pattern
never reaches over such a place, and no piece of the other vocabulary does.  So a text's tokens are those of its
segments, and every number of a document is a sum over its segments.  Each distinct segment is encoded and aligned
once, however often it occurs:

* its tokens of either side are exploded with the bytes where they end;
* the two sides meet on (segment, end).  A row of that is one stretch of bytes between two
  neighbouring ends, so it is one link, and each pair of overlapping tokens has exactly one such stretch; where both
  sides end there is a cut, and the running count of cuts is the group's number;
* the tokens that cover a stretch are the next ones that end; links are counted over the corpus by pair, weighted by
  how often their segment occurs, and the highest count of each B id is the best.

Documents are cut by block of bounded size: a block has a list of its segments, each once with a number, and its documents as
lists of these numbers.  Results return to the blocks that hold a segment, so a frequent one has one row per block, and a
block's documents are put together beside that block's segments alone.  Documents with a segment whose bytes differ (they
have no tokens) are found first and their segments taken out of the counts.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, discard, enter, free_shuffles, join_split, materialise, releases, slices, trim
from .token_files import BYTE_LETTERS

BYTE_VOCABULARY, BYTE_SETTING = "/opt/tokenizers/byte_bpe_50k.json", "spark.tarnbeck.byte.vocabulary"
PIECE_MODEL, PIECE_SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.tarnbeck.piece.model"
BLOCK_DOCS, BLOCK_BYTES = 16_384, 24 << 20  # documents that share one list of segments, and bytes of their texts (a longer text comes alone)
PASSES = 2  # the way back to the documents takes so many, each over a part of the blocks, whose shuffles are freed before the next
LINKED = 1 << 18  # segments of documents that are put together at once
#: White space to any of the three pattern languages in use (Java, Rust, Python), and where a segment may begin.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BEGINS = " \n\t"


class Encoders:
    """Both tokenizers with the bytes of their tokens.  One per worker."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        values = {letter: b for b, letter in BYTE_LETTERS.items()}
        self.a_bytes = {i: bytes(values[c] for c in token) if all(c in values for c in token) else token.encode() for token, i in self.a.get_vocab(True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes, self.mark = [], self.b.piece_to_id("▁")
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())

    def cut_before(self) -> str:
        """The characters of ``BEGINS`` before which a text may be cut.

        No piece has a space after a character that is no white space; no piece has the others after any character,
        so they do not join with the space that the library puts before a segment either.
        """
        pieces = [x.decode("utf-8", "replace") for x in self.b_bytes]
        return "".join(c for c in BEGINS if not any(re.search(f"[^{SPACES}] " if c == " " else f".{c}", p, re.S) for p in pieces))

    def pieces(self, segments: list[str]) -> list[list[int]]:
        """B's ids.  It puts a space before what it encodes: that is a segment's own first one, or it is taken off again."""
        own = [s[:1] == " " for s in segments]
        ids = self.b.encode([s[1:] if o else s for s, o in zip(segments, own, strict=True)], num_threads=1)
        out = []
        for s, o, x in zip(segments, own, ids, strict=True):
            if o:
                out.append(x or [self.mark])  # a lone space
            else:
                out.append(x[1:] if x[:1] == [self.mark] else [-1])  # -1: no such token, so the segment counts as differing
        return out


def paths(spark: SparkSession) -> tuple[str, str]:
    return spark.conf.get(BYTE_SETTING, BYTE_VOCABULARY), spark.conf.get(PIECE_SETTING, PIECE_MODEL)


def split_pattern(cut_before: str) -> str:
    """A pattern of no width where a text is cut, for ``split``."""
    return f"(?<=[^{SPACES}])(?=[{cut_before}])" if cut_before else r"\z.\A"


@contextmanager
def joins_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins on more columns take rows as they lie when both sides are dealt out by one of them.

    Spark's default would deal both sides out again by all columns, token by token.
    """
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, was)


_kept: dict[tuple, Encoders] = {}
releases("alignment", _kept.clear)
_ENCODED = "seg string, n long, same boolean, id long, a array<int>, a_end array<int>, b array<int>, b_end array<int>"


def _encode(segments: DataFrame, files: tuple[str, str]) -> DataFrame:
    """Ids of each segment on both sides with the bytes where they end, and whether both sides' bytes are the segment's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("alignment")
        if files not in _kept:
            _kept[files] = Encoders(*files)
        e = _kept[files]
        for batch in batches:
            for large in slices(batch, 0):
                for at in range(0, large.num_rows, 1024):
                    part = large.slice(at, 1024)
                    texts = part.column(0).to_pylist()
                    sides: list[list] = [[], [], [], []]
                    same = []
                    for s, x, y in zip(texts, e.a.encode_batch_fast(texts, add_special_tokens=False), e.pieces(texts), strict=True):
                        raw, x = s.encode(), x.ids
                        xs, ys = [e.a_bytes[i] for i in x], [e.b_bytes[i] if i >= 0 else b"" for i in y]
                        good = b"".join(xs) == raw and b"".join(ys) == raw
                        same.append(good)
                        for side, values in zip(sides, (x, list(accumulate(map(len, xs))), y, list(accumulate(map(len, ys)))), strict=True):
                            side.append(values if good else [])
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(same), part.column(2), *(pa.array(x, pa.list_(pa.int32())) for x in sides)], ["seg", "n", "same", "id", "a", "a_end", "b", "b_end"])

    return segments.mapInArrow(run, _ENCODED)


def stretches(encoded: DataFrame) -> DataFrame:
    """``id, end, a, b, a_ends, b_ends, back``: the links of each ``id``, the tokens that end there, and the group counted from the last one.

    Rows run from the end backwards, where the token that covers a stretch is the one met last.
    """
    none = F.lit(None).cast("int")
    ends = lambda own, a, b: F.transform(F.arrays_zip(F.col(own).alias("token"), F.col(own + "_end").alias("end")), lambda x: F.struct(x["end"].alias("end"), a(x).alias("a"), b(x).alias("b")))
    both = F.concat(ends("a", lambda x: x["token"], lambda x: none), ends("b", lambda x: none, lambda x: x["token"]))
    tokens = encoded.repartition("id").select("id", F.explode(both).alias("x")).select("id", "x.end", "x.a", "x.b")
    met = tokens.groupBy("id", "end").agg(F.max("a").alias("a_ends"), F.max("b").alias("b_ends"))  # a side has one token that ends there, or none
    backwards = Window.partitionBy("id").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cut = (F.col("a_ends").isNotNull() & F.col("b_ends").isNotNull()).cast("int")
    return met.select("id", "end", F.last("a_ends", True).over(backwards).alias("a"), F.last("b_ends", True).over(backwards).alias("b"), "a_ends", "b_ends", F.sum(cut).over(backwards).alias("back"))


def group_texts(links: DataFrame) -> DataFrame:
    """``id, n_a, n_b, n_groups, pairs, groups``; ``groups`` as ``a1,a2|b1;a3|b2,b3``, ``pairs`` as ``a * 2**32 + b`` of each link.

    All of it by ``id``, as ``links`` are dealt out already.
    """
    ids = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", side)))), lambda x: x[side].cast("string")), ",")
    pair = F.col("a").cast("long") * (1 << 32) + F.col("b")
    groups = links.groupBy("id", "back").agg(F.concat(ids("a_ends"), F.lit("|"), ids("b_ends")).alias("text"), F.count("a_ends").alias("n_a"), F.count("b_ends").alias("n_b"), F.collect_list(pair).alias("own"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "text", "own")))
    whole = groups.groupBy("id").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), order.alias("order"))
    return whole.select("id", "n_a", "n_b", "n_groups", F.flatten(F.transform("order", lambda x: x["own"])).alias("pairs"), F.array_join(F.transform("order", lambda x: x["text"]), ";").alias("groups"))


_WHITE = [[c.encode() for c in SPACES if len(c.encode()) == k] for k in (1, 2, 3)]
_CUT = "block long, code int, seg string, n long, doc_id long, codes array<int>"


def segments_of(texts: pa.Array, cut_before: str) -> tuple[pa.Array, np.ndarray]:
    """The segments of all texts with a space before each, one after another, and where each text's begin (one more than there are texts).

    They are those that ``split_pattern`` cuts; a text that is null or empty has none.
    """
    texts = texts.fill_null("").cast(pa.large_string())
    t = Texts(pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))))
    data = t.data
    begin, white = np.zeros(256, bool), np.zeros(256, bool)
    begin[[ord(c) for c in cut_before]] = True
    white[[c[0] for c in _WHITE[0]]] = True
    after = white[data]  # the last byte of a white character
    for k in (2, 3):
        for first in {c[0] for c in _WHITE[k - 1]}:
            at = np.flatnonzero(data[: len(data) - k + 1] == first)
            rest = [c for c in _WHITE[k - 1] if c[0] == first]
            after[at[np.any([np.all([data[at + j] == c[j] for j in range(1, k)], 0) for c in rest], 0)] + k - 1] = True
    starts = begin[data]
    starts[1:] &= ~after[:-1]
    starts[t.offs[:-1][np.diff(t.offs) > 0]] = True  # offs reaches len(data) only for empty texts
    starts = np.flatnonzero(starts)
    segs = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return segs, np.searchsorted(starts, t.offs)


def _blocks(batches: Iterator[pa.RecordBatch], docs: int, most: int) -> Iterator[pa.Table]:
    """Rows in order, in tables of so many rows and bytes of text (the second column) at most."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for part in slices(batch, 1):
            own = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if held and size + own > most:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
            while rows + part.num_rows >= docs:
                yield pa.Table.from_batches([*held, part.slice(0, docs - rows)])
                part = part.slice(docs - rows)
                held, rows, size = [], 0, 0
            if part.num_rows:
                held.append(part)
                rows, size = rows + part.num_rows, size + own
    if held:
        yield pa.Table.from_batches(held)


def _cut(docs: DataFrame, cut_before: str) -> DataFrame:
    """By block: ``code, seg, n``, a row for each different segment, and ``doc_id, codes``, a row for each document."""
    most_docs, most_bytes = BLOCK_DOCS, BLOCK_BYTES
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["block", "code", "seg", "n", "doc_id", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("alignment")

        def rows(block: int, size: int, **columns) -> Iterator[pa.RecordBatch]:
            whole = pa.RecordBatch.from_arrays([pa.array(np.full(size, block)), *(columns.get(c, pa.nulls(size, k)) for c, k in zip(names[1:], kinds[1:], strict=True))], names)
            for at in range(0, size, 4096):
                yield whole.slice(at, 4096)

        for k, part in enumerate(_blocks(batches, most_docs, most_bytes)):
            block = (TaskContext.get().partitionId() << 32) + k
            segs, offs = segments_of(part.column(1).combine_chunks(), cut_before)
            known = segs.dictionary_encode()
            codes = known.indices.to_numpy()
            n = len(known.dictionary)
            yield from rows(block, n, code=pa.array(np.arange(n, dtype=np.int32)), seg=known.dictionary.cast(pa.string()), n=pa.array(np.bincount(codes, minlength=n)))
            yield from rows(block, len(part), doc_id=part.column(0).combine_chunks(), codes=pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(codes.astype(np.int32))))
            trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _CUT)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and where each row's begin."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(), np.append(0, np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64)))


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[offs[1:]] - total[offs[:-1]]


def _without_tokens(docs: pa.Table, bad: pa.Table) -> pa.Table:
    """Of a block: how often each segment occurs in documents that hold one of the segments ``bad``."""
    codes, offs = _lists(docs["codes"])
    wrong = np.isin(codes, bad["code"].to_numpy())
    less = np.bincount(codes[np.repeat(_sums(wrong, offs) > 0, np.diff(offs))])
    at = np.flatnonzero(less)
    return pa.table({"block": np.full(len(at), docs["block"][0].as_py() if len(docs) else 0), "code": at.astype(np.int32), "less": less[at]})


_COUNTED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _together(digests: bool):
    """The documents of a block, put together from the block's segments."""
    name = "groups_sha256" if digests else "groups"

    def run(docs: pa.Table, segs: pa.Table) -> pa.Table:
        enter("alignment")
        segs = segs.sort_by("code")
        if not np.array_equal(segs["code"].to_numpy(), np.arange(len(segs))):
            raise ValueError("align: a block's segments are not whole")
        bad = np.asarray(segs["groups"].is_null())
        texts = segs["groups"].combine_chunks().fill_null("").cast(pa.large_string())
        tokens, marks, count_sum = (segs[c].combine_chunks().fill_null(0).to_numpy() for c in ("tokens", "marks", "count_sum"))
        low = (1 << 32) - 1
        values = [tokens >> 32, tokens & low, marks >> 32, (tokens >> 32) + (tokens & low) - (marks >> 32), marks & low, count_sum]
        codes, offs = _lists(docs["codes"])
        made, at = [], 0
        while at < len(docs):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + LINKED, "right")) - 1)
            own, place = codes[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            good = (_sums(bad[own], place) == 0) & (np.diff(place) > 0)
            joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(place), texts.take(pa.array(own))), pa.scalar(";", pa.large_string()))
            if digests:
                shown = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() if ok else "" for x, ok in zip(joined, good, strict=True)], pa.string())
            else:
                shown = pc.if_else(pa.array(good), joined, pa.scalar("", pa.large_string())).cast(pa.string())
            made.append(pa.table([docs["doc_id"].slice(at, to - at), *(pa.array(_sums(v[own], place) * good) for v in values), shown], ["doc_id", *_COUNTED, name]))
            at = to
        trim()
        return pa.concat_tables(made).combine_chunks() if made else pa.table([pa.array([], pa.int64()) for _ in range(1 + len(_COUNTED))] + [pa.array([], pa.string())], ["doc_id", *_COUNTED, name])

    return run, f"doc_id long, {', '.join(f'{c} long' for c in _COUNTED)}, {name} string"


def align(docs: DataFrame, files: tuple[str, str] | None = None, digests: bool = False) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every row of ``docs``.

    A text that is null or empty, or whose bytes either side does not give back, has no tokens: zeros and an empty
    ``groups``.  Rows that share an id or repeat are rows of their own; other columns are ignored; an empty table gives
    an empty one.  A very long text is cut like any other, and one without white space is one segment.  ``docs`` is read
    once.  The result is written to the shared folder.  ``digests``: ``groups_sha256`` in place of ``groups``.
    """
    spark = docs.sparkSession
    files = files or paths(spark)
    cut = materialise(spark, _cut(docs, Encoders(*files).cut_before()), "block-segments", "zstd")
    held = cut.where("seg is not null").select("block", "code", "seg", "n")
    lists = spark.read.schema(cut.schema).parquet(cut._written_at).where("codes is not null").select("block", "doc_id", "codes")  # read anew: both sides of a cogroup with columns of one table are ambiguous
    counted = held.groupBy("seg").agg(F.sum("n").alias("n")).select("seg", "n", F.monotonically_increasing_id().alias("id"))
    encoded = materialise(spark, _encode(counted, files), "segments", "zstd")
    good = encoded.where("same")
    weights = good.select("id", "seg", "n")
    if encoded.where("not same").limit(1).count():  # documents without tokens lend no counts
        bad = held.join(encoded.where("not same").select("seg"), "seg").select("block", "code")
        theirs = lists.join(bad.select("block").distinct(), "block", "left_semi").groupBy("block").cogroup(bad.groupBy("block")).applyInArrow(_without_tokens, "block long, code int, less long")
        less = theirs.join(held.select("block", "code", "seg"), ["block", "code"]).groupBy("seg").agg(F.sum("less").alias("less"))
        weights = materialise(spark, weights.join(less, "seg", "left").select("id", "seg", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")), "weights", "zstd")
    free_shuffles(spark)
    with joins_in_place(spark):
        made = materialise(spark, group_texts(stretches(good.select("id", "a", "a_end", "b", "b_end"))).join(weights.repartition("id"), "id"), "aligned", "zstd")
    discard(*([weights] if hasattr(weights, "_written_at") else []), encoded)
    by_pair = made.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("rows"))
    by_pair = materialise(spark, by_pair.withColumn("b", F.expr("pair & 4294967295")), "pairs")
    best = by_pair.groupBy("b").agg(F.max("count").alias("most"))  # a row per id of the vocabulary
    judged = by_pair.join(best, "b").select("pair", "rows", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    links = made.select("id", F.explode("pairs").alias("pair"))
    scores = join_split(links, judged, "pair", "rows", F.col("id")).groupBy("id").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    # two numbers to a column, as the shuffles ahead hold a row per block and segment; sums over a document are made of the numbers themselves
    two = lambda high, low: F.shiftleft(high, 32) + F.col(low)
    known = materialise(spark, made.drop("pairs", "n").join(scores, "id").select("seg", two("n_a", "n_b").alias("tokens"), two("n_groups", "n_best").alias("marks"), "count_sum", "groups"), "known-segments", "zstd")
    discard(made, by_pair)
    parts = []
    for k in range(PASSES):
        mine = F.pmod(F.shiftright("block", 32) + F.col("block"), F.lit(PASSES)) == k
        local = held.where(mine).select("block", "code", "seg").join(known, "seg", "left").drop("seg")
        parts.append(materialise(spark, lists.where(mine).groupBy("block").cogroup(local.groupBy("block")).applyInArrow(*_together(digests)), "alignment"))
        free_shuffles(spark)
    discard(cut, known)
    return reduce(DataFrame.unionByName, parts)


def alignment_digests(docs: DataFrame) -> DataFrame:
    """``align`` with the SHA-256 of ``groups`` in its place (an empty one stays empty)."""
    return align(docs, digests=True)
