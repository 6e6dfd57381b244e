"""SentencePiece encoding and decoding with N-best segmentation.

The lattice has an arc for every vocabulary piece found in the text (and, for a character that has no
piece of its own, one arc of its byte pieces).  A forward Viterbi pass gives the best score from the
start to every position; these are exact heuristics for a backward A* search, which therefore pops
complete segmentations in order of score and expands no position more than N times.

No piece of a vocabulary crosses certain places (before a run of spaces; between letters and other
characters, where the vocabulary has no piece that mixes them), so the lattice falls apart there into
short segments, which are solved once and kept in a bounded cache; the N best of a text follow from
the smallest losses among all segments' alternatives.  The cuts are checked against the vocabulary
when it is loaded.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import enter, releases, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # where ``MODEL_SETTING`` is unset
MODEL_SETTING = "spark.tarnbeck.piece.model"
BYTE_PENALTY = 10.0  # a character spelled in bytes scores this much less than the lowest ordinary piece
CACHE = 220_000  # segments per generation of a worker's cache; there are two generations


@dataclass(frozen=True)
class Vocabulary:
    """Bounded by the model file: pieces (a space stands for the model's mark), scores, and byte ids."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    texts: list[bytes]
    byte_score: float


def model_path(spark: SparkSession) -> str:
    """The vocabulary file; the driver alone reads it."""
    return spark.conf.get(MODEL_SETTING, MODEL)


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, byte_ids, texts = {}, {}, [0] * 256, []
    for i in range(m.get_piece_size()):
        piece = m.id_to_piece(i)
        if m.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            texts.append(b"")
        else:
            piece = piece.replace("▁", " ")
            ids[piece], scores[piece] = i, m.get_score(i)
            texts.append(piece.encode())
    return Vocabulary(ids, scores, byte_ids, texts, min((s for s in scores.values() if s > -1e8), default=0.0) - BYTE_PENALTY)


class Segmenter:
    """Encodes, lists the N best, and decodes.  One per worker; not shared between threads."""

    def __init__(self, vocabulary: Vocabulary, n: int = 3):
        self.v, self.n = vocabulary, n
        self.starts = {p[:k] for p in vocabulary.ids for k in range(1, len(p) + 1)}
        mixed = {c for p in vocabulary.ids for a, b in zip(p, p[1:]) if a != " " and b != " " and _letter(a) != _letter(b) for c in (a, b) if _letter(c)}
        letter = "[^\\W\\d_" + "".join(map(re.escape, sorted(mixed))) + "]"
        other = "(?:(?!" + letter + ")[^ ])"
        crossed = any(a != " " and b == " " for p in vocabulary.ids for a, b in zip(p, p[1:]))
        self.split = re.compile(r".+" if crossed else f" *{letter}+| *{other}+| +", re.S).findall
        self.arcs: dict[str, tuple] = {p: () for p in self.starts}  # () marks the mere beginning of a piece
        self.arcs |= {p: (vocabulary.scores[p], (i,)) for p, i in vocabulary.ids.items()}
        self.others: dict[str, tuple] = {}
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def lattice(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position the arcs into it: (start, score, ids)."""
        ids, scores, starts, n = self.v.ids, self.v.scores, self.starts, len(s)
        into: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            j = i + 1
            while j <= n and (p := s[i:j]) in starts:
                if p in ids:
                    into[j].append((i, scores[p], (ids[p],)))
                j += 1
            if s[i] not in ids:
                into[i + 1].append((i, self.v.byte_score, tuple(self.v.byte_ids[b] for b in s[i].encode("utf-8", "surrogatepass"))))
        return into

    def segment_nbest(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one lattice, best first (ties: in the order the search meets them)."""
        into = self.lattice(s)
        best = [0.0] + [-1e300] * len(s)
        for j in range(1, len(s) + 1):
            for i, score, _ in into[j]:
                if best[i] + score > best[j]:
                    best[j] = best[i] + score
        heap, order, popped, out = [(-best[-1], 0, len(s), 0.0, None)], 0, [0] * (len(s) + 1), []
        while heap and len(out) < n:
            _, _, at, behind, path = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            popped[at] += 1
            if popped[at] > n:
                continue
            for i, score, own in into[at]:
                order += 1
                heapq.heappush(heap, (-(best[i] + score + behind), order, i, behind + score, (own, path)))
        return out

    def best_and_loss(self, s: str) -> tuple[bytes, float, float]:
        """Viterbi only: best ids and score, and how much the second best loses (inf if there is none)."""
        arc, n = self.arcs.get, len(s)
        best, second, back = [0.0] + [-1e300] * n, [-1e300] * (n + 1), [None] * (n + 1)
        for i in range(n):
            high, next_high, one = best[i], second[i], False
            for j in range(i + 1, n + 1):
                e = arc(s[i:j])
                if e is None:
                    break
                if e:
                    x, old = high + e[0], best[j]
                    if x > old:
                        y = next_high + e[0]
                        best[j], back[j], second[j] = x, (i, e[1]), old if old > y else y
                    elif x > second[j]:
                        second[j] = x
                    if j == i + 1:
                        one = True
            if not one:
                x, j, old = high + self.v.byte_score, i + 1, best[i + 1]
                if x > old:
                    y = next_high + self.v.byte_score
                    best[j], back[j], second[j] = x, (i, [self.v.byte_ids[b] for b in s[i].encode("utf-8", "surrogatepass")]), old if old > y else y
                elif x > second[j]:
                    second[j] = x
        ids, at = [], n
        while at:
            at, own = back[at]
            ids.extend(own if type(own) is tuple else own[::-1])
        ids.reverse()
        return array("i", ids).tobytes(), best[n], best[n] - second[n] if second[n] > -1e299 else float("inf")

    def _alternatives(self, s: str) -> tuple:
        """(loss, ids) of a segment's next best segmentations, by A*."""
        hit = self.others.get(s)
        if hit is None:
            (score, _), *rest = self.segment_nbest(s, self.n)
            hit = tuple((score - x, array("i", y).tobytes()) for x, y in rest)
            if len(self.others) < CACHE:
                self.others[s] = hit
        return hit

    def _cached(self, s: str) -> tuple[bytes, float, float]:
        hit = self.new.get(s)  # met earlier in the same text
        if hit is not None:
            return hit
        hit = self.old.get(s)
        if hit is None:
            hit = self.best_and_loss(s)
        if len(s) < 100:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[s] = hit
        return hit

    def solve(self, text: str) -> tuple[bytes, float, list[tuple]]:
        """Best ids of a whole text, its score, and the ``n - 1`` smallest losses of single alternatives."""
        if not text:
            return b"", 0.0, []
        parts = self.split(" " + text)  # the model's own habit: a text begins with a space
        hits = list(map(self.new.get, parts))
        if None in hits:
            hits = [self._cached(w) if h is None else h for w, h in zip(parts, hits, strict=True)]
        bodies, losses = [h[0] for h in hits], [h[2] for h in hits]
        low = []
        # the n - 1 best alternatives lie in the n - 1 segments whose own best alternative loses least
        for k in heapq.nsmallest(self.n - 1, range(len(losses)), key=losses.__getitem__):
            if losses[k] < float("inf"):
                at = sum(map(len, bodies[:k]))
                low += [(x, k, at, at + len(bodies[k]), alt) for x, alt in self._alternatives(parts[k])]
        return b"".join(bodies), sum([h[1] for h in hits]), sorted(low)[: self.n - 1]

    def combine(self, low: list[tuple]) -> list[tuple[float, list[tuple]]]:
        """The ``n`` smallest sums of losses, at most one alternative per segment, each with its changes."""
        found: list[tuple[float, list[tuple]]] = [(0.0, [])]
        for one in low:
            found += [(loss + one[0], [*changes, one]) for loss, changes in found if all(c[1] != one[1] for c in changes)]
            found = sorted(found, key=lambda x: x[0])[: self.n]
        return found

    def nbest(self, text: str) -> list[tuple[float, list[int]]]:
        """Up to ``n`` segmentations of a whole text with their scores, best first."""
        body, score, low = self.solve(text)
        return [(score - loss, array("i", self.changed(body, changes)).tolist()) for loss, changes in self.combine(low)]

    def changed(self, body: bytes, changes: list[tuple]) -> bytes:
        """The best ids with alternatives of some segments in place."""
        if not changes:
            return body
        out, at = [], 0
        for _, _, a, b, alt in sorted(changes, key=lambda c: c[2]):
            out += [body[at:a], alt]
            at = b
        return b"".join([*out, body[at:]])

    def spelt(self, body: bytes) -> bytes:
        texts = self.v.texts
        return b"".join([texts[i] for i in array("i", body)])

    def decode_bytes(self, body: bytes) -> str:
        raw = self.spelt(body)
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(array("i", ids).tobytes())


_kept: dict[tuple, Segmenter] = {}


releases("pieces", _kept.clear)


def _segmenter(held, n: int) -> Segmenter:
    """A worker's segmenter for a broadcast vocabulary; its cache outlives a task."""
    key = (held.value.byte_score, len(held.value.texts), hash(frozenset(held.value.ids.items())), n)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Segmenter(held.value, n)
    return _kept[key]


def _letter(c: str) -> bool:
    return re.match(r"[^\W\d_]", c) is not None


def encode(docs: DataFrame, path: str | None = None, n: int = 3, text_col: str = "text", with_ids: bool = True, with_nbest: bool = False) -> DataFrame:
    """``docs`` without its text, with the ``n`` best segmentations of each whole text.

    ``n_pieces``, ``score`` (of the best), ``losses`` (of the next best, as far as there are so many),
    ``nbest_sha1`` (of each segmentation's ids as little-endian int32, best first), ``round_trip`` (each of
    them decodes to the text) and, with ``with_ids``, ``ids`` (of the best), with ``with_nbest``,
    ``nbest_ids`` (of all).  Equal scores come in the order the search meets them.  A null text gives
    nulls; an empty one zero pieces.  A literal U+2581 is spelled in bytes, so it survives decoding.  A
    very long text is worked on alone.  Rows stay as they are, repeated ones too; columns with the names
    above are replaced.  ``path`` is the vocabulary's, by default that of ``model_path``.
    """
    own = [StructField("n_pieces", LongType()), StructField("score", DoubleType()), StructField("losses", ArrayType(DoubleType())), StructField("nbest_sha1", ArrayType(StringType())), StructField("round_trip", BooleanType())]
    kinds = [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.bool_()]
    if with_ids:
        own.append(StructField("ids", ArrayType(IntegerType())))
        kinds.append(pa.list_(pa.int32()))
    if with_nbest:
        own.append(StructField("nbest_ids", ArrayType(ArrayType(IntegerType()))))
        kinds.append(pa.list_(pa.list_(pa.int32())))
    docs = docs.drop(*[f.name for f in own if f.name != text_col])
    held, column = docs.sparkSession.sparkContext.broadcast(load(path or model_path(docs.sparkSession))), docs.columns.index(text_col)  # bounded by the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pieces")
        seg = _segmenter(held, n)
        for batch in batches:
            for part in slices(batch, column):
                made: list[list] = [[] for _ in own]
                for text in part.column(column).to_pylist():
                    if text is None:
                        row = [None] * len(own)
                    else:
                        body, score, low = seg.solve(text)
                        best = seg.combine(low)
                        every = [seg.changed(body, changes) for _, changes in best]
                        same = seg.decode_bytes(body) == text and all(seg.spelt(c[4]) == seg.spelt(body[c[2] : c[3]]) for c in low)
                        row = [len(body) // 4, score, [loss for loss, _ in best[1:]], [hashlib.sha1(x).hexdigest() for x in every], same]
                        row += [array("i", body)] * with_ids + [[array("i", x) for x in every]] * with_nbest
                    for column_, value in zip(made, row, strict=True):
                        column_.append(value)
                rest = [i for i in range(part.num_columns) if i != column]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], [*(part.schema.names[i] for i in rest), *(f.name for f in own)])

    return docs.mapInArrow(run, StructType([*(f for f in docs.schema.fields if f.name != text_col), *own]))


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of each list of ids (null for null)."""
    rows = rows.drop("decoded")
    held, column = rows.sparkSession.sparkContext.broadcast(load(path or model_path(rows.sparkSession))), rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = _segmenter(held, 3)
        for part in batches:
            out = [None if ids is None else seg.decode(ids) for ids in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("decoded", StringType())]))
