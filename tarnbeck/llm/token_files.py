"""Token ids of documents in binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is read from its end.  Its parts, in order:

* the frames: each document's ids (unsigned 32-bit little-endian, its end id last) in one frame of its own, those of
  a document of more than ``FRAME_IDS`` ids in several; no frame needs another one;
* the document table, a skippable frame: for each document its id, first frame, place in the file and first token;
* the seek table of the public seekable format, a skippable frame: for each frame its compressed and plain size and
  the low 32 bits of the XXH64 of its plain bytes.

Any zstandard decoder reads such a file as the ids of all its documents.  A reader of some documents fetches the
tables' rows for them and the bytes of their frames, decompresses no other frame and checks each one's checksum.

Each task writes the files of its range of doc_ids under names of its own attempt; which of them count is told by
the manifest, a table that Spark commits, so a repeated task leaves at most unused files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import enter, materialise, passing, releases, slices, work_path

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"  # where ``VOCABULARY_SETTING`` is unset
VOCABULARY_SETTING = "spark.tarnbeck.word.vocabulary"
END_ID = 1
FRAME_IDS = 1 << 18  # ids of a frame at most: 1 MB
FILE_BYTES = 512 << 20  # a file that has reached this size is closed
FILE_FRAMES = 1 << 21
READ_BYTES = 4 << 20  # frames are fetched in runs of about so many bytes
UNIT_DOCS = 8_192  # documents that are read back as one piece of work
LEVEL = 3  # zstandard
SPREAD = 64  # rows equal in id and text go to as many ranges
CACHE = 300_000  # words per generation of a worker's cache; there are two generations
#: Fixed values of the public format: magic numbers of the two skippable frames and of the footer.
TABLE_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Fixed value: the split pattern of a vocabulary whose tokens hold no white space and never reach over it.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("offset", "<u8"), ("token", "<u8")])
FRAME = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
MANIFEST = "part int, number int, file string, n_docs long, n_frames long, n_tokens long, first_id long, last_id long, has_null boolean"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others by U+0100 and on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_LETTERS = byte_letters()
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+").fullmatch  # letters that lower case keeps as one letter each
SEPARATORS = re.compile("[\x1c-\x1f]").search  # white space to str.split, not to the pattern
WORDS = re.compile(r"[^ \n\t\r]+").findall


class Encoder:
    """Ids of whole texts as bytes.

    With ``WORD_PATTERN`` a text's ids are those of its words between white space, one after another, so each
    distinct word is encoded once and kept in a bounded cache.  Other vocabularies encode each text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_word = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") == WORD_PATTERN
        self.by_word = self.by_word and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._library(texts)
        return [self._text(t) for t in texts]

    def _text(self, text: str) -> bytes:
        words = text.split() if SEPARATORS(text) is None else WORDS(text)
        hits = list(map(self.new.get, words))
        at = -1
        while True:
            try:
                at = hits.index(None, at + 1)
            except ValueError:
                return b"".join(hits)
            hits[at] = self._word(words[at])

    def _word(self, word: str) -> bytes:
        hit = self.new.get(word)  # met earlier in the same text
        if hit is None:
            hit = self.old.get(word) or self._learn(word)
            if len(word) < 100:
                if len(self.new) >= CACHE:
                    self.old, self.new = self.new, {}
                self.new[word] = hit
        return hit

    def _learn(self, word: str) -> bytes:
        """A word of Latin letters goes to the merges directly, in lower case; the normaliser and the pattern would leave it
        whole.  Closing marks after it have ids of their own, so ``word,`` needs no more than ``word``."""
        bare = word.rstrip(".,;:!?")
        if LATIN(bare) is None:
            return self._library([word])[0]
        if len(bare) < len(word):
            return self._word(bare) + self._word(word[len(bare) :])
        low = bare.lower()
        if low != bare:
            return self._word(low)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(low.encode().decode("latin-1").translate(BYTE_LETTERS))]).tobytes()


class FileWriter:
    """Writes one file; ``close`` adds its tables and returns the numbers for the manifest."""

    def __init__(self, out):
        import zstandard

        self.out, self.zip = out, zstandard.ZstdCompressor(level=LEVEL)
        self.at = self.tokens = 0
        self.docs: list[tuple] = []
        self.frames: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        self.docs.append((doc_id or 0, doc_id is None, len(self.frames), self.at, self.tokens))
        for k in range(0, len(ids), 4 * FRAME_IDS):
            plain = ids[k : k + 4 * FRAME_IDS]
            packed = self.zip.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.at += len(packed)
        self.tokens += len(ids) // 4

    def close(self) -> tuple:
        docs, frames = np.array(self.docs, DOC), np.array(self.frames, FRAME)
        table = docs.tobytes() + len(docs).to_bytes(8, "little") + self.tokens.to_bytes(8, "little")
        self.out.write(TABLE_MAGIC.to_bytes(4, "little") + len(table).to_bytes(4, "little") + table)
        seek = frames.tobytes() + len(frames).to_bytes(4, "little") + b"\x80" + FOOTER_MAGIC.to_bytes(4, "little")
        self.out.write(SEEK_MAGIC.to_bytes(4, "little") + len(seek).to_bytes(4, "little") + seek)
        self.out.close()
        real = docs["doc_id"][docs["null"] == 0]
        return len(docs), len(frames), self.tokens, int(real[0]) if len(real) else None, int(real[-1]) if len(real) else None, bool(docs["null"].any())


class FileReader:
    """Reads a file by ranges: first its end, then only what is asked for."""

    def __init__(self, source, size: int):
        self.source = source
        tail = self._range(size - 9, size)
        self.n_frames = int.from_bytes(tail[:4], "little")
        if int.from_bytes(tail[5:], "little") != FOOTER_MAGIC:
            raise ValueError("the file has no seek table")
        self.frames_at = size - 9 - self.n_frames * FRAME.itemsize
        end = self._range(self.frames_at - 24, self.frames_at - 8)
        self.n_docs, self.n_tokens = int.from_bytes(end[:8], "little"), int.from_bytes(end[8:], "little")
        self.docs_at = self.frames_at - 24 - self.n_docs * DOC.itemsize
        self.body_end = self.docs_at - 8

    def _range(self, a: int, b: int) -> bytes:
        self.source.seek(a)
        return self.source.read(b - a)

    def documents(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Rows ``a`` to ``b`` of the document table, and one more that says where the last ends."""
        b = self.n_docs if b is None else b
        rows = np.frombuffer(self._range(self.docs_at + a * DOC.itemsize, self.docs_at + min(b + 1, self.n_docs) * DOC.itemsize), DOC)
        return rows if b < self.n_docs else np.append(rows, np.array([(0, 1, self.n_frames, self.body_end, self.n_tokens)], DOC))

    def frames(self, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """``(row, plain bytes)`` of each frame of the documents ``rows[:-1]``, which follow one another."""
        import xxhash
        import zstandard

        unzip, first, last = zstandard.ZstdDecompressor(), int(rows["frame"][0]), int(rows["frame"][-1])
        seek = np.frombuffer(self._range(self.frames_at + first * FRAME.itemsize, self.frames_at + last * FRAME.itemsize), FRAME)
        ends = np.cumsum(seek["packed"], dtype=np.int64)
        owner = np.searchsorted(rows["frame"][1:].astype(np.int64), np.arange(first, last), "right")
        k, base = 0, int(rows["offset"][0])
        while k < len(seek):
            begin = int(ends[k - 1]) if k else 0
            to = max(k + 1, int(np.searchsorted(ends, begin + READ_BYTES, "right")))
            body, at = self._range(base + begin, base + int(ends[to - 1])), 0
            for j in range(k, to):
                size = int(seek["packed"][j])
                plain = unzip.decompress(body[at : at + size], max_output_size=int(seek["plain"][j]))
                if len(plain) != seek["plain"][j] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != seek["check"][j]:
                    raise ValueError(f"frame {first + j} does not match its checksum")
                yield int(owner[j]), plain
                at += size
            k = to


def vocabulary_path(spark: SparkSession) -> str:
    return spark.conf.get(VOCABULARY_SETTING, VOCABULARY)


def _files(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root else "file:" + root if root.startswith("file:/") else "file://" + root)


_kept: dict[str, Encoder] = {}
releases("token-files", _kept.clear)


def write_token_files(docs: DataFrame, root: str, path: str | None = None) -> DataFrame:
    """Encode every whole text and write the ids to files in ascending order of doc_id; returns the manifest.

    Null ids come first; rows of one id go by their texts' hashes.  A null or empty text has the end id alone.  A very
    long text is encoded alone and has several frames.  Repeated rows are written each; other columns are ignored.
    An empty table gives an empty manifest.  ``path`` is the vocabulary's, which each executor reads at that place.
    """
    spark = docs.sparkSession
    path = path or vocabulary_path(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    rows = rows.withColumn("spread", F.monotonically_increasing_id() % SPREAD).repartitionByRange(*order, F.col("spread")).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token-files")
        encoder = _kept.setdefault(path, None) or Encoder(path)
        _kept[path] = encoder
        fs, folder = _files(root)
        task = TaskContext.get()
        made: list[tuple] = []
        writer = name = None

        def close() -> None:
            made.append((task.partitionId(), len(made), name, *writer.close()))

        for batch in batches:
            for part in slices(batch, 1):
                ids = encoder.encode(part.column(1).to_pylist())
                for doc_id, body in zip(part.column(0).to_pylist(), ids, strict=True):
                    if writer is None:
                        name = f"ids-{task.partitionId():06d}-{len(made):04d}-{uuid.uuid4().hex}.zst"
                        writer = FileWriter(fs.open_output_stream(f"{folder}/{name}", compression=None))
                    writer.add(doc_id, body + END_ID.to_bytes(4, "little"))
                    if writer.at >= FILE_BYTES or len(writer.frames) >= FILE_FRAMES:
                        close()
                        writer = None
        if writer is not None:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(MANIFEST_ARROW.names, m, strict=True)) for m in made], MANIFEST_ARROW)

    return materialise(spark, rows.mapInArrow(run, MANIFEST), "token-manifest")


MANIFEST_ARROW = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_frames", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("has_null", pa.bool_())])


def with_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``start``: the ids in all files before each.  Sums of a thousand parts, then of those sums."""
    group = (F.col("part") / 1000).cast("int").alias("lot")
    lots = manifest.groupBy(group).agg(F.sum("n_tokens").alias("in_lot"))
    before = lots.select("lot", (F.sum("in_lot").over(Window.orderBy("lot")) - F.col("in_lot")).alias("before"))  # a row per thousand parts
    inner = F.sum("n_tokens").over(Window.partitionBy("lot").orderBy("part", "number")) - F.col("n_tokens")
    return manifest.select("*", group).join(before, "lot").withColumn("start", F.col("before") + inner).drop("lot", "before")


def read_token_digests(manifest: DataFrame, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone; frame by frame, whatever a document's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _files(root)
        for batch in batches:
            for unit in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{unit['file']}") as source:
                    file = FileReader(source, source.size())
                    rows = file.documents(unit["from_doc"], unit["to_doc"])
                    crc = np.zeros(len(rows) - 1, np.int64)
                    for k, plain in file.frames(rows):
                        crc[k] = zlib.crc32(plain, int(crc[k]))
                got, token = rows[:-1], rows["token"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(got["doc_id"], mask=got["null"] == 1), pa.array(token[:-1] + unit["start"]), pa.array(np.diff(token)), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(UNIT_DOCS).cast("long")))
    units = with_starts(manifest).where("n_docs > 0").select("file", "start", "n_docs", starts.alias("from_doc")).withColumn("to_doc", F.least("n_docs", F.col("from_doc") + UNIT_DOCS)).drop("n_docs")
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as a unit's row is small and its work is not
    return units.repartition(tasks, "file", "from_doc").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, root: str, ids: Iterable[int | None]) -> DataFrame:
    """``doc_id, start, ids`` of the documents asked for; only their frames are fetched and decompressed.

    ``ids`` is a list on the caller's side; ids that no file holds give no row, an id that several rows share one each.
    """
    ids = list(ids)
    wanted, no_id = np.unique(np.array([i for i in ids if i is not None], np.int64)), None in ids
    spark = manifest.sparkSession
    held = spark.sparkContext.broadcast(wanted)  # the caller's own list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _files(root)
        for batch in batches:
            for one in batch.to_pylist():
                near = held.value[(held.value >= (one["first_id"] or 0)) & (held.value <= (one["last_id"] or 0))] if one["first_id"] is not None else held.value[:0]
                if not len(near) and not (no_id and one["has_null"]):
                    continue
                with fs.open_input_file(f"{folder}/{one['file']}") as source:
                    file = FileReader(source, source.size())
                    table = file.documents()
                    hit = np.isin(table["doc_id"][:-1], near) & (table["null"][:-1] == 0) | (no_id & (table["null"][:-1] == 1))
                    for k in np.flatnonzero(hit):
                        got = np.frombuffer(b"".join(plain for _, plain in file.frames(table[k : k + 2])), "<u4").astype(np.int64)
                        row = table[k]
                        yield pa.RecordBatch.from_arrays([pa.array([None if row["null"] else int(row["doc_id"])], pa.int64()), pa.array([int(row["token"]) + one["start"]]), pa.array([got], pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return with_starts(manifest).repartition("file").mapInArrow(run, "doc_id long, start long, ids array<long>")


def token_files(docs: DataFrame) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read them all back."""
    spark = docs.sparkSession
    root = passing(spark, work_path(spark, "token-files"))
    return read_token_digests(write_token_files(docs, root), root)
