"""Shared pieces: the shared work folder, joins with hot keys, Arrow batch slicing, and vectorised word hashing.

Word hashing never builds Python string objects.  A text is a slice of one UTF-8 byte array; a
word's hash is a polynomial over its bytes, read off one prefix sum (the multiplier is odd, so its
powers have inverses modulo 2**64) and finished with a 64-bit mixer.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space bytes, as in ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
SLICE = (1 << 20) - 64  # bytes of text worked on at once; a task's arrays are some tens of times that
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: memory is given back as it sees fit
    _libc = None


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``.  Where that is unset, a temporary folder serves on a
    local master only; on a cluster it would not be shared, so an unset folder is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir() + "/tarnbeck"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def passing(spark: SparkSession, path: str) -> str:
    """``path``, made as a folder if need be; it is deleted when the driver ends."""
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def materialise(spark: SparkSession, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    The folder goes when the driver ends, or earlier by ``discard``.
    """
    path = work_path(spark, name)
    df.write.parquet(path, compression=compression)
    made = spark.read.schema(df.schema).parquet(passing(spark, path))
    made._written_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned and that no plan will read again.

    The shuffles and broadcasts behind them are freed once the driver's garbage is collected, so that is done here.
    """
    for t in tables:
        fs, at = _hadoop(t.sparkSession, t._written_at)
        fs.delete(at, True)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Collect the driver's garbage, upon which Spark deletes the shuffles and broadcasts of plans that are done with.

    The last plan stays known to Spark's own threads until they run another one, so a small one runs first.
    """
    gc.collect()
    spark.range(0, 64, 1, 8).groupBy(F.col("id") % 8).count().collect()
    spark._jvm.System.gc()


HOT_ROWS = 1_000  # a key with fewer rows is never split
MOST_HOT = 1 << 16  # keys that are split: those with more than this share of all rows, so there are no more than so many


def join_split(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column, how: str = "inner", total: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` on ``key`` (one row per key in ``right``), hot keys dealt out to many tasks.

    ``weight`` is the column of ``right`` with the number of rows that ``left`` has of the key.  A key of
    more than ``total / MOST_HOT`` rows is cut into parts of about that size: its rows in ``left`` by
    ``spread``, which must depend on their values alone (so a repeated task deals them out alike), and
    its one row in ``right`` is repeated for each part.  Only the hot keys and their numbers of parts are
    broadcast, fewer than ``MOST_HOT`` rows.  ``total``: the sum of ``weight``, or more, where it is known.
    """
    total = (right.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    most = max(HOT_ROWS, total // MOST_HOT)
    right = right.withColumn("_parts", F.when(F.col(weight) > most, F.ceil(F.col(weight) / most)).otherwise(1).cast("int"))
    hot = right.where("_parts > 1").select(key, F.col("_parts").alias("_hot"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_part", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.col("_hot"))).cast("int")).drop("_hot")
    many = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", weight)
    return dealt.join(many, [key, "_part"], how).drop("_part")


def bloom_bits(count: int, low: int = 1 << 26, high: int = 1 << 30) -> int:
    """Bits of a filter for ``count`` keys: eight a key at least, within 8 and 128 MB.  A filter beyond that
    fills up, and lets more through than need be, never less."""
    return min(high, max(low, 1 << (8 * max(count, 1) - 1).bit_length()))


def bloom(rows: DataFrame, column: str, bits: int = 1 << 26) -> np.ndarray:
    """A one-hash Bloom filter of ``bits`` bits over a long column, built on the executors."""
    slot = F.pmod(F.col(column), F.lit(bits)) + 1  # the bitmap functions count from 1
    made = rows.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in made.toLocalIterator():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def inside(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h & _U(8 * len(filled) - 1)).astype(np.int64)
    return (filled[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(size, _U(base))
            x[0] = _U(1)
            _powers[k] = np.cumprod(x)
    return _powers[0], _powers[1]


class Texts:
    """A column of texts as one byte array: ``data`` and ``offs`` (one more than there are texts).

    A null text is an empty one here; callers keep the null mask where it matters.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.fill_null("").cast(pa.large_string())
        n = len(column)
        raw = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        body = column.buffers()[2] if n else None
        data = np.frombuffer(body, np.uint8)[raw[0] : raw[-1]] if body is not None and raw[-1] > raw[0] else np.zeros(0, np.uint8)
        self.data = LOWER[data] if lower else data
        self.offs = raw - raw[0]
        self.n = n

    def words(self) -> "Texts":
        """Find the words; sets ``start``, ``end`` (byte positions) and ``word_offs`` (per text)."""
        space = _IS_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offs] = True
        before = np.ones(len(self.data), bool)
        before[1:] = space[:-1]
        after = np.ones(len(self.data), bool)
        after[:-1] = space[1:]
        self.start = np.flatnonzero(~space & (before | edge[:-1]))
        self.end = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.word_offs = np.searchsorted(self.start, self.offs)
        return self

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges; equal ranges of bytes have equal hashes."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(n + 1, _U)
            np.cumsum(_BYTE_VALUE[self.data] * up[:n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(_U))

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)


def windows(hashes: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside each text, and the first word's position of each."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    acc = np.zeros(n - k + 1, _U)
    for j in range(k):
        acc += hashes[j : n - k + 1 + j] * _U(pow(0xD6E8FEB86659FD93, j + 1, 2**64))
    ok = np.ones(n - k + 1, bool)
    for j in range(1, k):  # a window may not start so late that it crosses a text's end
        late = offs[1:] - j
        late = late[(late >= 0) & (late < len(ok))]
        ok[late] = False
    ends = np.repeat(offs[1:], np.diff(offs))[: len(ok)]
    first = np.flatnonzero(ok & (np.arange(len(ok)) + k <= ends))
    return mix(acc[first]), first


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``most`` bytes of text (a longer row comes alone)."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        floor = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, floor + most, "right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


def trim() -> None:
    """Give freed memory back: a worker lives on after its task, beside the executor's other workers."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


_release: dict[str, Callable[[], None]] = {}
_now = [""]


def releases(owner: str, f: Callable[[], None]) -> None:
    """``f`` drops what an operator keeps in a worker between its tasks."""
    _release[owner] = f


def enter(owner: str) -> None:
    """An operator begins a task in this worker: what the others keep there is dropped."""
    if _now[0] != owner:
        _now[0] = owner
        for other, f in _release.items():
            if other != owner:
                f()
        gc.collect()
        trim()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
