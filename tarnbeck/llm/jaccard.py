"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents with the same set of shingles are one row of the matrix (a class).  With the shingles in
one global order, two rows over the threshold share one of the first ``n - ceil(t n) + 1`` of each
(the size-derived bound), so only that part of the incidence is multiplied.  Its entries travel as
packed numpy blocks by shingle; a block turns each shingle's rows into pairs, counts of shared shingles
are added up over the blocks, and pairs whose sizes alone rule the threshold out are discarded.
The order puts frequent shingles last, so a passage that many documents share is multiplied only for
documents that consist of little else.  The counts behind it cover all rows.

Lists of up to ``SMALL`` rows give all their pairs.  Longer ones first give the pairs of each row with
the list's hub; once these are verified and grouped, a list whose rows are all
connected is done, and of another one the pairs between different groups follow, block by block, so
no link between different groups is lost.  Lists over ``CHUNK`` rows are dealt out in parts: those of
the frequent shingles before the shuffle, any others by the task that meets them.
Every candidate pair is verified on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, bloom, discard, enter, inside, join_split, materialise, mix, slices, trim, windows
from .components import components

WORDS, PERCENT = 5, 75
LEAST_BITS = 4
SMALL, CHUNK, FREQUENT, BLOCK = 16, 4096, 64, 250_000
PAIRS = 500_000  # counts of pairs that a task adds up before it passes them on
MOST_FREQUENT = 1 << 21  # shingles that are kept as frequent: with more than entries / MOST_FREQUENT rows each, there are no more than so many
_U = np.uint64


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles (one of all words, if they are few)."""
    t = Texts(column, lower=True).words()
    h = t.word_hashes()
    w, first = windows(h, t.word_offs, words)
    a = np.searchsorted(first, t.word_offs)
    n = np.diff(t.word_offs)
    out = []
    for i in range(t.n):
        if n[i] >= words:
            out.append(np.unique(w[a[i] : a[i + 1]]))
        elif n[i]:
            few = h[t.word_offs[i] : t.word_offs[i + 1]]
            out.append(mix(np.array([(sum(int(x) * (2 * k + 3) ** 9 for k, x in enumerate(few)) + int(n[i])) % 2**64], _U)))
        else:
            out.append(w[:0])
    return out


def set_class(g: np.ndarray) -> int:
    """A hash of a set, the same in any order."""
    return int(mix(np.array([mix(g).sum(dtype=_U) + _U(len(g))], _U)).view(np.int64)[0])


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _key(g: np.ndarray, bits: int) -> np.ndarray:
    """A shingle's block (``bits`` bits) and 32 more bits of its hash: enough to count and to propose by."""
    return g >> _U(32 - bits)


def _frequent(g: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    k = _key(g, bits)
    return hot[np.searchsorted(hot, k).clip(0, len(hot) - 1)] == k if len(hot) else np.zeros(len(g), bool)


def _prefix(g: np.ndarray, hot: np.ndarray, percent: int, bits: int) -> np.ndarray:
    late = _frequent(g, hot, bits)
    ordered = np.concatenate([g[~late], g[late]]) if late.any() else g
    return ordered[: prefix_length(len(g), percent)]


def _rows(docs: DataFrame, f, schema: str) -> DataFrame:
    """``f`` over (ids, sets) of every slice of (doc_id, text); yields batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")

        def parts():
            for batch in batches:
                for part in slices(batch, 1):
                    yield part.column(0), shingle_sets(part.column(1))

        yield from f(parts())

    return docs.mapInArrow(run, schema)


def _fall_together(g: np.ndarray) -> int:
    """How many of a row's (sorted) shingles count with another one by the shortest of the shortened hashes."""
    k = _key(g, LEAST_BITS)
    return int((k[1:] == k[:-1]).sum())


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, cls, slack``: the number of distinct shingles, the class of every row, and its ``_fall_together``."""

    def f(parts):
        for ids, sets in parts:
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(g) for g in sets], pa.int64()), pa.array([set_class(g) for g in sets], pa.int64()), pa.array([_fall_together(g) for g in sets], pa.int32())], ["doc", "n", "cls", "slack"])

    whole = docs.select(F.struct("doc_id", "key").alias("doc"), "text")
    return _rows(whole, f, "doc struct<doc_id:long,key:long>, n long, cls long, slack int").select("doc.*", "n", "cls", "slack")


def _distinct(parts, seen: set[int]):
    """Sets of a task's texts, each class once (and no empty one)."""
    for _, sets in parts:
        for g in sets:
            if len(g) and (c := set_class(g)) not in seen:
                if len(seen) < 1_000_000:
                    seen.add(c)
                yield c, g


def frequent(docs: DataFrame, bits: int, least: int, percent: int, hot: np.ndarray | None = None) -> DataFrame:
    """``gram, df``: shingles (by ``_key``) in more than ``least`` rows.

    Without ``hot``, of the prefixes in hash order; with it, of all shingles of the rows whose prefix has
    one of ``hot``.  Rows of one class that a task sees count once.
    """

    def f(parts):
        held, size = [], 0

        def flush():
            g, n = np.unique(_key(np.concatenate(held), bits), return_counts=True)
            cut = np.searchsorted(g, np.arange(1, 1 << bits, dtype=_U) << _U(32))
            edges = np.concatenate([[0], cut, [len(g)]])
            some = np.flatnonzero(np.diff(edges))
            many = [n[edges[k] : edges[k + 1]] for k in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([g[edges[k] : edges[k + 1]].astype(np.uint32).tobytes() for k in some], pa.binary()), pa.array([b"" if m.max() == 1 else m.astype(np.int32).tobytes() for m in many], pa.binary())],
                ["block", "grams", "counts"],
            )

        for _, g in _distinct(parts, set()):
            p = g[: prefix_length(len(g), percent)]
            if hot is not None:
                p = g if _frequent(p, hot, bits).any() else g[:0]
            held.append(p)
            size += len(p)
            if size > 1_000_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def add(table: pa.Table) -> pa.Table:
        g = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("grams").to_pylist()])
        n = np.concatenate([np.frombuffer(c, np.int32) if c else np.ones(len(x) // 4, np.int32) for x, c in zip(table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        own, at = np.unique(g, return_inverse=True)
        df = np.bincount(at, n).astype(np.int64)
        return pa.table({"gram": own[df > least].astype(np.int64) + (table.column("block")[0].as_py() << 32), "df": df[df > least]})

    return _rows(docs, f, "block int, grams binary, counts binary").groupBy("block").applyInArrow(add, "gram long, df long")


LISTS = "gram long, sub int, k int, weight long, list_hash long, rows binary, sizes binary"


def lists(docs: DataFrame, bits: int, percent: int, hot: np.ndarray, df: np.ndarray, chunk: int) -> DataFrame:
    """Rows (classes) of each shingle of the prefixes, in size order, where there are two at least.

    A shingle in more than ``chunk`` rows is dealt out by class: ``sub`` says which part (-1: whole).
    """
    parts_of = np.minimum(-(-df // chunk), 1 << 16) if len(hot) else df

    def f(parts):
        held, size = [], 0

        def flush():
            k = _key(np.concatenate([p for _, _, p in held]), bits)
            rows = np.repeat(np.array([c for c, _, _ in held], np.int64), [len(p) for _, _, p in held])
            sizes = np.repeat(np.array([min(n, 65535) for _, n, _ in held], np.uint16), [len(p) for _, _, p in held])
            sub = np.zeros(len(k), _U)
            if len(hot):
                at = np.searchsorted(hot, k).clip(0, len(hot) - 1)
                parts_here = np.where(hot[at] == k, parts_of[at], 1)
                sub = np.where(parts_here > 1, mix(rows.view(_U)) % parts_here.astype(_U) + _U(1), _U(0))
            dealt = sub > 0
            block = np.where(dealt, mix(k + sub * _U(0x9E3779B97F4A7C15)) >> _U(64 - bits), k >> _U(32)).astype(np.int64) * 2 + dealt
            order = np.lexsort((sub, k, block))
            k, rows, sizes, block, sub = (x[order] for x in (k, rows, sizes, block, sub))
            own, first = np.unique(block, return_index=True)
            edges = list(zip(first.tolist(), [*first[1:].tolist(), len(k)], own.tolist(), strict=True))
            packed = [
                pa.array([(k[a:b] if o % 2 else k[a:b].astype(np.uint32)).tobytes() for a, b, o in edges], pa.binary()),
                pa.array([(sub[a:b] - _U(1)).astype(np.uint16).tobytes() if o % 2 else b"" for a, b, o in edges], pa.binary()),
                *(pa.array([x[a:b].tobytes() for a, b, _ in edges], pa.binary()) for x in (rows, sizes)),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), *packed], ["block", "grams", "subs", "rows", "sizes"])

        for c, g in _distinct(parts, set()):
            p = _prefix(g, hot, percent, bits)
            held.append((c, len(g), p))
            size += len(p)
            if size > 500_000:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def multiply(table: pa.Table) -> pa.Table:
        dealt = table.column("block")[0].as_py() % 2 == 1
        whole = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        g, rows, sizes = whole("grams", _U if dealt else np.uint32), whole("rows", np.int64), whole("sizes", np.uint16)
        sub = whole("subs", np.uint16) if dealt else np.zeros(len(g), np.uint16)
        order = np.lexsort((rows, sizes, sub, g))
        g, rows, sizes, sub = g[order], rows[order], sizes[order], sub[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (sub[1:] != sub[:-1])])
        fresh = new | np.concatenate([[True], rows[1:] != rows[:-1]])
        g, rows, sizes, sub, new = g[fresh], rows[fresh], sizes[fresh], sub[fresh], new[fresh]
        edges = np.append(np.flatnonzero(new), len(g))
        out: dict = {}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if dealt:
                out[(a,)] = [int(g[a]), int(sub[a]), b - a, 1, 0, rows[a:b].tobytes(), sizes[a:b].tobytes()]
            elif b - a > chunk:  # too long for one block, though not known as frequent
                name, part = (table.column("block")[0].as_py() // 2 << 32) + int(g[a]), (mix(rows[a:b].view(_U)) % _U(-(-(b - a) // chunk))).astype(np.int64)
                for k in np.unique(part).tolist():
                    own = part == k
                    out[(a, k)] = [name, k, int(own.sum()), 1, 0, rows[a:b][own].tobytes(), sizes[a:b][own].tobytes()]
            elif b - a > 1:
                key = rows[a:b].tobytes()
                if key in out:
                    out[key][3] += 1
                else:
                    h = int(mix(np.array([(mix(rows[a:b].view(_U)) * _U(3)).sum(dtype=_U) + _U(b - a)], _U)).view(np.int64)[0])
                    out[key] = [0, -1, b - a, 1, h, key, sizes[a:b].tobytes()]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[k] for r in out.values()], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in LISTS.split(", ")])

    return _rows(docs, f, "block long, grams binary, subs binary, rows binary, sizes binary").groupBy("block").applyInArrow(multiply, LISTS)


def _pairs(found: DataFrame, percent: int) -> DataFrame:
    """``a, b, shared``: the pairs of the shorter lists with the prefix shingles they share there.  (Sizes over 65535 count as 65535 here, which only lets more pairs through.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, w = [], [], []
            for k, weight, rows, sizes in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                rows, sizes = np.frombuffer(rows, np.int64), np.frombuffer(sizes, np.uint16)
                i, j = np.triu_indices(k, 1)
                ok = 100 * sizes[i].astype(np.int64) >= percent * sizes[j].astype(np.int64)
                i, j = i[ok], j[ok]
                a.append(np.minimum(rows[i], rows[j]))
                b.append(np.maximum(rows[i], rows[j]))
                w.append(np.full(len(i), weight))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, w)], ["a", "b", "shared"])

    return found.select("k", "weight", "rows", "sizes").mapInArrow(run, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b: ids) whose full sets are over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    one, two = sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _members(found: DataFrame) -> DataFrame:
    """``list, dealt, sub, cls, size, weight``: the rows of the lists one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column(2), np.int64)
            rows = [np.frombuffer(x, np.int64) for x in batch.column(4).to_pylist()]
            sizes = [np.frombuffer(x, np.uint16).astype(np.int32) for x in batch.column(5).to_pylist()]
            sub = np.asarray(batch.column(1), np.int32)
            name = np.where(sub < 0, np.asarray(batch.column(3), np.int64), np.asarray(batch.column(0), np.int64))
            if len(n):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(name, n), np.repeat(sub >= 0, n), np.repeat(sub, n), np.concatenate(rows), np.concatenate(sizes), np.repeat(np.asarray(batch.column(6), np.int64), n))], ["list", "dealt", "sub", "cls", "size", "weight"])

    return found.select("gram", "sub", "k", "list_hash", "rows", "sizes", "weight").mapInArrow(run, "list long, dealt boolean, sub int, cls long, size int, weight long")


def _hub_pairs(members: DataFrame, percent: int) -> DataFrame:
    """``a, b, shared``: each row of a longer list with the list's hub.

    The hub is the row with the most shingles in longer lists (ties: the least id).  Copies of one text
    that were changed each in its own way are far from each other, but near one that was changed little.
    """
    named = members.withColumn("of", F.struct("list", "dealt"))
    hub = named.groupBy("of").agg(F.max_by(F.struct("rep", "n"), F.struct("in_long", F.bitwise_not("rep"))).alias("hub"), F.count("*").alias("members"))
    both = join_split(named, hub, "of", "members", F.col("rep")).where((F.col("rep") != F.col("hub.rep")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    return both.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct().withColumn("shared", F.lit(0).cast("long"))


def _apart(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """Pairs whose rows are not yet in one component."""
    one, two = group.toDF("a", "ca"), group.toDF("b", "cb")
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _need(na, nb, slack_a, slack_b, percent: int):
    """Shared prefix shingles without which a pair of these sizes cannot reach the threshold.

    The pair shares ``o`` shingles at least.  Those up to where the first of the two prefixes ends are
    in both prefixes; the others are in that row's remainder.  Shared ones that fall together by their
    shortened hashes count once: in either row, no more than its slack.
    """
    rest = lambda n: F.ceil(n * percent / 100) - 1
    return F.ceil((na + nb) * percent / (100 + percent)) - F.greatest(rest(na), rest(nb)) - F.least(slack_a, slack_b)


def _possible(pairs: DataFrame, hubs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (classes in ``pairs``, ids in ``hubs``) that the counts do not rule out, by their ids."""
    of = rows.select("cls", "rep")
    named = pairs.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")
    every = named.unionByName(hubs).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    own = rows.select("rep", "n", "in_long", "slack")
    one, two = own.toDF("a", "na", "la", "ca"), own.toDF("b", "nb", "lb", "cb")
    joined = every.join(one, "a").join(two, "b")
    return joined.where(F.col("shared") + F.least("la", "lb") >= _need(F.col("na"), F.col("nb"), F.col("ca"), F.col("cb"), percent)).select("a", "b", "shared")


def _sets(spark, docs: DataFrame, pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``node, grams`` of the classes in the pairs: one more pass over the texts, behind a Bloom filter, for a document of each."""
    nodes = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    firsts = reps.join(nodes, "rep", "left_semi").select(F.col("rep").alias("node"), "first.*")
    wanted = spark.sparkContext.broadcast(bloom(firsts.select("key"), "key"))  # of a fixed size

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("jaccard")
        for batch in batches:
            batch = batch.filter(pa.array(inside(wanted.value, np.asarray(batch.column(2), np.int64).view(_U))))
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([g.tobytes() for g in shingle_sets(part.column(1))], pa.binary())], ["doc_id", "key", "grams"])

    sets = docs.select("doc_id", "text", "key").mapInArrow(full, "doc_id long, key long, grams binary")
    made = materialise(spark, sets.join(firsts, ["doc_id", "key"]).groupBy("node").agg(F.first("grams").alias("grams")), "sets")
    wanted.destroy()
    trim()
    return made


def _rest_of_lists(members: DataFrame, group: DataFrame, percent: int) -> DataFrame:
    """``a, b``: pairs across components that only longer lists propose, where those share enough.

    The lists of one hub are multiplied together, so that a pair's counts are added up before it is
    passed on.  A row with too few shingles in longer lists for any partner there is left out.
    """
    rows = members.join(group.toDF("rep", "component"), "rep", "left")
    rows = rows.select("list", "dealt", F.struct("list", "dealt").alias("of"), "sub", "weight", "rep", F.col("n").alias("size"), F.struct("in_long", "slack").alias("most"), F.coalesce("component", "rep").alias("component"))
    several = rows.groupBy("of").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("rep", F.struct("most.in_long", F.bitwise_not("rep"))).alias("hub"), F.count("*").alias("members")).where("low <> high").drop("low", "high")
    rows = join_split(rows, several, "of", "members", F.col("rep"))
    names = ("rep", "size", "in_long", "slack", "component")
    part = rows.groupBy("list", "dealt", "sub", "hub", "weight").agg(F.collect_list(F.struct("rep", "size", "most.in_long", F.col("most.slack").cast("long").alias("slack"), "component")).alias("p"))
    cut = lambda t: part.select("list", "dealt", *(["hub", "weight"] if t == 1 else []), F.col("sub").alias(f"sub{t}"), *[F.col(f"p.{c}").alias(f"{c}{t}") for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, PAIRS

        def flush():
            a, b, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((b, a))
            a, b, w = a[order], b[order], w[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            return a[first], b[first], np.add.reduceat(w, first)

        for batch in batches:
            weights, same = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(batch.num_rows):  # one pair of parts at a time, read from the batch's own buffers
                r1, s1, l1, e1, c1, r2, s2, l2, e2, c2 = (batch.column(2 + j)[k].values.to_numpy() for j in range(2 * len(names)))
                for at in range(0, len(r1), 256):  # a block of rows against the other part
                    i = slice(at, at + 256)
                    small, large = np.minimum.outer(s1[i], s2), np.maximum.outer(s1[i], s2)
                    need = -(-(small + large) * percent // (100 + percent)) - (-(-large * percent // 100) - 1) - np.minimum.outer(e1[i], e2)
                    ok = (100 * small >= percent * large) & (np.minimum.outer(l1[i], l2) >= need) & np.not_equal.outer(c1[i], c2)
                    if same[k]:
                        ok &= np.less.outer(np.arange(at, at + len(r1[i])), np.arange(len(r2)))
                    p, q = np.nonzero(ok)
                    if len(p):
                        p = p + at
                        held.append((np.minimum(r1[p], r2[q]), np.maximum(r1[p], r2[q]), np.full(len(p), weights[k])))
                        size += len(p)
                    if size > most:
                        held = [flush()]
                        size = len(held[0][0])
                        if size > PAIRS:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["a", "b", "shared"])
                            held, size = [], 0
                        most = size + PAIRS
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in flush()], ["a", "b", "shared"])

    both = cut(1).join(cut(2), ["list", "dealt"]).where("sub1 <= sub2").withColumn("same", F.expr("sub1 = sub2")).repartition("hub", "sub1", "sub2")
    made = both.select("weight", "same", *[f"{c}{t}" for t in (1, 2) for c in names]).mapInArrow(run, "a long, b long, shared long").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    n = members.select("rep", "n", "slack").distinct()
    sized = made.join(n.toDF("a", "na", "ca"), "a").join(n.toDF("b", "nb", "cb"), "b")
    return sized.where(F.col("shared") >= _need(F.col("na"), F.col("nb"), F.col("ca"), F.col("cb"), percent)).select("a", "b")


def text_key(doc_id, text):
    """Stands for a text among rows of one id."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def _same_id(every: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b``: nodes of classes that rows of one doc_id belong to, each with one of them."""
    own = every.where("doc_id is not null and n > 0").select("doc_id", "cls").distinct()
    least = own.groupBy("doc_id").agg(F.min("cls").alias("a"), F.count("*").alias("classes")).where("classes > 1")
    pairs = join_split(own, least, "doc_id", "classes", F.col("cls")).where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    node = reps.select("cls", "rep")
    return pairs.join(node.toDF("a", "x"), "a").join(node.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, chunk: int = CHUNK, least: int = FREQUENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text).

    Rows that share a doc_id are one document: their texts' links are its links.  Null, empty and blank texts have no
    shingles and link nothing; a row with a null doc_id has a null component and links nothing; repeated rows give
    repeated rows; other columns are ignored; an empty table gives no rows.  A very long text is hashed alone and has one
    set, however large.
    """
    every, of = _grouped(docs, True, percent, chunk, least)
    out = join_split(every, of.select("cls", "times", F.col("label.doc_id").alias("component")), "cls", "times", F.col("doc_id"), "left")
    twice = every.groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 0).alias("blank")).where("blank > 0 and rows > blank and doc_id is not null")
    own = F.col("component")
    if not twice.isEmpty():  # a blank row of a document that has other rows
        named = out.where("n > 0").join(twice.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("also")).join(twice.select("doc_id", "rows"), "doc_id")
        out, own = join_split(out, named, "doc_id", "rows", F.col("cls"), "left"), F.coalesce("component", "also")
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when((F.col("n") > 0), F.col("component")).otherwise(own), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"))


def first_of_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, key``: of each group of near copies the row with the least (doc_id, ``text_key``), and every row without shingles.

    Rows that share an id are rows of their own, each with its own text; rows without an id are in no group and not here.
    """
    every, of = _grouped(docs, False, percent, CHUNK, FREQUENT)
    out = join_split(every, of.select("cls", "times", "label"), "cls", "times", F.col("key"), "left")
    return out.where("doc_id is not null and (n = 0 or (doc_id = label.doc_id and key = label.key))").select("doc_id", "key").distinct()


def _grouped(docs: DataFrame, by_id: bool, percent: int, chunk: int, least: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, n, cls, slack`` of every row, and ``cls, times, label`` of every class: the least (doc_id, key) of its component.

    The nodes are classes, so an id that stands for several texts links none of them; with ``by_id`` such texts are linked.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("doc_id"), F.col("text")).alias("key"))
    every = materialise(spark, classes(docs), "classes")
    linked = docs.where("doc_id is not null and text is not null")
    reps = every.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.first("n").alias("n"), F.first("slack").alias("slack"), F.count("*").alias("times"))
    # a class goes by its least doc_id, or by its hash where several classes have that one
    shared = reps.groupBy(F.col("first.doc_id").alias("id")).agg(F.count("*").alias("classes")).where("classes > 1").select("id")
    reps = reps.join(shared, F.col("first.doc_id") == F.col("id"), "left").withColumn("rep", F.when(F.col("id").isNull(), F.col("first.doc_id")).otherwise(F.col("cls"))).drop("id")
    reps = materialise(spark, reps, "reps")
    entries = int(reps.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0)
    bits = min(24, max(LEAST_BITS, (entries // BLOCK).bit_length()))

    def gather(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        t = found.toArrow()  # at most MOST_FREQUENT rows, by the choice of the least count
        g = t.column("gram").to_numpy().astype(_U)
        order = np.argsort(g)
        return g[order], t.column("df").to_numpy()[order]

    hot, df = gather(frequent(linked, bits, max(least, entries // MOST_FREQUENT), percent))
    if len(hot):
        total = int(reps.agg(F.sum("n")).first()[0])
        more, more_df = gather(frequent(linked, bits, max(least, total // MOST_FREQUENT), percent, hot))
        own, at = np.unique(np.concatenate([hot, more]), return_inverse=True)
        most = np.zeros(len(own), np.int64)
        np.maximum.at(most, at, np.concatenate([df, more_df]))
        hot, df = own, most

    found = lists(linked, bits, percent, hot, df, chunk)
    whole = found.where("sub < 0").groupBy("list_hash").agg(F.sum("weight").alias("weight"), *[F.first(c).alias(c) for c in ("gram", "sub", "k", "rows", "sizes")])
    found = materialise(spark, whole.select(*[x.split()[0] for x in LISTS.split(", ")]).unionByName(found.where("sub >= 0")), "lists")
    trim()

    # candidate pairs: all of the shorter lists, and each row of a longer one with the list's hub
    is_long = F.expr(f"sub >= 0 or k > {SMALL}")
    long_lists = found.where(is_long)
    in_long = _members(long_lists).groupBy("cls").agg(F.sum("weight").alias("in_long"))
    rows = materialise(spark, reps.join(in_long, "cls", "left").select("cls", "rep", "n", "slack", F.coalesce("in_long", F.lit(0)).alias("in_long")), "rows")
    members = materialise(spark, _members(long_lists).select("list", "dealt", "sub", "cls", "weight").join(rows, "cls").drop("cls"), "members")
    by_count = _pairs(found.where(~is_long), percent).select(*"a b shared".split())
    pairs = materialise(spark, _possible(by_count, _hub_pairs(members, percent), rows, percent), "pairs")

    # each row's best candidate first; then what is not yet connected; then what only long lists propose
    both = pairs.union(pairs.select("b", "a", "shared"))
    best = both.groupBy("a").agg(F.max(F.struct("shared", F.bitwise_not("b").alias("other"))).alias("m")).select(F.least("a", F.bitwise_not("m.other")).alias("a"), F.greatest("a", F.bitwise_not("m.other")).alias("b")).distinct()
    sets = _sets(spark, linked, pairs, reps)
    found_links = _verify(best, sets, percent)
    links = materialise(spark, found_links.union(_same_id(every, reps)) if by_id else found_links, "links")
    group = components(links)
    more = materialise(spark, _verify(_apart(pairs.join(best, ["a", "b"], "left_anti"), group), sets, percent), "links")
    if not more.isEmpty():
        links = links.union(more)
        group = components(links)
    late = _rest_of_lists(members, group, percent).join(pairs, ["a", "b"], "left_anti")
    late = materialise(spark, late, "late-pairs")
    if not late.isEmpty():
        more = materialise(spark, _verify(late, _sets(spark, linked, late, reps), percent), "links")
        group = group if more.isEmpty() else components(links.union(more))

    of = reps.join(group.withColumnRenamed("node", "rep"), "rep", "left").select("cls", F.coalesce("component", "rep").alias("component"), "times", "first")
    of = materialise(spark, of, "class-components")
    labels = of.groupBy("component").agg(F.min("first").alias("label"), F.count("*").alias("classes"))
    named = materialise(spark, join_split(of, labels, "component", "classes", F.col("cls")).select("cls", "times", "label"), "class-labels")
    discard(reps, found, rows, members, pairs, late, of)
    return every, named
