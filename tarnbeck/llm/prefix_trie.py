"""A trie of conversation prefixes by prefix-doubling naming.

Every turn gets a dense name (equal turns, equal names).  A block is 2**k turns that begin at a multiple of 2**k; a
block of the next size is a pair of names, which is named again, so all blocks are named in a logarithmic number of
joins and their number halves each time.  A prefix of d turns is a chain of blocks by the binary digits of d: that
of d without its lowest digit, which is named one round earlier, and one more block.  Prefixes with equal
depth and name are one node.

A node is known by its smallest member and its depth, so its ancestor ``s`` levels up is found by one join: the node
of the same member at depth - s.  Sums over subtrees double their reach each round: what the descendants ``s`` levels
below have summed up is added to their ancestor's sum.

Order within a conversation comes from a range partitioning and running offsets, so no conversation, however long, is
one task's; joins on a turn, a pair or a node that very many rows share are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_split, materialise

SPREAD = 64  # rows equal in conversation, turn and content go to as many ranges
ROW_BITS = 33  # of monotonically_increasing_id
ID_CHUNK = 1 << 14  # conv_ids that are joined to one text before hashing
NO_IDS = hashlib.sha256(b"").hexdigest()


def _part_and_row(number: str) -> tuple:
    return F.shiftright(number, ROW_BITS), F.col(number).bitwiseAND((1 << ROW_BITS) - 1)


def dense(keys: DataFrame, name: str) -> DataFrame:
    """``keys`` with ``name``: 0, 1, 2, ... in any order.  Only a count per partition goes through the driver."""
    spark = keys.sparkSession
    held = materialise(spark, keys.withColumn("_n", F.monotonically_increasing_id()), "names")
    part, row = _part_and_row("_n")
    offsets, at = [], 0
    for r in held.groupBy(part.alias("p")).count().orderBy("p").collect():
        offsets.append((r["p"], at))
        at += r["count"]
    starts = spark.createDataFrame(offsets, "_p long, _at long")
    made = held.withColumn("_p", part).join(F.broadcast(starts), "_p").withColumn(name, F.col("_at") + row).drop("_p", "_at", "_n")  # a row per partition
    made._written_at = held._written_at
    return made


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, sha, chars`` (written): the turns of each conversation, numbered from 1 by turn (null first).

    Turns of one number go by their SHA-256, which stands for role and text (null: empty) from here on.  Rows without
    a conv_id belong to no conversation and go.  Rows that repeat are turns of their own.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("sha"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("sha").asc()]
    rows = rows.where("conv_id is not null").withColumn("spread", F.monotonically_increasing_id() % SPREAD).repartitionByRange(*order, F.col("spread")).sortWithinPartitions(*order)
    held = materialise(spark, rows.select("conv_id", "sha", "chars", F.monotonically_increasing_id().alias("n")), "turns-in-order")
    part, row = _part_and_row("n")
    numbered = held.select("conv_id", part.alias("part"), row.alias("row"), "sha", "chars")
    spans = numbered.groupBy("conv_id", "part").agg(F.min("row").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("rows")  # a row per range that the conversation lies in
    out = numbered.join(spans.select("conv_id", "part", (before - F.col("first") + 1).alias("shift")), ["conv_id", "part"]).select("conv_id", (F.col("row") + F.col("shift")).alias("pos"), "sha", "chars")
    made = materialise(spark, out, "turns-numbered")
    discard(held)
    return made


def rebuild(turns: DataFrame, base_of: str = "conv_id - conv_id % 100", head_of: str = "crc32(cast(conv_id as string)) % 6") -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the head of another one; both tables are written.

    The first ``head_of`` turns of conversation ``base_of`` (all if it has fewer, none if there is no such) and then the
    conversation's own turns after its first ``head_of``.  Returns ``conv_id, d, sha, chars`` of the turns and
    ``conv_id, n_turns`` of all conversations, those without a turn too.
    """
    spark = turns.sparkSession
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", F.expr(head_of).cast("long").alias("h"), F.expr(base_of).cast("long").alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.join(bases, "base", "left").select("conv_id", "n", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("m"))
    convs = materialise(spark, convs.withColumn("n_turns", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    later = join_split(turns, convs.select("conv_id", "n", "h", "m"), "conv_id", "n", F.col("pos")).where("pos > h").select("conv_id", (F.col("m") + F.col("pos") - F.col("h")).alias("d"), "sha", "chars")
    most = convs.agg(F.max("m")).first()[0] or 0
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "base").join(convs.where("m > 0").select("conv_id", "base", "m"), "base").where("pos <= m").select("conv_id", F.col("pos").alias("d"), "sha", "chars")
    return materialise(spark, later.union(heads), "turns-rebuilt"), convs.select("conv_id", "n_turns")


def _named(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """``rows`` (written) with ``keys`` replaced by their dense ``name``."""
    spark = rows.sparkSession
    rest = [c for c in rows.columns if c not in keys]
    key = F.struct(*keys).alias("key")
    names = dense(rows.groupBy(key).agg(F.count("*").alias("n")), "name")
    made = materialise(spark, join_split(rows.select(*rest, key), names, "key", "n", F.struct(*rest)).select(*rest, "name"), what)
    discard(names)
    return made


def prefix_names(turns: DataFrame, longest: int) -> DataFrame:
    """``conv_id, d, name, chars`` (written): equal (d, name) stand for equal first d turns; ``chars`` is that of the last."""
    spark = turns.sparkSession
    first = _named(turns, ["sha"], "blocks")
    last_chars = first.select("conv_id", "d", "chars")
    blocks = [first.select("conv_id", (F.col("d") - 1).alias("j"), "name")]
    written = [first]
    while 2 ** len(blocks) <= longest:
        side = F.col("j") % 2
        pairs = blocks[-1].groupBy("conv_id", F.shiftright("j", 1).alias("i")).agg(F.max(F.when(side == 0, F.col("name"))).alias("left"), F.max(F.when(side == 1, F.col("name"))).alias("right"))
        written.append(_named(pairs.where("right is not null").withColumnRenamed("i", "j"), ["left", "right"], "blocks"))
        blocks.append(written[-1].select("conv_id", "j", "name"))
    # the last block of the chain of d: the one with an even number that ends at d
    lasts = [b.where("j % 2 = 0").select("conv_id", ((F.col("j") + 1) * 2**k).alias("d"), "name") for k, b in enumerate(blocks)]
    chain = lasts[0]
    for more in lasts[1:]:
        chain = chain.union(more)
    chain = materialise(spark, chain.withColumn("digits", F.bit_count("d")), "chains")
    done = [chain.where("digits = 1").select("conv_id", "d", "name")]
    for digits in range(2, longest.bit_length() + 1):
        left = done[-1].select("conv_id", F.col("d").alias("before"), F.col("name").alias("left"))
        rows = chain.where(F.col("digits") == digits).select("conv_id", "d", F.col("name").alias("right"), F.expr("d & (d - 1)").alias("before"))
        rows = rows.join(left, ["conv_id", "before"]).select("conv_id", "d", F.col("d").alias("at"), "left", "right")
        done.append(_named(rows, ["at", "left", "right"], "prefixes"))
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more.select("conv_id", "d", "name"))
    made = materialise(spark, whole.join(last_chars, ["conv_id", "d"]), "prefix-names")
    discard(*written, chain, *done[1:])
    return made


def _end_hashes(ends: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` from (conv_id, depth, member).

    At most ``ID_CHUNK`` ids are joined to one text; the texts of a node are fed to the hash one after another, so none
    is held whole.  A hash has one order, so a node's ids are hashed by one task: eight bytes or so an id.
    """
    chunk = F.floor(F.col("member") / ID_CHUNK).alias("chunk")
    texts = ends.groupBy("conv_id", "depth", chunk).agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out: list[tuple] = []
            for conv_id, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (conv_id, depth) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (conv_id, depth), hashlib.sha256()
                digest.update(ids.encode())
            yield _digest_batch(out)
        if now is not None:
            yield _digest_batch([(*now, digest.hexdigest())])

    return texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["conv_id", "depth", "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie over ``turns`` (conv_id, d from 1 without gaps, sha, chars) and ``convs`` (conv_id, n_turns).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (characters that a shared prefix need not be kept again for, over the subtree) and ``ends_sha256``.
    The root has every conversation; without conversations there are no nodes.
    """
    spark = turns.sparkSession
    longest = convs.agg(F.max("n_turns")).first()[0] or 0
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("chars"))
    members = roots if longest == 0 else roots.unionByName(prefix_names(turns, longest))
    key = F.struct("d", "name").alias("key")
    groups = members.groupBy(key).agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    groups = materialise(spark, groups, "nodes")
    place = join_split(members.select("conv_id", key), groups.select("key", "node", "n_convs"), "key", "n_convs", F.col("conv_id")).select("conv_id", F.col("key.d").alias("d"), "node")
    place = materialise(spark, place, "memberships")

    nodes = groups.select(F.col("node").alias("conv_id"), F.col("key.d").alias("depth"), "n_convs", "chars")
    up = place.select("conv_id", (F.col("d") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = nodes.join(up, ["conv_id", "depth"], "left")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    now = materialise(spark, nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"), "subtrees")
    reach = 1
    while reach <= longest:
        far = place.select("conv_id", (F.col("d") + reach).alias("depth"), "node")
        given = now.where(F.col("depth") >= reach).select("conv_id", "depth", "n_leaves", "saved_tokens").join(far, ["conv_id", "depth"])
        given = given.groupBy(F.col("node").alias("conv_id"), (F.col("depth") - reach).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        summed = now.join(given, ["conv_id", "depth"], "left").withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)))
        was, now = now, materialise(spark, summed.drop("more_leaves", "more_saved"), "subtrees")
        discard(was)
        reach *= 2
    at_end = place.withColumnRenamed("conv_id", "member").join(convs.select(F.col("conv_id").alias("member"), F.col("n_turns").alias("d")), ["member", "d"])
    hashes = _end_hashes(at_end.select(F.col("node").alias("conv_id"), F.col("d").alias("depth"), "member"))
    out = now.join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (``rebuild`` with its defaults)."""
    ordered = ordered_turns(conversations)
    made = trie(*rebuild(ordered))
    discard(ordered)
    return made


#: CRC-32 of a conv_id's digits in DuckDB, by list functions.
_CRC = """xor(4294967295::bigint, list_reduce(list_transform(range(length(conv_id::varchar)), lambda i: ascii(substr(conv_id::varchar, cast(i + 1 as int), 1))::bigint),
    lambda c, b: list_reduce(range(8), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end, xor(c, b)), 4294967295::bigint))"""
OP11_SQL = f"""
with own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null),
convs as (select conv_id, count(*) as n, {_CRC} % 6 as h from own group by conv_id),
heads as (select c.conv_id, c.h, c.n, c.conv_id - c.conv_id % 100 as base, least(c.h, coalesce(b.n, 0)) as m from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 100),
turns as (select conv_id, m + pos - h as d, role, text from own join heads using (conv_id) where pos > h
  union all select heads.conv_id, pos as d, role, text from heads join own on own.conv_id = base and pos <= m),
prefixes as (select conv_id, d, length(text) as chars, sha256(string_agg(sha256(length(role) || ':' || role || text), '') over (partition by conv_id order by d)) as k from turns
  union all select conv_id, 0, 0, '' from convs),
groups as (select d, k, min(conv_id) as node, count(*) as n_convs, max(chars) as chars from prefixes group by d, k),
place as (select conv_id, d, node from prefixes join groups using (d, k)),
tree as (select g.node, g.d, g.n_convs, g.chars, p.node as parent from groups g left join place p on p.conv_id = g.node and p.d = g.d - 1),
children as (select parent as node, d - 1 as d, count(*) as n_children from tree where d > 0 group by all),
full_tree as (select t.*, coalesce(n_children, 0) as n_children from tree t left join children using (node, d)),
sums as (select p.node, p.d, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * chars) as saved from full_tree t join place p on p.conv_id = t.node and p.d <= t.d group by all),
ends as (select node, p.d, sha256(string_agg(p.conv_id::varchar, ',' order by p.conv_id)) as h from place p join (select conv_id, m + greatest(n - h, 0) as d from heads) e on e.conv_id = p.conv_id and e.d = p.d group by all)
select node as conv_id, d::bigint as depth, parent as parent_conv_id, n_convs, n_children::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens, coalesce(h, sha256('')) as ends_sha256
from full_tree join sums using (node, d) left join ends using (node, d)
"""
