"""Chat formatting by quotation linking.  DataFrame functions only.

A line's quote level is the number of ``>`` before its text.  Lines of one level in a row are a passage;
a passage, each paragraph of it and each line of it is normalised (so it may be wrapped anew) and hashed,
and joined to the latest earlier message of its conversation that has the same unquoted.  A passage
found whole is one quotation; otherwise its paragraphs count, and otherwise its lines.  A message replies
to the one that most lines of its lowest linked level come from (ties: the later): that of the first level
is what it answers, and where only deeper quotes are known, the nearest known message above it.  Without a
quotation it replies to the message before it.  Its own text is what is not quoted.

Conversations are put in reply order: every message is followed by its replies, the earlier first, each with
its own replies.  Turns that follow each other in a row need no search; the stretches between are ranked
by pointer jumping along the tree's tour, in as many rounds as the logarithm of its length.

The joins are as-of joins over blocks of turns: within a block by a window, across blocks by a window
over one row per block.  So no quote meets every message with the same line, and a conversation that
holds a third of all rows is spread over its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_split, materialise

BLOCK = 256  # turns


def _nearest(rows: DataFrame, keys: list[str], turn: str, value: Column, name: str, after: bool = False) -> DataFrame:
    """``rows`` with ``name``: the greatest non-null ``value`` of a row of the same keys with a smaller ``turn``
    (or the least of those with a greater one).  ``value`` rises with ``turn``."""
    best, edge = (F.min, Window.unboundedFollowing) if after else (F.max, Window.unboundedPreceding)
    rows = rows.withColumn("_block", F.floor(F.col(turn) / BLOCK)).withColumn("_value", value)
    inside = Window.partitionBy(*keys, "_block").orderBy(turn).rangeBetween(*((1, edge) if after else (edge, -1)))
    blocks = rows.groupBy(*keys, "_block").agg(best("_value").alias("_own"))
    others = Window.partitionBy(*keys).orderBy("_block").rowsBetween(*((1, edge) if after else (edge, -1)))
    blocks = blocks.select(*keys, "_block", best("_own").over(others).alias("_other"))
    joined = rows.withColumn("_inside", best("_value").over(inside)).join(blocks, [*keys, "_block"])
    return joined.withColumn(name, F.coalesce("_inside", "_other")).drop("_block", "_value", "_inside", "_other")


def _rank(turns: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn) with ``rank``, from 0 in order of turns."""
    turns = turns.withColumn("_block", F.floor(F.col("turn") / BLOCK))
    inside = F.row_number().over(Window.partitionBy("conv_id", "_block").orderBy("turn")) - 1
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = turns.groupBy("conv_id", "_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select("conv_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return turns.withColumn("rank", inside).join(blocks, ["conv_id", "_block"]).withColumn("rank", (F.col("rank") + F.col("_before")).cast("long")).drop("_block", "_before")


_QUOTE = r"^([ \t]*>)+"


def _lines(text: Column) -> Column:
    """Array of (level, normalised line, raw line)."""
    return F.transform(
        F.split(text, "\n", -1),
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _QUOTE, 0), r"[^>]", "")).alias("level"),
            F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, _QUOTE, ""), r"[ \t\r]+", " "), r"^ | $", "")).alias("line"),
            x.alias("raw"),
        ),
    )


def _unit(level, run, para, kind: int, text, n) -> Column:
    return F.struct(F.lit(level).alias("level") if isinstance(level, int) else level.alias("level"), run.cast("int").alias("run"), para.cast("int").alias("para"), F.lit(kind).alias("kind"), F.xxhash64(text).alias("key"), n.cast("int").alias("n"))


def _units(lines: Column, starts: Column) -> Column:
    """Array of (level, run, para, kind, key, n): each passage (kind 0), paragraph (1) and line (2), its hash and its number of lines."""
    start_of = lambda k: F.get(starts, k)

    def of_run(start: Column, k: Column) -> Column:
        level = F.get(lines, start)["level"]
        own = F.slice(lines, start + 1, F.coalesce(start_of(k + 1), F.size(lines)) - start)
        text = F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\n+|\n+$", "")
        paras = F.filter(F.split(text, r"\n\n+", -1), lambda p: p != "")
        count = lambda p: F.size(F.split(p, "\n", -1))
        whole = F.filter(F.array(_unit(level, k, F.lit(-1), 0, F.regexp_replace(text, r"\n+", " "), count(F.regexp_replace(text, r"\n+", "\n")))), lambda _: text != "")
        each_para = F.transform(paras, lambda p, j: _unit(level, k, j, 1, F.regexp_replace(p, "\n", " "), count(p)))
        each_line = F.flatten(F.transform(paras, lambda p, j: F.transform(F.split(p, "\n", -1), lambda x: _unit(level, k, j, 2, x, F.lit(1)))))
        return F.concat(whole, each_para, each_line)

    return F.flatten(F.transform(starts, of_run))


def _links(placed: DataFrame) -> DataFrame:
    """``conv_id, turn, h, n_linked, quote_turn`` of the messages (conv_id, turn, h, text) that quote earlier ones."""
    asking = placed.where(F.col("text").rlike(r"(^|\n)[ \t]*>"))
    said = placed.join(asking.select("conv_id").distinct(), "conv_id", "left_semi").dropDuplicates(["conv_id", "turn", "h"])
    said = said.select("conv_id", "turn", "h", _lines(F.col("text")).alias("lines"))
    change = lambda i: (i == 0) | (F.get(F.col("lines"), i - 1)["level"] != F.get(F.col("lines"), i)["level"])
    said = said.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("lines") - 1), change))
    own = F.filter("lines", lambda x: (x["level"] == 0) & (x["line"] != ""))
    whole = F.filter(F.array(_unit(0, F.lit(-1), F.lit(-1), 0, F.array_join(F.transform(own, lambda x: x["line"]), " "), F.size(own))), lambda _: F.size(own) > 0)
    each = said.select("conv_id", "turn", "h", F.explode(F.concat(_units(F.col("lines"), F.col("starts")), whole)).alias("u")).select("conv_id", "turn", "h", "u.*")
    # what is alike in a message counts once before it is dealt out by its hash
    each = each.groupBy("conv_id", "turn", "h", "level", "run", "para", "kind", "key", "n").agg(F.count("*").alias("times"))
    found = _nearest(each, ["conv_id", "key"], "turn", F.when(F.col("level") == 0, F.col("turn")), "source").where("level > 0 and source is not null")
    has = lambda kind, *by: F.max(F.col("kind") == kind).over(Window.partitionBy("conv_id", "turn", "h", "run", *by))
    found = found.withColumn("as_run", has(0)).withColumn("as_para", has(1, "para")).where("kind = 0 or (not as_run and (kind = 1 or not as_para))")
    votes = found.groupBy("conv_id", "turn", "h", "level", "source").agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    of = votes.groupBy("conv_id", "turn", "h").agg(F.sum("n").alias("n_linked"), F.max(F.struct(-F.col("level"), F.col("n"), F.col("source"))).alias("best"))
    return of.select("conv_id", "turn", "h", "n_linked", F.col("best.source").alias("quote_turn"))


def reply_order(tree: DataFrame) -> DataFrame:
    """``conv_id, turn, position`` (from 1) of distinct turns (conv_id, turn, parent_turn, previous).

    A parent is an earlier turn; only the first turn of a conversation has none.  A stretch is a row of
    turns each of which replies to the one before; in reply order it stays in one piece, and the
    stretches that reply to its later turns come before those that reply to its earlier ones.
    """
    spark = tree.sparkSession
    breaks = F.when(F.col("parent_turn").isNull() | (F.col("parent_turn") != F.col("previous")), F.col("turn"))
    turns = _nearest(tree, ["conv_id"], "turn", breaks, "_first").withColumn("first", F.coalesce(breaks, "_first")).drop("_first")
    turns = materialise(spark, turns.join(_rank(tree.select("conv_id", "turn")), ["conv_id", "turn"]).select("conv_id", "turn", "parent_turn", "first", "rank"), "turns")
    stretch = turns.groupBy("conv_id", "first").agg(F.count("*").alias("size"), F.min("rank").alias("rank"))
    branching = turns.where("turn = first and parent_turn is not null").select("conv_id", F.col("turn").alias("first"), F.col("parent_turn").alias("at"))
    branches = materialise(spark, branching, "branches")
    if branches.isEmpty():
        return turns.select("conv_id", "turn", (F.col("rank") + 1).alias("position"))

    # the stretch that each one replies to, and the next one in order there
    asked = branches.groupBy("conv_id", "at").agg(F.count("*").alias("asked"))
    held = turns.join(asked.withColumnRenamed("at", "turn"), ["conv_id", "turn"]).select(F.struct("conv_id", F.col("turn").alias("at")).alias("place"), F.col("first").alias("up"), "asked")
    under = join_split(branches.withColumn("place", F.struct("conv_id", "at")), held, "place", "asked", F.col("first")).select("conv_id", "first", "at", "up")
    under = _nearest(under, ["conv_id", "at"], "first", F.col("first"), "later", after=True)
    groups = under.groupBy("conv_id", "up", "at").agg(F.min("first").alias("low"))
    lower = _nearest(groups, ["conv_id", "up"], "at", F.col("at"), "below").where("below is not null")
    lower = lower.select("conv_id", "up", "at", "below").join(groups.select("conv_id", "up", F.col("at").alias("below"), F.col("low").alias("turn_to")), ["conv_id", "up", "below"]).drop("below")
    under = under.join(lower, ["conv_id", "up", "at"], "left").select("conv_id", "first", "up", F.coalesce("later", "turn_to").alias("sibling"))
    eldest = groups.groupBy("conv_id", F.col("up").alias("first")).agg(F.max_by("low", "at").alias("child"))

    # a tour enters each stretch, goes round those below it, and leaves it; entering one counts its turns
    several = branches.select("conv_id").distinct()
    nodes = stretch.join(several, "conv_id", "left_semi").join(eldest, ["conv_id", "first"], "left").join(under, ["conv_id", "first"], "left")
    to = lambda first, out: F.struct(F.col(first).alias("first"), F.lit(out).alias("out"))
    enter = nodes.select("conv_id", to("first", False).alias("node"), F.when(F.col("child").isNotNull(), to("child", False)).otherwise(to("first", True)).alias("next"), F.col("size").alias("left"))
    leave = nodes.select("conv_id", to("first", True).alias("node"), F.when(F.col("sibling").isNotNull(), to("sibling", False)).when(F.col("up").isNotNull(), to("up", True)).alias("next"), F.lit(0).cast("long").alias("left"))
    tour = materialise(spark, enter.unionByName(leave), "tour")
    while not tour.where("next is not null").isEmpty():
        ahead = tour.select("conv_id", F.col("node").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        step = tour.join(ahead, ["conv_id", "next"], "left").select("conv_id", "node", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left"))
        before, tour = tour, materialise(spark, step, "tour")
        discard(before)
    total = stretch.groupBy("conv_id").agg(F.sum("size").alias("total"))
    begin = tour.where("not node.out").select("conv_id", F.col("node.first").alias("first"), "left").join(total, "conv_id").select("conv_id", "first", (F.col("total") - F.col("left")).alias("begin"))
    begin = materialise(spark, stretch.join(begin, ["conv_id", "first"], "left").select(F.struct("conv_id", "first").alias("place"), "size", (F.coalesce("begin", F.lit(0)) - F.col("rank")).alias("shift")), "stretches")
    discard(tour, branches)
    placed = join_split(turns.withColumn("place", F.struct("conv_id", "first")), begin, "place", "size", F.col("turn"))
    return placed.select("conv_id", "turn", (F.col("rank") + F.col("shift") + 1).alias("position"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, parent_turn, linked_by, quote_depth, n_quoted,
    n_linked, reply_position, body``.  A conversation without quotes is its bodies by ``reply_position``.

    ``linked_by`` is ``quote``, ``order`` or ``none``.  Null texts have no lines and a null body; rows
    with a null conv_id or turn keep their own text and have no parent or position.  Repeated rows give
    repeated rows; two texts of one (conv_id, turn) are two messages at one position, which follows the later
    of their parents.  Lines are split at \\n; spaces, tabs and a \\r around them, case and runs of
    spaces do not count in the comparison.  A very long text is one message of many lines; nothing of it is
    left out.  Other columns are ignored.  An empty table gives no rows.
    """
    spark = messages.sparkSession
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    parsed = m.withColumn("lines", _lines(F.col("text")))
    own = F.filter("lines", lambda x: x["level"] == 0)
    quoted = F.filter("lines", lambda x: (x["level"] > 0) & (x["line"] != ""))
    parsed = parsed.select(
        "conv_id", "turn", "role", "h",
        F.regexp_replace(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), r"^[\n \t\r]+|[\n \t\r]+$", "").alias("body"),
        F.coalesce(F.array_max(F.transform("lines", lambda x: x["level"])), F.lit(0)).alias("quote_depth"),
        F.greatest(F.size(quoted), F.lit(0)).cast("long").alias("n_quoted"),
    )

    placed = m.where("conv_id is not null and turn is not null").select("conv_id", "turn", "h", "text")
    turns = _nearest(placed.select("conv_id", "turn").distinct(), ["conv_id"], "turn", F.col("turn"), "previous")
    keys = placed.select("conv_id", "turn", "h").distinct().join(_links(placed), ["conv_id", "turn", "h"], "left").join(turns, ["conv_id", "turn"])
    linked = materialise(spark, keys.select("conv_id", "turn", "h", F.coalesce("quote_turn", "previous").alias("parent_turn"), F.col("quote_turn").isNotNull().alias("quoting"), "previous", "n_linked"), "quotes")
    order = reply_order(linked.groupBy("conv_id", "turn").agg(F.max("parent_turn").alias("parent_turn"), F.first("previous").alias("previous")))
    out = parsed.join(linked, ["conv_id", "turn", "h"], "left").join(order, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "parent_turn",
        F.when(F.col("quoting"), "quote").when(F.col("parent_turn").isNotNull(), "order").otherwise("none").alias("linked_by"),
        F.col("quote_depth").cast("int").alias("quote_depth"), "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("position").alias("reply_position"), "body",
    )


def nested_quotes(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) as a mailing list would hold them: each text follows the quoted text
    of the message three turns before at level two, and of that two turns before at level one (wrapped anew
    in even turns)."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    back = lambda n: F.lag("text", n).over(by)
    quote = lambda text, mark: F.concat(F.regexp_replace(text, r"(?m)^", mark), F.lit("\n"))
    near = F.when(F.col("turn") % 2 == 0, F.regexp_replace(back(2), r"\n", " ")).otherwise(back(2))
    text = F.concat(F.coalesce(quote(back(3), ">> "), F.lit("")), F.coalesce(quote(near, "> "), F.lit("")), "text")
    return messages.select("conv_id", "turn", "role", text.alias("text"))


_NESTED = r"""(
select conv_id, turn, role,
  coalesce(regexp_replace(lag(text, 3) over w, '(?m)^', '>> ', 'g') || chr(10), '')
  || coalesce(regexp_replace(case when turn % 2 = 0 then replace(lag(text, 2) over w, chr(10), ' ') else lag(text, 2) over w end, '(?m)^', '> ', 'g') || chr(10), '') || text as text
from conversations window w as (partition by conv_id order by turn))"""

_SQL = r"""
with recursive m as materialized (select conv_id, turn, role, text, hash(text) as h from SOURCE),
l as materialized (
  select distinct conv_id, turn, h, i, length(regexp_replace(regexp_extract(x, '^([ \t]*>)+'), '[^>]', '', 'g')) as level, x as raw,
    lower(regexp_replace(regexp_replace(regexp_replace(x, '^([ \t]*>)+', ''), '[ \t\r]+', ' ', 'g'), '^ | $', '', 'g')) as line
  from (select conv_id, turn, h, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from m)
),
r as (
  select *, sum(case when level = before then 0 else 1 end) over (partition by conv_id, turn, h order by i) as run
  from (select *, lag(level) over (partition by conv_id, turn, h order by i) as before from l)
),
g as materialized (select *, count(*) filter (where line = '') over (partition by conv_id, turn, h, run order by i) as para from r),
u as materialized (
  select conv_id, turn, h, level, run, -1 as para, 0 as kind, -1 as i, string_agg(line, ' ' order by i) as t, count(*) as n from g where line <> '' group by conv_id, turn, h, level, run
  union all select conv_id, turn, h, level, run, para, 1, -1, string_agg(line, ' ' order by i), count(*) from g where line <> '' group by conv_id, turn, h, level, run, para
  union all select conv_id, turn, h, level, run, para, 2, i, line, 1 from g where line <> ''
  union all select conv_id, turn, h, 0, -1, -1, 0, -1, string_agg(line, ' ' order by i), count(*) from g where line <> '' and level = 0 group by conv_id, turn, h
),
s as (
  select q.conv_id, q.turn, q.h, q.level, q.run, q.para, q.kind, q.i, q.n, max(o.turn) as source
  from u q join (select distinct conv_id, turn, t from u where level = 0) o on o.conv_id = q.conv_id and o.t = q.t and o.turn < q.turn
  where q.level > 0 group by all
),
f as (
  select * from (select *, bool_or(kind = 0) over (partition by conv_id, turn, h, run) as as_run, bool_or(kind = 1) over (partition by conv_id, turn, h, run, para) as as_para from s)
  where kind = 0 or (not as_run and (kind = 1 or not as_para))
),
b as (
  select conv_id, turn, h, arg_max(source, row(-level, n, source)) as quote_turn, sum(n) as n_linked
  from (select conv_id, turn, h, level, source, sum(n) as n from f group by all) group by all
),
a as (
  select conv_id, turn, h, max(level) as quote_depth, count(*) filter (where level > 0 and line <> '') as n_quoted,
    coalesce(string_agg(raw, chr(10) order by i) filter (where level = 0), '') as body
  from l group by all
),
p as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as previous from (select distinct conv_id, turn from m where conv_id is not null and turn is not null)),
t as materialized (select p.conv_id, p.turn, max(coalesce(quote_turn, previous)) as parent from p join m using (conv_id, turn) left join b using (conv_id, turn, h) group by all),
w as (
  select conv_id, turn, [turn] as path from t where parent is null
  union all select t.conv_id, t.turn, list_append(w.path, t.turn) from t join w on w.conv_id = t.conv_id and w.turn = t.parent
),
o as (select conv_id, turn, row_number() over (partition by conv_id order by path) as reply_position from w)
select m.conv_id, m.turn, m.role, coalesce(quote_turn, previous) as parent_turn,
  case when quote_turn is not null then 'quote' when previous is not null then 'order' else 'none' end as linked_by,
  cast(coalesce(quote_depth, 0) as int) as quote_depth, cast(coalesce(n_quoted, 0) as bigint) as n_quoted,
  cast(coalesce(n_linked, 0) as bigint) as n_linked, cast(reply_position as bigint) as reply_position,
  regexp_replace(body, '^[\n \t\r]+|[\n \t\r]+$', '', 'g') as body
from m left join a using (conv_id, turn, h) left join b using (conv_id, turn, h) left join p using (conv_id, turn) left join o using (conv_id, turn)
"""
OP5_SQL = _SQL.replace("SOURCE", "conversations")
NESTED_SQL = _SQL.replace("SOURCE", _NESTED)
