"""Ordered analytics: windows, runs, gaps, ranks, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import decisions as dec
from ..operators import segments as seg
from .base import CONF, SECONDS, Registry, Tables, confidence, seconds

R = Registry()
#: The events of a journey are hours apart, so the windows are taken wide here; 15 s is the default of the operators.
WINDOW = 12 * 3600.0
HITS = f"select event_id, user_id, event_type, {SECONDS} as t, {CONF} as confidence from events where {CONF} >= 0.6"


def _hits(d: Tables) -> DataFrame:
    return d.events.select("event_id", "user_id", "event_type", seconds().alias("t"), confidence().alias("confidence")).where("confidence >= 0.6")


@R.add(f"""select a.event_id, a.user_id, a.event_type, count(b.event_id) as n_same, count(b.event_id) >= 2 as repeated from ({HITS}) a
  join ({HITS}) b on a.user_id = b.user_id and a.event_type = b.event_type and b.t between a.t - {WINDOW} and a.t and (b.t < a.t or b.event_id <= a.event_id) group by 1, 2, 3""")
def repeat_in_window(d: Tables) -> DataFrame:
    out = dec.repeats(_hits(d), ["user_id"], "event_type", "t", ["event_id"], WINDOW)
    return out.select("event_id", "user_id", "event_type", "n_same", (F.col("n_same") >= 2).alias("repeated"))


@R.add(f"""select a.event_id, a.user_id, count(distinct b.event_type) as n_distinct from ({HITS}) a
  join ({HITS}) b on a.user_id = b.user_id and b.t between a.t - {WINDOW} and a.t and (b.t < a.t or b.event_id <= a.event_id) group by 1, 2""")
def distinct_in_window(d: Tables) -> DataFrame:
    return dec.repeats(_hits(d), ["user_id"], "event_type", "t", ["event_id"], WINDOW).select("event_id", "user_id", "n_distinct")


@R.add(f"""with h as ({HITS}),
 w as (select a.event_id, a.user_id, a.event_type, a.confidence, count(case when a.event_type = b.event_type then 1 end) as n_same, count(distinct b.event_type) as n_distinct
  from h a join h b on a.user_id = b.user_id and b.t between a.t - {WINDOW} and a.t and (b.t < a.t or b.event_id <= a.event_id) group by 1, 2, 3, 4),
 s as (select *, event_type = 'view' as vbd, event_id % 97 = 0 as corroborated, event_id % 89 = 0 as scream from w)
select event_id, user_id, case when vbd and not (corroborated or n_distinct >= 2 or n_same >= 2 or scream) then 'TRIGGER_VERIFY'
  when corroborated or n_distinct >= 2 or n_same >= 2 or scream or confidence >= 0.85 then 'TRIGGER_ALL' else 'TRIGGER_VERIFY' end as decision,
  case when corroborated then 'agreement' when n_distinct >= 2 then 'distinct' when n_same >= 2 then 'repeated' when scream then 'sound'
  when vbd then 'verify_by_default' when confidence >= 0.85 then 'confident' else 'between' end as reason, n_same >= 2 as repeated from s""")
def escalation_decide(d: Tables) -> DataFrame:
    h = dec.repeats(_hits(d), ["user_id"], "event_type", "t", ["event_id"], WINDOW)
    h = h.withColumns({"verify_by_default": F.col("event_type") == "view", "corroborated": F.col("event_id") % 97 == 0, "scream": F.col("event_id") % 89 == 0})
    return dec.escalate(h).select("event_id", "user_id", "decision", "reason", "repeated")


DRAINED = f"""with e as (select event_id, user_id, {SECONDS} as t, event_type in ('purchase', 'error') as alert, event_type = 'view' as beat, event_id % 3 = 0 as up from events),
 x as (select a.user_id, a.event_id, b.event_id as beat, b.up, row_number() over (partition by a.event_id order by b.t, b.event_id) as n
  from e a left join e b on a.user_id = b.user_id and b.beat and (b.t > a.t or (b.t = a.t and b.event_id > a.event_id)) where a.alert),
 g as (select user_id, event_id, min(case when up then n end) as n, count(beat) as every, arg_min(beat, case when up then n end) as beat from x group by 1, 2)
select user_id, event_id, case when event_id % 2 = 0 then event_id else beat end as delivered_by, cast(case when event_id % 2 = 0 then 1 else 1 + coalesce(n, every) end as bigint) as attempts from g"""


def _alerts(d: Tables) -> DataFrame:
    """Every second alert (purchase, error) is sent at once; a heartbeat (view) finds the receiver up every third time."""
    e = d.events.select("user_id", "event_id", seconds().alias("t"), F.col("event_type").isin("purchase", "error").alias("alert"), (F.col("event_type") == "view").alias("beat"))
    return e.withColumns({"sent": F.col("event_id") % 2 == 0, "up": F.col("event_id") % 3 == 0})


@R.add(DRAINED)
def outbox_drain(d: Tables) -> DataFrame:
    """Alerts tried again at heartbeats: which heartbeat delivers each, and after how many attempts."""
    return dec.drain(_alerts(d), "user_id", ["t", "event_id"], "event_id", *(F.col(c) for c in ("alert", "sent", "beat", "up")))


EPISODES = f"""select user_id, event_id, sum(n) over (partition by user_id order by t, event_id) as episode from (
  select *, cast(case when t - lag(t) over (partition by user_id order by t, event_id) < 21600.0 then 0 else 1 end as bigint) as n from (select user_id, event_id, {SECONDS} as t from events))"""


@R.add(f"select user_id, event_id, cast(episode as bigint) as episode from ({EPISODES})")
def alert_episodes(d: Tables) -> DataFrame:
    e = d.events.select("user_id", "event_id", seconds().alias("t"))
    return seg.episodes(e, ["user_id"], "t", ["event_id"], 21600.0).select("user_id", "event_id", "episode")


@R.add(f"""with e as (select user_id, event_id, {SECONDS} as t, {CONF} as c, event_type from events),
 r as (select *, row_number() over (partition by user_id order by t, event_id) - row_number() over (partition by user_id, c >= 0.5 order by t, event_id) as g from e)
select user_id, count(*) as n_windows, max(c) as peak, arg_max(event_type, c) as peak_class, min(event_id) as first_event from r where c >= 0.5 group by user_id, g having count(*) >= 2""")
def consecutive_run(d: Tables) -> DataFrame:
    """Runs of two or more consecutive windows over the level, with their peak and its class."""
    e = d.events.select("user_id", "event_id", seconds().alias("t"), confidence().alias("c"), "event_type")
    runs = seg.runs(e, ["user_id"], ["t", "event_id"], F.col("c") >= 0.5).where("c >= 0.5")
    g = runs.groupBy("user_id", "run").agg(F.count("*").alias("n_windows"), F.max("c").alias("peak"), F.max_by("event_type", F.struct("c", -F.col("t"))).alias("peak_class"), F.min("event_id").alias("first_event"))
    return g.where("n_windows >= 2").drop("run")


@R.add(f"""with e as (select user_id, event_id, {SECONDS} as t, event_type as v from events),
 c as (select *, case when v <> 'click' then v end as cand, row_number() over (partition by user_id order by t, event_id) - row_number() over (partition by user_id, case when v <> 'click' then v end order by t, event_id) as g from e),
 s as (select user_id, event_id, case when cand is null then 0 else row_number() over (partition by user_id, cand, g order by t, event_id) end as streak from c)
select user_id, event_id, cast(streak as bigint) as streak, streak = 3 as switches from s""")
def confirmation_streak(d: Tables) -> DataFrame:
    e = d.events.select("user_id", "event_id", seconds().alias("t"), F.col("event_type").alias("v"), F.lit("click").alias("current"))
    return seg.confirmation_streak(e, ["user_id"], ["t", "event_id"], "v", "current").select("user_id", "event_id", "streak", "switches")


@R.add("""with recursive f as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value > 40 as s from events),
 n as (select user_id, count(*) as n from f group by 1),
 p as (select user_id, i, case when i - lag(i) over (partition by user_id order by i) <= 3 then 0 else 1 end as new from f where s),
 q as (select user_id, i, sum(new) over (partition by user_id order by i) as island from p),
 e as (select a.user_id, a.i as a, max(b.i) + 4 as fin from q a join q b on a.user_id = b.user_id and a.island = b.island and b.i >= a.i and b.i < a.i + 12 group by all),
 x as (select e.user_id, e.a, e.fin, a + 12 <= fin - 1 as cut, min(q.i) as nxt from e left join q on q.user_id = e.user_id and q.i >= e.fin group by all),
 w as (
  select user_id, min(i) as a, greatest(0, min(i) - 1) as start from q group by 1
  union all select w.user_id, x.nxt, greatest(0, x.nxt - 1, case when x.cut then 0 else x.fin end) from w join x on x.user_id = w.user_id and x.a = w.a where x.nxt is not null)
select w.user_id, w.start as start_frame, least(x.fin, n.n) as end_frame from w join x on x.user_id = w.user_id and x.a = w.a join n on n.user_id = w.user_id""")
def vad_segments(d: Tables) -> DataFrame:
    """Speech flags by position in each journey, as padded and capped segments."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = d.events.select("user_id", (F.row_number().over(w) - 1).alias("frame"), (F.col("value") > 40).alias("speech"))
    return seg.vad_segments(frames, "user_id", "frame", "speech", 1, 3, 12)


@R.add("""with f as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i, value > 40 as s from events),
 g as (select user_id, i, case when i - lag(i) over (partition by user_id order by i) <= 4 then 0 else 1 end as n from f where s),
 h as (select user_id, i, sum(n) over (partition by user_id order by i) as island from g)
select user_id, cast(island as bigint) as island, min(i) as start_frame, max(i) + 1 as end_frame from h group by all""")
def vad_islands(d: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = d.events.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), (F.col("value") > 40).alias("s"))
    return seg.vad_islands(frames, "user_id", "i", "s", 3)


@R.add("""with r as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - row_number() over (partition by conv_id, role order by turn) as g from conversations)
select conv_id, role, min(turn) as first_turn, count(*) as n_turns, string_agg(text, ' ' order by turn) as said from r group by conv_id, role, g""")
def label_run_grouping(d: Tables) -> DataFrame:
    """Neighbouring turns of one speaker joined."""
    r = seg.runs(d.conversations, ["conv_id"], ["turn"], F.col("role"))
    g = r.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("said"))
    return g.drop("run")


@R.add("select l_orderkey, l_linenumber, l_partkey, l_shipdate from lineitem qualify row_number() over (partition by l_orderkey order by l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1")
def first_per_segment(d: Tables) -> DataFrame:
    return seg.first_per(d.lineitem, ["l_orderkey"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]).select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")


@R.add("""select o.k as l_orderkey, cast(s as int) as l_linenumber from (select l_orderkey as k, unnest(range(min(l_linenumber), max(l_linenumber) + 1)) as s from lineitem group by 1) o
  where not exists (select 1 from lineitem where l_orderkey = o.k and l_linenumber = o.s)""")
def missing_seqs(d: Tables) -> DataFrame:
    return seg.missing_seqs(d.lineitem, "l_orderkey", "l_linenumber")


@R.add("""select l_orderkey, count(case when s = n then 1 end) as n_prefix from (
  select l_orderkey, s, row_number() over (partition by l_orderkey order by s) as n from (select distinct l_orderkey, l_linenumber as s from lineitem)) group by 1""")
def contiguous_prefix(d: Tables) -> DataFrame:
    return seg.contiguous_prefix(d.lineitem, "l_orderkey", "l_linenumber", 1)


@R.add("select conv_id, string_agg(text, '' order by turn) as body, count(*) as n from conversations group by 1")
def ordered_concat(d: Tables) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return d.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("body"), F.count("*").alias("n"))


@R.add("""with r as (select p_partkey, p_brand, row_number() over (partition by p_brand order by md5(cast(p_partkey as varchar)), p_partkey) as k, count(*) over (partition by p_brand) as n from part),
 s as (select *, case when n >= 3 then greatest(1, cast(round_even(n * 0.15::double, 0) as int)) else 0 end as m from r)
select p_partkey, p_brand, case when k <= m then 'test' when k <= 2 * m then 'dev' else 'train' end as split from s""")
def rank_split(d: Tables) -> DataFrame:
    p = d.part.select(F.col("p_partkey"), "p_brand")
    return seg.rank_split(p, ["p_brand"], F.col("p_partkey").cast("string"))


@R.add("select p_brand, p_partkey, p_retailprice from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) <= 6")
def top_k_per_group(d: Tables) -> DataFrame:
    return seg.first_per(d.part.select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 6)


@R.add(f"""with recursive e as (select user_id, event_id, {SECONDS} as t from events),
 w as (select user_id, min(t) as s from e group by 1 union all
  select user_id, s from (select w.user_id, (select min(e.t) from e where e.user_id = w.user_id and e.t - w.s > 86400.0::double) as s from w) where s is not null),
 g as (select e.user_id, e.event_id, e.t, max(w.s) as s from e join w on w.user_id = e.user_id and w.s <= e.t group by all)
select user_id, event_id, t, row_number() over (partition by user_id, s order by t, event_id) <= 3 as allowed from g""")
def rate_limit_fixed(d: Tables) -> DataFrame:
    e = d.events.select("user_id", "event_id", seconds().alias("t"))
    return seg.rate_limit(e, "user_id", "t", 3, 86400.0)


@R.add(f"""select event_id, w as window_start from (select event_id, unnest(range(cast(floor({SECONDS} / 1800) as bigint) - 3, cast(floor({SECONDS} / 1800) as bigint) + 1)) as w from events)""")
def sliding_windows(d: Tables) -> DataFrame:
    """Each event in its four windows of two hours that start every half hour (numbered by start)."""
    e = d.events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    w = e.select("event_id", F.window("ts", "2 hours", "30 minutes").alias("w"))
    start = F.expr("timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', cast(w.start as timestamp_ntz)) div 30")
    return w.select("event_id", start.alias("window_start"))


@R.add(f"select cast(floor({SECONDS} / 300) as bigint) as chunk, count(*) as n, round(sum(value), 4) as total from events group by 1")
def tumbling_chunks(d: Tables) -> DataFrame:
    e = d.events.select(F.floor(seconds() / 300).alias("chunk"), "value")
    return e.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add("select conv_id, turn, cast(length(text) as int) as length from conversations qualify row_number() over (partition by conv_id order by length(text) desc, turn) = 1")
def longest_segment(d: Tables) -> DataFrame:
    c = d.conversations.withColumn("length", F.length("text"))
    return c.groupBy("conv_id").agg(F.max_by(F.struct("turn", "length"), F.struct("length", -F.col("turn"))).alias("x")).select("conv_id", "x.turn", "x.length")


@R.add("select p_brand, p_type, p_partkey, row_number() over (order by p_brand, p_type, p_partkey) as pos from part")
def alert_sort(d: Tables) -> DataFrame:
    """Sorted by three columns, with the position: within a brand, plus the sizes of the brands before."""
    p = d.part.select("p_brand", "p_type", "p_partkey")
    sizes = p.groupBy("p_brand").agg(F.count("*").alias("_n"))
    before = sizes.select("p_brand", (F.sum("_n").over(Window.orderBy("p_brand")) - F.col("_n")).alias("_before"))  # one row per brand
    out = p.withColumn("_k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_type", "p_partkey"))).join(before, "p_brand")
    return out.select("p_brand", "p_type", "p_partkey", (F.col("_k") + F.col("_before")).alias("pos")).orderBy("pos")


@R.add("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'N' order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey limit 20")
def top_negatives(d: Tables) -> DataFrame:
    x = d.lineitem.where("l_returnflag = 'N'").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(20)
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice")


@R.add("select l_orderkey, l_linenumber, l_extendedprice from lineitem where l_returnflag = 'A' order by l_extendedprice, l_orderkey, l_linenumber, l_partkey limit 20")
def lowest_positives(d: Tables) -> DataFrame:
    x = d.lineitem.where("l_returnflag = 'A'").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey").limit(20)
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice")


@R.add("select p_name, count(*) as n from part group by 1 order by n desc, p_name limit 25")
def top_frequent_texts(d: Tables) -> DataFrame:
    return d.part.groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(25)


@R.add(f"select event_id, abs({CONF} - 0.6) as off from events order by off desc, event_id limit 25")
def worst_errors(d: Tables) -> DataFrame:
    return d.events.select("event_id", F.abs(confidence() - 0.6).alias("off")).orderBy(F.desc("off"), "event_id").limit(25)


SETS = """with w as (select o_custkey as k, list_sort(list_distinct(list(o_orderpriority) filter (where o_orderstatus = 'F'))) as want, list_sort(list_distinct(list(o_orderpriority) filter (where o_orderstatus <> 'F'))) as got from orders group by 1)"""


@R.add(SETS + """ select k, coalesce(array_to_string(list_filter(coalesce(want, []), lambda x: not list_contains(coalesce(got, []), x)), ','), '') as missing,
  coalesce(array_to_string(list_filter(coalesce(want, []), lambda x: list_contains(coalesce(got, []), x)), ','), '') as hit from w""")
def want_got_sets(d: Tables) -> DataFrame:
    g = d.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("want"), F.collect_set(F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority"))).alias("got"))
    return g.select("k", F.array_join(F.array_sort(F.array_except("want", "got")), ",").alias("missing"), F.array_join(F.array_sort(F.array_intersect("want", "got")), ",").alias("hit"))


@R.add("select 'customer' as path, c_custkey as id, c_acctbal as balance from customer union all select 'supplier', s_suppkey, s_acctbal from supplier")
def union_paths(d: Tables) -> DataFrame:
    a = d.customer.select(F.lit("customer").alias("path"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(d.supplier.select(F.lit("supplier").alias("path"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


NORM = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[\p{{P}}\p{{S}}]', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')"


@R.add("select min(doc_id) as doc_id, count(*) as n_same from documents group by " + NORM.format("text"))
def dedup_normalized(d: Tables) -> DataFrame:
    """Of texts that are equal once normalised, the first (grouped by a hash of the text, not the text)."""
    return d.documents.groupBy(F.sha2(tx.normalize(F.col("text")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_same")).drop("h")


@R.add("select p_brand, min(p_partkey) as first_at from part group by 1 order by 2")
def ordered_distinct(d: Tables) -> DataFrame:
    return d.part.groupBy("p_brand").agg(F.min("p_partkey").alias("first_at")).orderBy("first_at")


@R.add("select c_custkey from customer except select o_custkey from orders")
def untested_keys_except(d: Tables) -> DataFrame:
    return d.customer.select("c_custkey").subtract(d.orders.select("o_custkey"))
