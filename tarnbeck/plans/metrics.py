"""Aggregations: counts, percentiles, confusion, sweeps, rollups, tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decisions as dec
from ..operators import metrics as m
from .base import CONF, Registry, Tables, confidence

R = Registry()


@R.add("select event_type, count(*) as n from events group by 1")
def count_by_decision(d: Tables) -> DataFrame:
    return d.events.groupBy("event_type").agg(F.count("*").alias("n"))


RANK = "list_sort(list(value))[cast(least(count(*), floor(count(*) * {0}::double) + 1) as bigint)]"


@R.add(f"select event_type, {RANK.format(0.5)} as p50, {RANK.format(0.95)} as p95, max(value) as worst, count(*) as n from events group by 1")
def latency_percentiles(d: Tables) -> DataFrame:
    return m.nearest_rank(d.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}).select("event_type", "p50", "p95", F.col("greatest").alias("worst"), "n")


@R.add(f"""select count(*) as n, count(case when event_type = 'purchase' then 1 end) as delivered, {RANK.format(0.5)} as p50, {RANK.format(0.95)} as p95, max(value) as worst,
  count(case when event_type = 'purchase' then 1 end) / nullif(count(case when event_type in ('purchase', 'error') then 1 end), 0)::double as delivery_rate from events""")
def slo_snapshot(d: Tables) -> DataFrame:
    all_ = m.nearest_rank(d.events.withColumn("all", F.lit(1)), ["all"], "value", {"p50": 0.5, "p95": 0.95})
    sent = d.events.agg(F.count_if(F.col("event_type") == "purchase").alias("delivered"), F.count_if(F.col("event_type").isin("purchase", "error")).alias("tried"))
    out = all_.crossJoin(sent)  # one row each
    return out.select("n", "delivered", "p50", "p95", F.col("greatest").alias("worst"), (F.col("delivered") / F.nullif("tried", F.lit(0))).alias("delivery_rate"))


@R.add(f"select o_orderpriority, round(avg(o_totalprice), 4) as mean, median(o_totalprice) as mid, {RANK.format(0.95).replace('value', 'o_totalprice')} as p95, max(o_totalprice) as worst from orders group by 1")
def latency_stats(d: Tables) -> DataFrame:
    middle = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)}
    ranks = m.nearest_rank(d.orders, ["o_orderpriority"], "o_totalprice", {"p95": 0.95, **middle})
    rest = d.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    mid = F.col("low") * 0.5 + F.col("high") * 0.5
    return rest.join(ranks.select("o_orderpriority", mid.alias("mid"), "p95", F.col("greatest").alias("worst")), "o_orderpriority").select("o_orderpriority", "mean", "mid", "p95", "worst")


@R.add("""with c as (select count(case when quality = 1 and n_chars > 900 then 1 end) as tp, count(case when quality = 1 and n_chars <= 900 then 1 end) as fn,
  count(case when quality = 0 and n_chars > 900 then 1 end) as fp, count(case when quality = 0 and n_chars <= 900 then 1 end) as tn from documents join labels using (doc_id))
select tp, fn, fp, tn, tp / greatest(tp + fn, 1)::double as recall, fp / greatest(fp + tn, 1)::double as fpr, (tp + tn) / greatest(tp + fn + fp + tn, 1)::double as accuracy, tp / greatest(tp + fp, 1)::double as "precision" from c""")
def confusion_metrics(d: Tables) -> DataFrame:
    x = d.documents.select("doc_id", "n_chars").join(d.labels, "doc_id")
    return m.confusion(x, [], F.col("quality") == 1, F.col("n_chars") > 900)


@R.add("""select o_orderpriority as condition, count(case when o_totalprice > 250000 then 1 end) / count(*)::double as recall, round(avg(o_totalprice), 4) as mean_latency, count(*) as n
  from orders where o_orderstatus = 'F' group by 1""")
def recall_by_condition(d: Tables) -> DataFrame:
    f = d.orders.where("o_orderstatus = 'F'")
    return f.groupBy(F.col("o_orderpriority").alias("condition")).agg((F.count_if(F.col("o_totalprice") > 250000) / F.count("*")).alias("recall"), F.round(F.avg("o_totalprice"), 4).alias("mean_latency"), F.count("*").alias("n"))


GRID = "select unnest(range(1, 100)) as g"
SCORED = f"select {CONF} as s, event_type in ('error', 'purchase') as y from events"


def _scored(d: Tables) -> DataFrame:
    return d.events.select(confidence().alias("s"), F.col("event_type").isin("error", "purchase").alias("y"))


@R.add(f"""select g, count(case when y and s >= g / 100.0::double then 1 end) / greatest(count(case when y then 1 end), 1)::double as recall,
  count(case when not y and s >= g / 100.0::double then 1 end) / greatest(count(case when not y then 1 end), 1)::double as fpr from ({SCORED}), ({GRID}) group by 1""")
def threshold_sweep(d: Tables) -> DataFrame:
    return m.sweep(_scored(d), "s", "y", 100).select("g", "recall", "fpr")


@R.add(f"""with w as (select g, count(case when y and s >= g / 100.0::double then 1 end) / greatest(count(case when y then 1 end), 1)::double as recall from ({SCORED}), ({GRID}) group by 1)
select coalesce(max(g) filter (where recall >= 0.95) / 100.0::double, 0.01::double) as threshold from w""")
def threshold_at_recall(d: Tables) -> DataFrame:
    w = m.sweep(_scored(d), "s", "y", 100)
    return w.agg(F.coalesce(F.max(F.when(F.col("recall") >= 0.95, F.col("g"))) / 100.0, F.lit(0.01)).alias("threshold"))


@R.add(f"""with w as (select g, count(case when s >= g / 100.0::double then 1 end) / count(*)::double as kept from ({SCORED}), ({GRID}) where y group by 1)
select max(g) filter (where kept >= 0.995) / 100.0::double as threshold from w""")
def veto_threshold_pick(d: Tables) -> DataFrame:
    w = m.sweep(_scored(d).where("y"), "s", "y", 100)
    return w.agg((F.max(F.when(F.col("recall") >= 0.995, F.col("g"))) / 100.0).alias("threshold"))


@R.add("select (min(case when o_orderstatus = 'F' then o_totalprice end) + max(case when o_orderstatus = 'O' then o_totalprice end)) / 2 as threshold from orders")
def margin_threshold(d: Tables) -> DataFrame:
    return d.orders.agg(((F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) + F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")))) / 2).alias("threshold"))


@R.add("""select source, count(case when lang = 'en' then 1 end) as en, count(case when lang = 'fr' then 1 end) as fr, count(case when lang = 'de' then 1 end) as de, count(case when lang = 'es' then 1 end) as es from documents group by 1""")
def category_split_pivot(d: Tables) -> DataFrame:
    return d.documents.groupBy("source").pivot("lang", ["en", "fr", "de", "es"]).count().na.fill(0)


@R.add("""select p_brand, max(case when p_type = 'ECONOMY' then p_size >= 25 end) as economy, max(case when p_type = 'STANDARD' then p_size >= 25 end) as standard, max(case when p_type = 'PROMO' then p_size >= 25 end) as promo
  from (select p_brand, p_type, arg_min(p_size, p_partkey) as p_size from part group by 1, 2) group by 1""")
def pass_fail_matrix(d: Tables) -> DataFrame:
    first = d.part.groupBy("p_brand", "p_type").agg(F.min_by("p_size", "p_partkey").alias("p_size"))
    kinds = ["ECONOMY", "STANDARD", "PROMO"]
    return first.groupBy("p_brand").pivot("p_type", kinds).agg(F.first(F.col("p_size") >= 25)).select("p_brand", *[F.col(k).alias(k.lower()) for k in kinds])


@R.add("select split_part(p_name, ' ', 1) as category, count(*) as n, count(case when p_size > 25 then 1 end) / count(*)::double as rate from part group by 1")
def category_hit_rate(d: Tables) -> DataFrame:
    return d.part.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("category")).agg(F.count("*").alias("n"), (F.count_if(F.col("p_size") > 25) / F.count("*")).alias("rate"))


@R.add("select l_returnflag, cast(count(distinct l_orderkey) as bigint) as journeys, cast(count(distinct (l_orderkey, l_linenumber)) as bigint) as segments from lineitem group by 1")
def distinct_segments(d: Tables) -> DataFrame:
    return d.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("journeys"), F.countDistinct("l_orderkey", "l_linenumber").alias("segments"))


@R.add("""with a as (select l_returnflag as category, count(*) as alerts, sum(l_quantity) / 100 as hours from lineitem group by 1)
select coalesce(category, 'ALL') as category, round(sum(alerts) / sum(hours), 6) as per_hour, cast(sum(alerts) as bigint) as alerts from a group by rollup(category)""")
def fa_per_hour_rollup(d: Tables) -> DataFrame:
    """Alerts per hour by category, and over all: a ratio of sums, not a mean of ratios."""
    r = d.lineitem.rollup(F.col("l_returnflag").alias("category")).agg(F.count("*").alias("alerts"), (F.sum("l_quantity") / 100).alias("hours"))
    return r.select(F.coalesce("category", F.lit("ALL")).alias("category"), F.round(F.col("alerts") / F.col("hours"), 6).alias("per_hour"), "alerts")


@R.add("select round(count(*) / (sum(l_quantity) / 100), 6) as per_hour, count(*) as alerts from lineitem")
def sealed_totals(d: Tables) -> DataFrame:
    """The report of a sealed set: totals only, nothing that names a category, a file or a time."""
    return d.lineitem.agg(F.round(F.count("*") / (F.sum("l_quantity") / 100), 6).alias("per_hour"), F.count("*").alias("alerts"))


TIER = f"case when {CONF} >= 0.85 then 2 when {CONF} >= 0.6 then 1 else 0 end"


@R.add(f"select user_id, case max({TIER}) when 2 then 'TRIGGER_ALL' when 1 then 'TRIGGER_VERIFY' else 'NO_ACTION' end as tier, max({CONF}) as confidence from events group by 1")
def clip_tier_max(d: Tables) -> DataFrame:
    g = d.events.withColumn("c", confidence()).groupBy("user_id").agg(F.max(dec.tier_rank(dec.tier(F.col("c")))).alias("r"), F.max("c").alias("confidence"))
    return g.select("user_id", F.element_at(F.array(*[F.lit(x) for x in dec.TIERS]), F.col("r") + 1).alias("tier"), "confidence")


@R.add(f"""with p as (select user_id, case when event_type in ('click', 'view') then 'whisper' else 'parakeet' end as path, max({TIER}) as r, max({CONF}) as c from events group by 1, 2)
select user_id, path, c as confidence from p qualify row_number() over (partition by user_id order by r desc, c desc, path desc) = 1""")
def either_path_argmax(d: Tables) -> DataFrame:
    """The stronger path by tier, then confidence; the first path wins ties."""
    e = d.events.withColumn("c", confidence()).withColumn("path", F.when(F.col("event_type").isin("click", "view"), "whisper").otherwise("parakeet"))
    p = e.groupBy("user_id", "path").agg(F.max(dec.tier_rank(dec.tier(F.col("c")))).alias("r"), F.max("c").alias("confidence"))
    best = F.max_by(F.struct("path", "confidence"), F.struct("r", "confidence", F.col("path") == "whisper"))
    return p.groupBy("user_id").agg(best.alias("b")).select("user_id", "b.*")


@R.add("select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as ids from orders group by 1")
def udk_set_union(d: Tables) -> DataFrame:
    return d.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("ids"))


@R.add("select l_orderkey, round(avg(l_discount), 6) as avg_logprob, max(l_tax) as temperature, round(avg(l_quantity), 6) as no_speech, max(l_extendedprice) as compression from lineitem group by 1")
def stt_metadata_agg(d: Tables) -> DataFrame:
    return d.lineitem.groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 6).alias("avg_logprob"), F.max("l_tax").alias("temperature"), F.round(F.avg("l_quantity"), 6).alias("no_speech"), F.max("l_extendedprice").alias("compression"))


@R.add(f"""with v as (select * from (values ('loose', 0.3), ('base', 0.5), ('strict', 0.7)) t(variant, thr)), e as (select user_id, event_type, {CONF} as s from events)
select variant, event_type, count(case when s >= thr then 1 end) as kept, cast(count(distinct case when s >= thr then user_id end) as bigint) as journeys,
  cast(count(distinct user_id) - count(distinct case when s >= thr then user_id end) as bigint) as lost from e, v group by 1, 2""")
def veto_variant_tally(d: Tables) -> DataFrame:
    variants = [("loose", 0.3), ("base", 0.5), ("strict", 0.7)]
    e = d.events.select("user_id", "event_type", confidence().alias("s"))
    e = e.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.lit(t).alias("thr")) for n, t in variants])).alias("v")).withColumn("hit", F.col("s") >= F.col("v.thr"))
    one = e.groupBy(F.col("v.variant").alias("variant"), "event_type", "user_id").agg(F.count_if("hit").alias("k"))
    return one.groupBy("variant", "event_type").agg(F.sum("k").alias("kept"), F.count_if(F.col("k") > 0).alias("journeys"), F.count_if(F.col("k") == 0).alias("lost"))


@R.add("""select o_custkey, case when sum(f) = 3 then 'always' when sum(f) = 0 then 'never' else 'sometimes' end as stability from (
  select o_custkey, r, max(case when ascii(o_orderpriority) - 48 = r + 1 and o_orderstatus = 'F' then 1 else 0 end) as f from orders, (select unnest(range(3)) as r) group by 1, 2) group by 1""")
def trigger_stability(d: Tables) -> DataFrame:
    """Whether a clip fires in all, none or some of three runs."""
    fired = [F.max(((F.ascii("o_orderpriority") - 48 == r + 1) & (F.col("o_orderstatus") == "F")).cast("int")) for r in range(3)]
    g = d.orders.groupBy("o_custkey").agg(sum(fired[1:], fired[0]).alias("n"))
    return g.select("o_custkey", F.when(F.col("n") == 3, "always").when(F.col("n") == 0, "never").otherwise("sometimes").alias("stability"))


@R.add("""select opening, count(*) as n from (select array_to_string(string_split_regex(text, '\\s+')[1:2], ' ') as opening from conversations) group by 1 having count(*) > 2""")
def opening_repeat_having(d: Tables) -> DataFrame:
    """Openings of two words that more than two turns share."""
    o = F.array_join(F.slice(F.split("text", r"\s+"), 1, 2), " ")
    return d.conversations.groupBy(o.alias("opening")).agg(F.count("*").alias("n")).where("n > 2")


@R.add("select event_type as stage, count(*) as calls, round(sum(value), 4) as total_s, round(sum(value) / (select count(distinct user_id) from events), 6) as per_clip_s, max(value) as slowest from events group by 1")
def stage_timing(d: Tables) -> DataFrame:
    clips = d.events.agg(F.countDistinct("user_id").alias("clips"))
    g = d.events.groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("calls"), F.sum("value").alias("s"), F.max("value").alias("slowest")).crossJoin(clips)
    return g.select("stage", "calls", F.round("s", 4).alias("total_s"), F.round(F.col("s") / F.col("clips"), 6).alias("per_clip_s"), "slowest")


@R.add("select label, count(*) as n, min(s) as low, max(s) as high, round(avg(s), 9) + 0.0::double as mean, median(s) as mid from (select label, embedding[1]::double as s from embeddings) group by 1")
def score_summary(d: Tables) -> DataFrame:
    e = d.embeddings.select("label", F.col("embedding")[0].cast("double").alias("s"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"), (F.round(F.avg("s"), 9) + 0.0).alias("mean"), F.median("s").alias("mid"))


@R.add(f"select event_type, g, avg(case when {CONF} >= g / 10.0::double then 1.0::double else 0.0::double end) as share from events, (select unnest(range(1, 10)) as g) group by 1, 2")
def fraction_above(d: Tables) -> DataFrame:
    e = d.events.select("event_type", confidence().alias("s"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(9).cast("long"))).alias("g"))
    return e.groupBy("event_type", "g").agg(F.avg((F.col("s") >= F.col("g") / 10.0).cast("double")).alias("share"))


@R.add("""with m as (select p_brand, p_type, avg(p_retailprice) as f0, avg(p_size) as dur from part group by 1, 2)
select b.p_type, round(avg(12 * log2(b.f0 / n.f0)), 9) as semitones, round(avg(n.dur / b.dur), 9) as tempo, count(*) as n from m b join m n on b.p_brand = n.p_brand and n.p_type = 'STANDARD' and b.p_type <> 'STANDARD' group by 1""")
def paired_shift(d: Tables) -> DataFrame:
    """Shift against the neutral reading of the same item; items without both are left out."""
    g = d.part.groupBy("p_brand", "p_type").agg(F.avg("p_retailprice").alias("f0"), F.avg("p_size").alias("dur"))
    base = g.where("p_type = 'STANDARD'").select("p_brand", F.col("f0").alias("n0"), F.col("dur").alias("nd"))
    pairs = g.where("p_type <> 'STANDARD'").join(base, "p_brand")
    return pairs.groupBy("p_type").agg(F.round(F.avg(12 * F.log2(F.col("f0") / F.col("n0"))), 9).alias("semitones"), F.round(F.avg(F.col("nd") / F.col("dur")), 9).alias("tempo"), F.count("*").alias("n"))


@R.add("""select label, pos, round(avg(x), 9) + 0.0::double as mean, max(x) as high from (select label, unnest(range(0, len(embedding))) as pos, unnest(embedding)::double as x from embeddings) group by 1, 2""")
def vector_elementwise_agg(d: Tables) -> DataFrame:
    e = d.embeddings.select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", F.col("pos").cast("long").alias("pos")).agg((F.round(F.avg(F.col("x").cast("double")), 9) + 0.0).alias("mean"), F.max(F.col("x").cast("double")).alias("high"))


@R.add("""select o_custkey, coalesce(min(o_totalprice) filter (where o_orderstatus = 'F') > max(o_totalprice) filter (where o_orderstatus <> 'F'), false) as holds from orders group by 1""")
def separability_check(d: Tables) -> DataFrame:
    fail, ok = F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.max(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")))
    return d.orders.groupBy("o_custkey").agg(F.coalesce(fail > ok, F.lit(False)).alias("holds"))


@R.add("""select p_type, avg(case when contains(p_name, 'red') then 1.0::double else 0.0::double end) as accuracy, count(*) as n,
  cast(count(case when not contains(p_name, 'red') then 1 end) as bigint) as misses from part group by 1""")
def accuracy_by_group(d: Tables) -> DataFrame:
    hit = F.col("p_name").contains("red")
    return d.part.groupBy("p_type").agg(F.avg(hit.cast("double")).alias("accuracy"), F.count("*").alias("n"), F.count_if(~hit).alias("misses"))


@R.add("select lang, (1 - avg(quality)) / avg(quality) as weight from documents join labels using (doc_id) group by 1")
def class_balance_weight(d: Tables) -> DataFrame:
    x = d.documents.select("doc_id", "lang").join(d.labels, "doc_id")
    return x.groupBy("lang").agg(((1 - F.avg("quality")) / F.avg("quality")).alias("weight"))
