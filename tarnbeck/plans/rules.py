"""Predicates, joins, text matching and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FUNCTION_WORDS, NON_DISTINCTIVE, ORDINARY_PHRASES, RULES
from ..functions import security as sec
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import corpus, decisions as dec, joins, matching as mt
from .base import CONF, SECONDS, Registry, Tables, confidence, seconds
from .ordered import NORM

R = Registry()
TEXT_NORM = NORM.format("text")
WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
FUNCTION = "[" + ", ".join(f"'{w}'" for w in FUNCTION_WORDS) + "]"
STOP = "[" + ", ".join(f"'{w}'" for w in NON_DISTINCTIVE) + "]"


@R.add(f"select event_id, case when {CONF} >= 0.85 then 'TRIGGER_ALL' when {CONF} >= 0.6 then 'TRIGGER_VERIFY' else 'NO_ACTION' end as decision from events")
def confidence_tier(d: Tables) -> DataFrame:
    return d.events.select("event_id", dec.tier(confidence()).alias("decision"))


SUSPECT = "coalesce(case when event_id % 5 <> 0 then -value / 50 end < -1.0, false) or coalesce(case when event_id % 7 <> 0 then (event_id % 3) / 10.0::double end > 0.0, false)"


def _suspect() -> F.Column:
    logprob = F.when(F.col("event_id") % 5 != 0, -F.col("value") / 50)
    return dec.stt_suspect(logprob, F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 3) / 10.0))


@R.add(f"select event_id, {SUSPECT} as suspect from events")
def stt_suspect_filter(d: Tables) -> DataFrame:
    return d.events.select("event_id", _suspect().alias("suspect"))


@R.add(f"select event_id, case when ({SUSPECT}) and event_id % 11 <> 0 and event_type <> 'click' then least({CONF}, 0.59::double) else {CONF} end as confidence from events")
def confidence_veto_cap(d: Tables) -> DataFrame:
    layer = F.when(F.col("event_type") == "click", "kws").otherwise("exact")
    return d.events.select("event_id", dec.veto_cap(confidence(), _suspect(), F.col("event_id") % 11 == 0, layer).alias("confidence"))


@R.add(f"select doc_id, len(list_filter({WORDS.format(TEXT_NORM)}, lambda w: not list_contains({STOP}, w))) = 0 as filler from documents")
def non_distinctive_filter(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", tx.is_non_distinctive(tx.normalize(F.col("text"))).alias("filler"))


@R.add()
def anchor_predicate(d: Tables) -> DataFrame:
    """Turns with a content word of a phrase (phrases derived from the turns' openings)."""
    found = mt.anchored_phrases(d.conversations, "text", mt.derived_phrases(d.conversations, "text"))
    return found.groupBy("udk_id").agg(F.count("*").alias("n_texts"))


@R.add()
def phrase_distinctiveness(d: Tables) -> DataFrame:
    """Candidate phrases (part names) with the everyday phrase that they come too close to, if any."""
    everyday = d.spark.createDataFrame([(k, p) for k, p in enumerate(ORDINARY_PHRASES)], "k int, ordinary string")  # nine rows
    names = d.part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("phrase")).distinct()
    s = names.crossJoin(F.broadcast(everyday)).withColumn("s", sim.token_set_ratio_col(tx.normalize(F.col("phrase")), tx.normalize(F.col("ordinary"))) / 100)
    first = s.groupBy("phrase").agg(F.max("s").alias("closest"), F.min(F.when(F.col("s") >= 0.75, F.struct("k", "ordinary"))).alias("hit"))
    enough = F.size(F.split("phrase", " ")) >= 3
    return first.select("phrase", "closest", "hit.ordinary", (enough & F.col("hit").isNull()).alias("accepted"))


@R.add()
def phrase_intelligibility(d: Tables) -> DataFrame:
    heard = F.regexp_replace("p_name", "[aeiou]", "e")
    return d.part.select("p_partkey", (sim.token_set_ratio_col(tx.normalize(F.col("p_name")), tx.normalize(heard)) / 100 >= 0.6).alias("clear"))


@R.add("select doc_id, case when lang in ('en', 'hi', 'te', 'kn', 'ta') then lang else 'en' end as language from documents")
def language_fallback(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", F.when(F.col("lang").isin("en", "hi", "te", "kn", "ta"), F.col("lang")).otherwise("en").alias("language"))


@R.add()
def heard_by_both(d: Tables) -> DataFrame:
    """Neighbouring turns as the two transcripts of one segment."""
    c = d.conversations
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    same = (F.col("other") != "") & (sim.token_set_ratio_col(F.lower("text"), F.lower("other")) >= RULES.agree_ratio)
    return c.join(other, ["conv_id", "turn"]).select("conv_id", "turn", same.alias("both"))


@R.add(f"""with e as (select event_id, case event_type when 'view' then 'PERSONAL' else 'GENERAL' end as kind, case event_type when 'click' then 'kws' when 'error' then 'exact' else 'fuzzy/sentence' end as layer,
  1 + event_id % 3 as words, {CONF} as p, event_id % 2 = 0 as "both", event_id % 13 = 0 as single from events)
select event_id, case when kind = 'GENERAL' and split_part(layer, '/', 1) in ('exact', 'fuzzy', 'semantic') and (case when words <= 1 then p < 0.3::double else ("both" or (single and not starts_with(layer, 'exact'))) and p < 0.5::double end) then p end as veto from e""")
def intent_veto_rule(d: Tables) -> DataFrame:
    e = d.events.select("event_id", F.when(F.col("event_type") == "view", "PERSONAL").otherwise("GENERAL").alias("kind"), F.when(F.col("event_type") == "click", "kws").when(F.col("event_type") == "error", "exact").otherwise("fuzzy/sentence").alias("layer"), (1 + F.col("event_id") % 3).alias("words"), confidence().alias("p"), (F.col("event_id") % 2 == 0).alias("both"), (F.col("event_id") % 13 == 0).alias("single"))
    text_layer = F.split_part("layer", F.lit("/"), F.lit(1)).isin("exact", "fuzzy", "semantic")
    heard = F.col("both") | (F.col("single") & ~F.col("layer").startswith("exact"))
    low = F.when(F.col("words") <= 1, F.col("p") < 0.3).otherwise(heard & (F.col("p") < 0.5))
    return e.select("event_id", F.when((F.col("kind") == "GENERAL") & text_layer & low, F.col("p")).alias("veto"))


@R.add(f"select event_id from events where event_type <> 'purchase' and {CONF} < 0.75")
def weak_alert_filter(d: Tables) -> DataFrame:
    return d.events.where((F.col("event_type") != "purchase") & (confidence() < 0.75)).select("event_id")


@R.add("""select o_orderkey, case when contains(o_orderpriority, 'NOT') then '' else array_to_string(regexp_extract_all('clip UDK_' || lpad(cast(o_custkey % 20 + 1 as varchar), 2, '0') || ' UDK_07', 'UDK_\\d\\d'), ',') end as ids from orders""")
def label_from_name(d: Tables) -> DataFrame:
    name = F.concat(F.lit("clip UDK_"), F.lpad((F.col("o_custkey") % 20 + 1).cast("string"), 2, "0"), F.lit(" UDK_07"))
    ids = F.array_join(F.regexp_extract_all(name, F.lit(r"(UDK_\d\d)"), 1), ",")
    return d.orders.select("o_orderkey", F.when(F.contains("o_orderpriority", F.lit("NOT")), "").otherwise(ids).alias("ids"))


@R.add(f"""select event_id, 'UDK_' || (user_id % 20) as udk, event_type as layer, round({CONF}, 2) as confidence, 'whisper' as stt from events where event_type <> 'error'""")
def rule_string_parse(d: Tables) -> DataFrame:
    """Rules as printed in a report, taken apart again; others (sound alone) do not parse."""
    printed = F.when(F.col("event_type") == "error", "scream-alone (Screaming 0.41)").otherwise(F.concat(F.lit("UDK UDK_"), F.col("user_id") % 20, F.lit(" ("), "event_type", F.lit(" "), F.round(confidence(), 2), F.lit(", whisper)")))
    return corpus.parse_rules(d.events.select("event_id", printed.alias("rule")), "rule").drop("rule")


@R.add("select event_id, cast(epoch_us(ts) // 1000000 % 86400 as bigint) as s, strftime(ts, '%H:%M:%S') as hms from events")
def hms_seconds(d: Tables) -> DataFrame:
    hms = F.date_format(F.col("ts").cast("timestamp_ntz"), "HH:mm:ss")
    p = F.split(hms, ":")
    return d.events.select("event_id", (p[0].cast("long") * 3600 + p[1].cast("long") * 60 + p[2].cast("long")).alias("s"), hms.alias("hms"))


@R.add(f"""with u as (select user_id, max(case when event_type = 'error' then 1 else 0 end) = 1 as had, max({SECONDS}) as last from events group by 1), n as (select max({SECONDS}) as now from events)
select user_id, case when now - last > (case when had then 10 else 20 end) * 3600 then case when had then 'TIMED_OUT_AFTER_TRIGGER' else 'TIMED_OUT' end else 'ACTIVE' end as status from u, n""")
def heartbeat_timeout(d: Tables) -> DataFrame:
    """Silent journeys (the grace is in hours here, 10 after a trigger and 20 before)."""
    u = d.events.groupBy("user_id").agg(F.max(F.col("event_type") == "error").alias("had"), F.max(seconds()).alias("last"))
    now = d.events.agg(F.max(seconds()).alias("now"))  # one row
    grace = F.when(F.col("had"), 10).otherwise(20) * 3600
    state = F.when(F.col("now") - F.col("last") > grace, F.when(F.col("had"), "TIMED_OUT_AFTER_TRIGGER").otherwise("TIMED_OUT")).otherwise("ACTIVE")
    return u.crossJoin(now).select("user_id", state.alias("status"))


@R.add("""select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey) and
  (select max(o_orderdate) from orders where o_custkey = c_custkey) < timestamp '1998-08-02' - (case when exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') then interval 180 day else interval 30 day end)""")
def retention_expired(d: Tables) -> DataFrame:
    g = d.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("timestamp_ntz")).alias("last"), F.max(F.col("o_orderstatus") == "F").alias("flagged"))
    days = F.when(F.col("flagged"), RULES.retain_flagged_days).otherwise(RULES.retain_days)
    late = F.col("last") < F.expr("timestamp_ntz'1998-08-02 00:00:00'") - F.make_dt_interval(days)
    return d.customer.select("c_custkey").join(g, "c_custkey").where(late).select("c_custkey")


#: CRC-32 in DuckDB, byte by byte and bit by bit.
CRC32 = """xor(4294967295::bigint, list_reduce(list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), cast(2 * i + 1 as int), 2))::bigint),
  lambda c, b: list_reduce(range(8), lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end, xor(c, b)), 4294967295::bigint))"""


@R.add(f"select page_id, case when {CRC32.format('url')} % 2 = 0 then 'dev' else 'sealed' end as half from pages")
def crc_split(d: Tables) -> DataFrame:
    return d.pages.select("page_id", F.when(F.crc32(F.encode("url", "utf-8")) % 2 == 0, "dev").otherwise("sealed").alias("half"))


@R.add("select c_custkey, c_name, true as hidden from customer")
def field_encrypt_roundtrip(d: Tables) -> DataFrame:
    keys = {"k1": "0123456789abcdef", "k2": "fedcba9876543210"}
    e = d.customer.select("c_custkey", F.col("c_name").alias("plain"), F.when(F.col("c_custkey") % 2 == 0, sec.encrypt(F.col("c_name"), keys["k1"], "k1")).otherwise(sec.encrypt(F.col("c_name"), keys["k2"], "k2")).alias("secret"))
    return e.select("c_custkey", sec.decrypt(F.col("secret"), keys).alias("c_name"), (~F.contains("secret", "plain")).alias("hidden"))


@R.add("select event_id, event_id % 4 <> 0 and event_id >= 5000 as valid from events")
def signed_token_verify(d: Tables) -> DataFrame:
    """Tokens that expire at the event's number, checked at 5000; every fourth was made for another path."""
    path = F.concat(F.lit("/audio/"), F.col("user_id").cast("string"))
    token = sec.sign_token(F.col("event_id"), F.when(F.col("event_id") % 4 == 0, "/other").otherwise(path), "secret")
    return d.events.select("event_id", sec.token_valid(token, path, F.lit(5000), "secret").alias("valid"))


@R.add()
def phrase_match_best(d: Tables) -> DataFrame:
    """Each turn's best phrase, layer and confidence."""
    best = mt.best_match(d.conversations, "text", mt.derived_phrases(d.conversations, "text"))
    return d.conversations.join(best, "text").select("conv_id", "turn", "udk_id", "layer", F.round("confidence", 6).alias("confidence"))


@R.add("""select event_id, n_name as phrase, case when n_name is null then 0.0::double else 0.65::double end as confidence from events left join nation on n_nationkey = user_id % 40""")
def kws_lookup_left(d: Tables) -> DataFrame:
    """Spotted ids looked up in the dictionary; an unknown id is no match."""
    names = d.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("phrase"))
    return d.events.withColumn("k", F.col("user_id") % 40).join(names, "k", "left").select("event_id", "phrase", F.when(F.col("phrase").isNull(), 0.0).otherwise(RULES.spotted_confidence).alias("confidence"))


@R.add("""with s as (select o_custkey as seg, max(o_orderpriority) as phrase, max(o_totalprice) / 500000 as confidence from orders where o_orderstatus = 'F' group by 1),
 k as (select o_custkey as seg, max(o_orderpriority) as spotted, min(o_totalprice) / 500000 as distance from orders where o_orderstatus = 'O' group by 1)
select seg, case when coalesce(confidence, 0) >= kc then phrase else spotted end as phrase, case when coalesce(confidence, 0) >= kc then coalesce(confidence, 0) else kc end as confidence,
  case when coalesce(confidence, 0) >= kc then 'text' else 'kws' end as layer, coalesce(phrase = spotted and distance <= 0.15, false) as agree
from (select coalesce(s.seg, k.seg) as seg, phrase, confidence, spotted, distance, case when spotted is null then 0.0::double else 0.65::double end as kc from s full join k on s.seg = k.seg)""")
def branch_fusion(d: Tables) -> DataFrame:
    f, o = d.orders.where("o_orderstatus = 'F'"), d.orders.where("o_orderstatus = 'O'")
    stt = f.groupBy(F.col("o_custkey").alias("seg")).agg(F.max("o_orderpriority").alias("phrase"), (F.max("o_totalprice") / 500000).alias("confidence"))
    kws = o.groupBy(F.col("o_custkey").alias("seg")).agg(F.max("o_orderpriority").alias("spotted"), (F.min("o_totalprice") / 500000).alias("distance"))
    return dec.fuse(stt, kws, ["seg"])


@R.add(f"""with e as (select event_id, user_id, event_type, {SECONDS} as t from events)
select a.event_id, exists (select 1 from e b where b.user_id = a.user_id and b.event_type <> a.event_type and abs(b.t - a.t) <= 3600) as agrees from e a""")
def band_self_join_agree(d: Tables) -> DataFrame:
    e = d.events.select("event_id", "user_id", "event_type", seconds().alias("t"))
    return joins.band_differs(e, ["user_id"], "t", 3600.0, "event_type").select("event_id", "agrees")


SPANS = f"select user_id, event_id as span, event_type as spk, {SECONDS} as a, {SECONDS} + value * 600 as b from events where event_type in ('signup', 'purchase')"


def _spans(d: Tables) -> DataFrame:
    s = d.events.where(F.col("event_type").isin("signup", "purchase")).select("user_id", F.col("event_type").alias("spk"), seconds().alias("a"), F.col("value"))
    return s.withColumn("b", F.col("a") + F.col("value") * 600)


@R.add(f"""select p.event_id, coalesce((select string_agg(distinct s.spk, '+' order by s.spk) from ({SPANS}) s where s.user_id = p.user_id and p.t between s.a and s.b), '') as who
  from (select event_id, user_id, {SECONDS} as t from events where event_type in ('click', 'view', 'error')) p""")
def interval_join_speaker(d: Tables) -> DataFrame:
    p = d.events.where(F.col("event_type").isin("click", "view", "error")).select("event_id", "user_id", seconds().alias("t"))
    j = joins.interval_lookup(p, _spans(d), ["user_id"], "t", "a", "b", "spk", 86400.0)
    return j.select("event_id", F.array_join("within", "+").alias("who"))


@R.add(f"""with p as (select event_id, user_id, {SECONDS} as t from events where event_type in ('click', 'view', 'error')), s as ({SPANS})
select event_id, spk as nearest, a as nearest_at from (select p.event_id, s.spk, s.a, row_number() over (partition by p.event_id order by abs(s.a - p.t), s.a, s.spk) as k from p join s on s.user_id = p.user_id) where k = 1""")
def nearest_asof_speaker(d: Tables) -> DataFrame:
    p = d.events.where(F.col("event_type").isin("click", "view", "error")).select("event_id", "user_id", seconds().alias("t"))
    return joins.nearest(p, _spans(d), ["user_id"], "t", "a", "spk").select("event_id", "nearest", "nearest_at").where("nearest is not null")


@R.add("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 400000)")
def flagged_semi(d: Tables) -> DataFrame:
    hot = d.orders.where("o_orderstatus = 'F' and o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return d.customer.join(hot, "c_custkey", "left_semi").select("c_custkey", "c_name")


@R.add()
def decontaminate_anti(d: Tables) -> DataFrame:
    """Sentences of turns that no benchmark sentence resembles (ratio of 85 at least, three words or more)."""
    s = d.conversations.select("conv_id", "turn", F.explode(tx.sentences(F.col("text"))).alias("s"))
    held = d.benchmark.select(F.explode(tx.sentences(F.col("text"))).alias("h"))
    return corpus.unlike_held_out(s, "s", held, "h", 85.0).groupBy("conv_id").agg(F.count("*").alias("n_sentences"))


@R.add()
def near_heldout_filter(d: Tables) -> DataFrame:
    """Sentences near a held-out one (word sets alike to 90) go from dev and test, not from train."""
    s = d.conversations.select("conv_id", "turn", F.explode(tx.sentences(F.col("text"))).alias("s")).withColumn("split", tx.md5_split(F.col("s")))
    held = d.benchmark.select(F.explode(tx.sentences(F.col("text"))).alias("h"))
    out = corpus.near_held_out(s, "s", held, "h", 90.0)
    return out.where((F.col("split") == "train") | ~F.col("near")).groupBy("split").agg(F.count("*").alias("n"))


@R.add("select o_orderkey, coalesce(c_mktsegment, 'unknown') as segment from orders left join (select * from customer where c_acctbal > 0) on c_custkey = o_custkey")
def manifest_left_join(d: Tables) -> DataFrame:
    m = d.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return d.orders.join(m, "o_custkey", "left").select("o_orderkey", F.coalesce("segment", F.lit("unknown")).alias("segment"))


@R.add()
def fuzzy_best_join(d: Tables) -> DataFrame:
    """Types with names to part names by the best weighted score; for small parts the part name is known."""
    titles = d.part.select(F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("title"), F.when(F.col("p_size") <= 5, F.col("p_name")).alias("known"))
    return joins.best_titles(titles, "title", "known", d.part, "p_name")


@R.add("""with q as (select p_name, p_size, p_partkey, array_to_string(string_split(p_type || ' ' || p_brand, ' ')[1:1], ' ') as lead from part)
select a.p_partkey as one, b.p_partkey as zero from q a join q b on a.p_name = b.p_name and a.lead = b.lead and a.p_size > 40 and b.p_size < 5""")
def reason_added_pairs(d: Tables) -> DataFrame:
    """The same text with either label in contexts that open alike."""
    q = d.part.select("p_name", F.split_part(F.concat_ws(" ", "p_type", "p_brand"), F.lit(" "), F.lit(1)).alias("lead"), "p_size", "p_partkey")
    a, b = q.where("p_size > 40").select("p_name", "lead", F.col("p_partkey").alias("one")), q.where("p_size < 5").select("p_name", "lead", F.col("p_partkey").alias("zero"))
    return a.join(b, ["p_name", "lead"]).select("one", "zero")


@R.add("""with g as (select o_custkey as clip, max(case when o_orderstatus = 'F' then 1 else 0 end) as base, max(case when o_orderstatus = 'O' then 1 else 0 end) as new from orders group by 1)
select clip, base = 1 as base, new = 1 as new, base = 1 and new = 0 as regression from g""")
def run_regression_join(d: Tables) -> DataFrame:
    run = lambda s, n: d.orders.groupBy(F.col("o_custkey").alias("clip")).agg(F.max(F.col("o_orderstatus") == s).alias(n))
    return run("F", "base").join(run("O", "new"), "clip", "full_outer").select("clip", "base", "new", (F.col("base") & ~F.col("new")).alias("regression"))


@R.add("""select a.conv_id, a.turn, coalesce(string_agg(b.text, ' ' order by b.turn), '') as context from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn < a.turn and b.turn >= a.turn - 2 group by 1, 2""")
def context_window_text(d: Tables) -> DataFrame:
    c = d.conversations.withColumn("t", F.col("turn").cast("double"))
    return joins.context_window(c, ["conv_id"], "t", "turn", "text", 2.0).select("conv_id", "turn", "context")


@R.add("""with a as (select n_name as name, sha256(n_name) as s from nation where n_nationkey < 20), b as (select n_name as name, sha256(n_name || case when n_nationkey % 4 = 0 then 'x' else '' end) as s from nation where n_nationkey > 4)
select coalesce(a.name, b.name) as name, case when a.s is null then 'extra' when b.s is null then 'missing' else 'changed' end as problem from a full join b on a.name = b.name where a.s is distinct from b.s""")
def checksum_mismatch(d: Tables) -> DataFrame:
    a = d.nation.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("a"))
    b = d.nation.where("n_nationkey > 4").select(F.col("n_name").alias("name"), F.sha2(F.concat("n_name", F.when(F.col("n_nationkey") % 4 == 0, "x").otherwise("")), 256).alias("b"))
    j = a.join(b, "name", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return j.select("name", F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("changed").alias("problem"))


@R.add("""select o_orderkey, coalesce(c_name, s_name, 'none') as owner from orders left join (select * from customer where c_acctbal > 5000) c on c_custkey = o_custkey left join supplier on s_suppkey = o_custkey""")
def fallback_coalesce(d: Tables) -> DataFrame:
    c = d.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    s = d.supplier.select(F.col("s_suppkey").alias("o_custkey"), "s_name")
    return d.orders.join(c, "o_custkey", "left").join(s, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", "s_name", F.lit("none")).alias("owner"))


@R.add(f"select doc_id, md5({TEXT_NORM}) as norm from documents")
def text_normalize(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("norm"))


@R.add("select doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9'']+'), ' ')) as norm from documents")
def ascii_norm(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", F.md5(tx.ascii_norm(F.col("text"))).alias("norm"))


@R.add(r"""select conv_id, turn, s as sentence, count(*) as n from (select conv_id, turn, unnest(list_filter(string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')) as s from conversations) group by all""")
def sentence_split(d: Tables) -> DataFrame:
    s = d.conversations.select("conv_id", "turn", F.explode(tx.sentences(F.col("text"))).alias("sentence"))
    return s.groupBy("conv_id", "turn", "sentence").agg(F.count("*").alias("n"))


def _names(d: Tables) -> DataFrame:
    """Every two part names that share a word."""
    n = d.part.select("p_name").distinct().withColumn("w", F.explode(F.split("p_name", " ")))
    pairs = n.toDF("a", "w").join(n.toDF("b", "w"), "w").where("a < b").select("a", "b").distinct()
    return pairs


def _scored(score):
    return lambda d: _names(d).withColumn("score", score("a", "b"))


indel_ratio = R.add(name="indel_ratio")(_scored(sim.ratio_col))
partial_ratio = R.add(name="partial_ratio")(_scored(sim.partial_ratio_col))
token_set_ratio = R.add(name="token_set_ratio")(_scored(sim.token_set_ratio_col))
word_coverage = R.add(name="word_coverage")(_scored(sim.word_coverage_col))


@R.add()
def fuzzy_layer(d: Tables) -> DataFrame:
    """Pairs of turn and phrase that pass the fuzzy gate, by phrase."""
    ok = mt.fuzzy_scores(d.conversations, "text", mt.derived_phrases(d.conversations, "text")).where(mt.passes_fuzzy())
    return ok.groupBy("udk_id").agg(F.count("*").alias("n"), F.round(F.max(F.col("part") * RULES.discount), 6).alias("best"))


DERIVED = f"""with norm as (select distinct text, {TEXT_NORM} as t from conversations),
 o as (select array_to_string({WORDS.format(TEXT_NORM)}[1:3], ' ') as phrase from conversations where len({WORDS.format(TEXT_NORM)}) >= 3),
 top as (select phrase, row_number() over (order by count(*) desc, phrase) as ord from o group by 1 order by 2 limit 20)"""


#: Texts that a phrase holds, with an anchor: a content word of the phrase as a word of the text.
HITS = DERIVED + f""", held as (select text, t, phrase, ord, count(*) over (partition by text) as n from norm join top on contains(phrase, t) where t <> '' and len(list_filter({WORDS.format('t')}, lambda w: not list_contains({STOP}, w))) > 0),
 hits as (select text, t, phrase, ord, true as whole, 1.0::double as confidence from norm join top on contains(t, phrase)
  union all select text, t, phrase, ord, false, case when n > 1 then 0.65 else 1.0 end from held where t <> phrase and list_has_any(list_filter({WORDS.format('phrase')}, lambda w: not list_contains({FUNCTION}, w)), {WORDS.format('t')}))"""


@R.add(HITS + " select 'UDK_' || lpad(cast(ord as varchar), 2, '0') as udk_id, count(case when whole then 1 end) as n_texts, cast(count(case when t = phrase then 1 end) as bigint) as n_equal, count(case when not whole then 1 end) as n_fragments from hits group by 1")
def exact_layer(d: Tables) -> DataFrame:
    """Texts that hold a phrase whole, or are a fragment of it, by phrase."""
    found = mt.exact_layer(d.conversations, "text", mt.derived_phrases(d.conversations, "text"))
    whole = F.col("kind") == "inside"
    return found.groupBy("udk_id").agg(F.count_if(whole).alias("n_texts"), F.count_if(F.col("t") == F.col("p")).alias("n_equal"), F.count_if(~whole).alias("n_fragments"))


@R.add("""with p as (select distinct p_name from part), w as (select distinct unnest(string_split(p_name, ' ')) as fragment from p)
select fragment, count(*) as n_phrases from w join p on contains(p_name, fragment) where fragment <> '' group by 1""")
def fragment_ambiguity(d: Tables) -> DataFrame:
    """How many phrases hold each word of the dictionary, inside a longer word too.

    The pieces of a phrase's words are listed and met by equality, so no word is compared with every phrase.
    """
    p = d.part.select("p_name").distinct()
    w = p.select("p_name", F.explode(F.array_distinct(F.filter(F.split("p_name", " "), lambda x: x != ""))).alias("w"))
    at = w.select("p_name", "w", F.explode(F.sequence(F.lit(1), F.length("w"))).alias("i"))
    pieces = at.select("p_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("i") + 1), lambda n: F.substring("w", F.col("i"), n))).alias("fragment")).distinct()
    return pieces.join(w.select(F.col("w").alias("fragment")).distinct(), "fragment", "left_semi").groupBy("fragment").agg(F.count("*").alias("n_phrases"))


@R.add("""with c as (select conv_id, turn, text, coalesce(lag(text) over (partition by conv_id order by turn), '') as ctx from conversations),
 w as (select *, list_filter(string_split_regex(ctx, '\\s+'), lambda x: x <> '') as l from c)
select conv_id, turn, md5(case when len(l) > 0 then 'Before: ' || array_to_string(l[greatest(len(l) - 59, 1):], ' ') || ' Now: ' || text else text end) as premise from w""")
def premise_build(d: Tables) -> DataFrame:
    from pyspark.sql import Window

    ctx = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    c = d.conversations.withColumn("ctx", ctx)
    return c.select("conv_id", "turn", F.md5(tx.premise(F.col("text"), F.col("ctx"))).alias("premise"))


@R.add("""with c as (select conv_id, turn, text, coalesce(lag(text) over (partition by conv_id order by turn), '') as e, string_split(text, '. ')[2] as a from conversations)
select conv_id, turn, md5(trim(e || ' ' || case when a = text or strpos(text, a) < 2 then '' else substr(text, 1, strpos(text, a) - 1) end, ' ')) as context from c where a is not null""")
def context_before(d: Tables) -> DataFrame:
    from pyspark.sql import Window

    e = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    c = d.conversations.withColumn("e", e).withColumn("a", F.get(F.split("text", r"\. "), F.lit(1))).where("a is not null")
    return c.select("conv_id", "turn", F.md5(tx.context_before(F.col("text"), F.col("a"), F.col("e"))).alias("context"))


@R.add("select doc_id, cast(len(regexp_extract_all(lower(text), '[a-z0-9'']+')) as int) as n from documents")
def word_count(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", tx.word_count(F.col("text")).alias("n"))


@R.add("select conv_id, turn, text from conversations")
def special_token_strip(d: Tables) -> DataFrame:
    tagged = F.concat(F.lit("<|startoftranscript|><|"), "role", F.lit("|>"), "text", F.lit("<|endoftext|>"))
    return d.conversations.select("conv_id", "turn", tx.strip_special_tokens(tagged).alias("text"))


@R.add("select 'buy a ' || a || ' ' || b || ' now' as text from (select distinct split_part(p_name, ' ', 1) as a from part), (select distinct split_part(p_name, ' ', 2) as b from part)")
def template_expand(d: Tables) -> DataFrame:
    """A template with two slots, filled with every pair of their values."""
    a, b = d.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a")).distinct(), d.part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b")).distinct()
    return corpus.fill(d.spark, "buy a {a} {b} now", {"a": a, "b": b}).select("text")


@R.add()
def asr_noise_augment(d: Tables) -> DataFrame:
    """Texts varied as a recogniser varies them; no word is lost."""
    c = d.conversations.select("conv_id", "turn", F.col("text"), corpus.asr_noise(F.col("text"), 7).alias("noisy"))
    kept = F.size(tx.words(tx.normalize(F.col("noisy")))) >= F.size(tx.words(tx.normalize(F.col("text"))))
    return c.select("conv_id", "turn", kept.alias("kept"), F.md5("noisy").alias("noisy"))


_WORDS = ", ".join(f"'{w}'" for w in corpus.CONFUSIONS)


@R.add(f"""with w as (select conv_id, turn, regexp_split_to_array('Help, stay away! ' || text, '\\s+') as w from conversations)
select conv_id, turn, cast(len(list_filter(w, lambda x: regexp_replace(lower(x), '^[^a-z0-9'']+|[^a-z0-9'']+$', '', 'g') in ({_WORDS}))) as int) as n_swappable, true as others_kept from w""")
def asr_heavy_augment(d: Tables) -> DataFrame:
    """Texts in which every word with sound-alikes is swapped for one of them, and whether all other words stay."""
    text = F.concat(F.lit("Help, stay away! "), "text")
    c = d.conversations.select("conv_id", "turn", text.alias("text"), corpus.asr_heavy(text, 7).alias("heavy"))
    bare = lambda w: F.regexp_replace(F.lower(w), r"^[^a-z0-9']+|[^a-z0-9']+$", "")
    words = F.split("text", r"\s+")
    plain = F.filter(words, lambda w: ~bare(w).isin(list(corpus.CONFUSIONS)))
    kept = F.size(F.array_except(F.transform(plain, F.lower), F.split("heavy", r"\s+"))) == 0
    return c.select("conv_id", "turn", (F.size(words) - F.size(plain)).alias("n_swappable"), kept.alias("others_kept"))


@R.add("""with h as (select doc_id, md5(text) as m from documents),
 f as (select doc_id, ((((('0x' || m[1:8])::bigint % 100) * 96 + ('0x' || m[9:16])::bigint) % 100 * 96 + ('0x' || m[17:24])::bigint) % 100 * 96 + ('0x' || m[25:32])::bigint) % 100 as p from h)
select doc_id, cast(p as bigint) as p, case when p < 70 then 'train' when p < 85 then 'dev' else 'test' end as split from f""")
def md5_bucket_split(d: Tables) -> DataFrame:
    return d.documents.select("doc_id", tx.md5_percent(F.col("text")).alias("p"), tx.md5_split(F.col("text")).alias("split"))


@R.add("""select event_id, case when value / 60 > 0.5 then 'fallback' else 'primary' end as used from events""")
def tiered_fallback(d: Tables) -> DataFrame:
    """The second recogniser is used where the first one's log probability is under -0.5."""
    return d.events.select("event_id", F.when(-F.col("value") / 60 < -0.5, "fallback").otherwise("primary").alias("used"))


@R.add()
def dual_asr_disagree(d: Tables) -> DataFrame:
    """Whether the next turn, as a second transcript, shares less than half of the words."""
    c = d.conversations
    other = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other"))
    j = c.join(other, ["conv_id", "turn"])
    return j.select("conv_id", "turn", (sim.token_set_ratio_col(tx.normalize(F.col("text")), tx.normalize(F.col("other"))) < 50).alias("disagree"))


@R.add(f"""select user_id, arg_max(event_id, struct_pack(c := {CONF}, e := -event_id)) as stream, max({CONF}) as confidence from events group by 1""")
def separation_retry_argmax(d: Tables) -> DataFrame:
    """Of the separated streams of a segment, the one that matches best (ties: the first)."""
    e = d.events.withColumn("c", confidence())
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("c", -F.col("event_id"))).alias("stream"), F.max("c").alias("confidence"))
