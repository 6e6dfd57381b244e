"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LANGUAGES, VERIFY_BY_DEFAULT
from ..functions.text import safe_filename as clean_name
from ..operators import tables as t
from ..operators.decisions import audio_time as audio_time_col
from ..operators.decisions import event_id
from .base import CONF, SECONDS, Registry, Tables, confidence, millis, seconds

R = Registry()


def phrases(spark) -> DataFrame:
    """The phrase dictionary: 20 phrases in each of five languages."""
    rows = [(f"UDK_{k:02d}", p, "GENERAL", k in VERIFY_BY_DEFAULT, lang, k) for lang, all_ in LANGUAGES.items() for k, p in enumerate(all_, 1)]
    return spark.createDataFrame(rows, "udk_id string, phrase string, udk_type string, verify_by_default boolean, language string, ord int")


@R.add("select event_id, ts, event_type, value from events where user_id = 42")
def journey_point_lookup(d: Tables) -> DataFrame:
    return d.events.where(F.col("user_id") == 42).select("event_id", "ts", "event_type", "value")


@R.add(f"select event_id, user_id, {SECONDS} as t, cast(json_extract(props, '$.k') as bigint) as k, row_number() over (order by ts, event_id) as pos from events where user_id = 7")
def events_by_journey_ordered(d: Tables) -> DataFrame:
    """One journey's events in time order, payload decoded (the window is over that journey alone)."""
    from pyspark.sql import Window

    one = d.events.where(F.col("user_id") == 7)
    k = F.from_json("props", "k long")["k"]
    return one.select("event_id", "user_id", seconds().alias("t"), k.alias("k"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("pos")).orderBy("t", "event_id")


@R.add("select c_custkey, c_mktsegment from customer")
def journeys_projection(d: Tables) -> DataFrame:
    return d.customer.select("c_custkey", "c_mktsegment")


@R.add(f"select event_id, user_id as actor, event_type as action, {SECONDS} as t from events where event_type in ('signup', 'error') order by t, event_id")
def audit_trail(d: Tables) -> DataFrame:
    return d.events.where(F.col("event_type").isin("signup", "error")).select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), seconds().alias("t")).orderBy("t", "event_id")


@R.add(f"select event_id, user_id as actor, event_type as action, {SECONDS} as t from events where event_type in ('signup', 'error')")
def audit_append(d: Tables) -> DataFrame:
    """An audit table that two writers have added to, one after the other."""
    from ..sources.files import scratch
    from ..sources.sinks import append_audit

    rows, path = d.events.select("event_id", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), seconds().alias("t")), scratch(d.spark, "audit")
    for action in ("signup", "error"):
        append_audit(rows.where(F.col("action") == action), path)
    return d.spark.read.schema(rows.schema).parquet(path)


@R.add("select p_partkey, p_retailprice, p_brand, case when p_brand = 'Brand#1' then 2 else 1 end as run from part")
def partition_finish(d: Tables) -> DataFrame:
    """A table whose runs replace whole partitions: a second run has finished one of them again."""
    from ..sources.files import scratch
    from ..sources.sinks import finish_partitions

    path, rows = scratch(d.spark, "finished"), d.part.select("p_partkey", "p_retailprice", "p_brand", F.lit(1).alias("run"))
    finish_partitions(rows, path, "p_brand")
    finish_partitions(rows.where("p_brand = 'Brand#1'").withColumn("run", F.lit(2)), path, "p_brand")
    return d.spark.read.schema("p_partkey long, p_retailprice double, run int, p_brand string").parquet(path).select(*rows.columns)


@R.add("select 'page-' || page_id || '.html' as name, octet_length(encode(html)) as n_bytes, sha256(html) as sha256 from pages where html is not null")
def tar_stream(d: Tables) -> DataFrame:
    """Pages packed into tar archives and read back as a stream of members."""
    from ..sources.files import scratch
    from ..sources.tars import read_tars, write_tars

    root = scratch(d.spark, "tars")
    members = d.pages.where("html is not null").select(F.format_string("page-%d.html", "page_id").alias("name"), F.encode("html", "utf-8").alias("content"))
    write_tars(members, root).write.parquet(root + "-list")
    found = read_tars(d.spark.read.schema("path string").parquet(root + "-list"), root, ".html")
    return found.select("name", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@R.add("select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def csv_scan(d: Tables) -> DataFrame:
    """Rows written as CSV with a header and read back under a schema."""
    from ..sources.files import through_files

    return through_files(d.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "csv", header=True)


@R.add("""
select item_id, text, label, category from (
  select item_id, text, item_id % 3 as label, case when item_id % 2 = 0 then 'benchmark' else 'p' || (item_id % 5) end as category from benchmark)
where label in (0, 1) and text <> ''""")
def jsonl_lenient_parse(d: Tables) -> DataFrame:
    """JSON lines as a model writes them: fences, prose and trailing commas around the objects."""
    from ..sources.files import lenient_jsonl

    item = F.struct("item_id", "text", (F.col("item_id") % 3).alias("label"), F.when(F.col("item_id") % 2 != 0, F.concat(F.lit("p"), (F.col("item_id") % 5).cast("string"))).alias("category"))
    obj = F.to_json(item)
    line = F.array(F.lit("```json"), F.concat(F.lit("  "), obj, F.lit(",")), F.lit("Sure, here they are"), F.lit("{broken"), F.lit("```"))
    return lenient_jsonl(d.benchmark.select(F.explode(line).alias("value")), "item_id long, text string, label long, category string", "benchmark")


@R.add("select r_name as manifest, n_name as name, sha256(n_name) as sha256 from nation join region on n_regionkey = r_regionkey")
def json_manifest_explode(d: Tables) -> DataFrame:
    """Nested manifests: one JSON document per region, one row per clip listed in it."""
    clip = F.struct(F.col("n_name").alias("name"), F.sha2("n_name", 256).alias("sha256"))
    made = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.to_json(F.struct(F.sort_array(F.collect_list(clip)).alias("clips"))).alias("doc"))
    read = F.from_json("doc", "clips array<struct<name string, sha256 string>>")
    return made.select(F.col("r_name").alias("manifest"), F.explode(read["clips"]).alias("c")).select("manifest", "c.name", "c.sha256")


@R.add("""
select 'clip-' || o_orderkey as clip, case when o_custkey % 2 = 0 then 'whisper' else 'parakeet' end as path, o_orderpriority as heard,
  case when o_orderstatus = 'F' then 'TRIGGER_ALL' when o_orderstatus = 'O' then 'TRIGGER_VERIFY' else 'NO_ACTION' end as decision from orders""")
def log_block_parse(d: Tables) -> DataFrame:
    """Blocks of a run log, cut at the rule line and read with patterns (no evaluation of what they hold)."""
    from ..sources.logs import parse_blocks

    tier = F.when(F.col("o_orderstatus") == "F", "TRIGGER_ALL").when(F.col("o_orderstatus") == "O", "TRIGGER_VERIFY").otherwise("NO_ACTION")
    stt = F.when(F.col("o_custkey") % 2 == 0, "").otherwise(" [parakeet]")
    block = F.concat(F.lit("clip-"), F.col("o_orderkey"), F.lit("\nexpected: danger\n  heard"), stt, F.lit(": '"), F.col("o_orderpriority"), F.lit("'\n    -> "), tier, F.lit("\n"), F.lit("=" * 100), F.lit("\nnoise between blocks\n"))
    return parse_blocks(d.orders.select(block.alias("text")))


@R.add("select page_id, cast(octet_length(encode(html)) as bigint) as length, sha256(html) as digest from pages")
def binary_file_scan(d: Tables) -> DataFrame:
    """Pages stored as files by extension and scanned as binary, keyed by their names."""
    from ..sources.files import pages_as_binary

    return pages_as_binary(d.pages)


@R.add("select udk_id, phrase, language, verify from (values " + ", ".join(f"('UDK_{k:02d}', '{p.replace(chr(39), chr(39) * 2)}', '{lang}', {str(k in VERIFY_BY_DEFAULT).lower()})" for lang, all_ in LANGUAGES.items() for k, p in enumerate(all_, 1)) + ") v(udk_id, phrase, language, verify)")
def phrase_dictionary(d: Tables) -> DataFrame:
    return phrases(d.spark).select("udk_id", "phrase", "language", F.col("verify_by_default").alias("verify"))


@R.add("""select l_orderkey as journey, cast(count(*) as bigint) as n_chunks, min(l_linenumber) as first_seq, max(l_linenumber) as last_seq,
  cast(count(distinct l_linenumber) as bigint) as n_seqs from lineitem group by 1""")
def segment_scan(d: Tables) -> DataFrame:
    """The manifest of each journey's stored chunks."""
    return d.lineitem.groupBy(F.col("l_orderkey").alias("journey")).agg(F.count("*").alias("n_chunks"), F.min("l_linenumber").alias("first_seq"), F.max("l_linenumber").alias("last_seq"), F.countDistinct("l_linenumber").alias("n_seqs"))


@R.add(f"""
select user_id, arg_min(event_type, struct_pack(t := ts, e := event_id)) as first_status, min(ts) as started_at,
  arg_max(event_type, struct_pack(t := ts, e := event_id)) as status, arg_max(value, struct_pack(t := ts, e := event_id)) as last_value from events group by 1""")
def journey_upsert_latest(d: Tables) -> DataFrame:
    """The fixed columns of the first change and the changing ones of the last."""
    e = d.events.withColumn("first_status", F.col("event_type")).withColumn("started_at", F.col("ts")).withColumn("status", F.col("event_type")).withColumn("last_value", F.col("value"))
    return t.upsert_latest(e, "user_id", ["ts", "event_id"], ["first_status", "started_at"], ["status", "last_value"])


@R.add("""select l_orderkey || ':' || l_linenumber as key, l_partkey, l_suppkey, l_quantity from lineitem
  qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""")
def event_dedup_first_wins(d: Tables) -> DataFrame:
    li = d.lineitem.withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber")).select("key", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return t.first_wins(li, "key", ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]).select("key", "l_partkey", "l_suppkey", "l_quantity")


@R.add("select o_orderkey, o_custkey, o_totalprice from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def delete_cascade_anti(d: Tables) -> DataFrame:
    gone = d.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.without_keys(d.orders.select("o_orderkey", "o_custkey", "o_totalprice"), gone, "o_custkey")


CHUNK = "l_partkey::varchar || '|' || l_suppkey || '|' || l_returnflag"
WRITES = f"select l_orderkey as journey, l_linenumber as seq, sha256({CHUNK}) as s, l_shipdate, l_partkey, l_suppkey, l_returnflag from lineitem"


def _writes(d: Tables) -> DataFrame:
    li = d.lineitem.withColumnsRenamed({"l_orderkey": "journey", "l_linenumber": "seq"})
    return t.chunk_writes(li, ["journey", "seq"], F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag"), ["l_shipdate", "l_partkey", "l_suppkey", "l_returnflag"])


@R.add(f"select journey, seq, first(s order by l_shipdate, l_partkey, l_suppkey, l_returnflag) as checksum, count(*) as n_writes, min(s) <> max(s) as conflict from ({WRITES}) group by 1, 2")
def chunk_write_idempotent(d: Tables) -> DataFrame:
    return _writes(d)


@R.add(f"select journey, seq, count(*) as n_writes from ({WRITES}) group by 1, 2 having count(distinct s) > 1")
def chunk_conflicts(d: Tables) -> DataFrame:
    return _writes(d).where("conflict").select("journey", "seq", "n_writes")


@R.add("select sha256(content) as checksum, count(*) as n from (select p_name || '|' || p_brand as content from part) group by 1")
def chunk_checksum(d: Tables) -> DataFrame:
    return d.part.groupBy(F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("checksum")).agg(F.count("*").alias("n"))


@R.add("select o_orderkey, o_orderdate from orders o where not exists (select 1 from lineitem where l_orderkey = o_orderkey) order by o_orderkey")
def outbox_pending_anti(d: Tables) -> DataFrame:
    """What is queued and not yet delivered, in name order."""
    done = d.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return d.orders.select("o_orderkey", "o_orderdate").join(done, "o_orderkey", "left_anti").orderBy("o_orderkey")


@R.add("select cast(event_id as varchar) as key, user_id, event_type, round(value, 3) as value from events")
def kafka_payload_projection(d: Tables) -> DataFrame:
    """Key and JSON value as they would be sent; the value is read back here so that it can be compared."""
    from ..sources.sinks import kafka_payload

    sent = kafka_payload(d.events.select("event_id", "user_id", "event_type", F.round("value", 3).alias("value")), "event_id")
    v = F.from_json(F.col("value").cast("string"), "user_id long, event_type string, value double")
    return sent.select(F.col("key").cast("string"), v["user_id"].alias("user_id"), v["event_type"].alias("event_type"), v["value"].alias("value"))


def _hmac_sql(key: str, message: str) -> str:
    """HMAC-SHA256 in DuckDB: the padded key before the message, and again before the first digest."""
    inner, outer = (bytes(b ^ pad for b in key.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


BODY = """'{"event_id":' || event_id || ',"event_type":' || to_json(event_type) || ',"value":' || cast(value as varchar) || '}'"""


@R.add(f"select event_id, 'sha256=' || {_hmac_sql('secret', BODY)} as signature from events")
def webhook_signature(d: Tables) -> DataFrame:
    from ..functions.security import hmac_hex

    body = F.to_json(F.struct("event_id", "event_type", "value"))
    return d.events.select("event_id", F.concat(F.lit("sha256="), hmac_hex("secret")(F.encode(body, "utf-8"))).alias("signature"))


@R.add("select c_custkey as id, c_name as name, null::double as price, 'customer' as kind from customer union all select p_partkey, p_name, p_retailprice, 'part' from part")
def report_sink(d: Tables) -> DataFrame:
    """Reports with different columns, under the union of their headers, written and read back."""
    from ..sources.files import through_files

    a = d.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"))
    b = d.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.lit("part").alias("kind"))
    return through_files(a.unionByName(b, allowMissingColumns=True).select("id", "name", "price", "kind"), "csv", header=True)


@R.add("select l_orderkey, l_linenumber from lineitem where (l_orderkey, l_linenumber) not in (select l_orderkey, l_linenumber from lineitem where l_returnflag = 'A') group by all")
def resume_todo_anti(d: Tables) -> DataFrame:
    """Chunks that no finished run has."""
    keys = ["l_orderkey", "l_linenumber"]
    done = d.lineitem.where("l_returnflag = 'A'").select(*keys)
    return d.lineitem.select(*keys).distinct().join(done, keys, "left_anti")


@R.add(r"select page_id, regexp_replace(url, '[^A-Za-z0-9_.\-/ ()]', '_', 'g') as name from pages")
def safe_filename(d: Tables) -> DataFrame:
    return d.pages.select("page_id", clean_name(F.col("url")).alias("name"))


EVENT = "substr(sha256(user_id || ':' || cast(epoch_us(ts) // 1000 as varchar) || ':' || coalesce(event_type, 'none')), 1, 16)"


@R.add(f"select event_id, {EVENT} as id from events")
def event_id_hash(d: Tables) -> DataFrame:
    return d.events.select("event_id", event_id(F.col("user_id"), millis(), F.col("event_type")).alias("id"))


@R.add(f"select event_id, 1000.5 + event_id / 1000.0::double as t, {SECONDS} - 1704067200.0::double as since from events")
def audio_time(d: Tables) -> DataFrame:
    return d.events.select("event_id", audio_time_col(F.lit(1000.5), F.col("event_id")).alias("t"), (seconds() - 1704067200.0).alias("since"))


@R.add(f"""select {EVENT} as event_id, user_id as journey_id, case when {CONF} >= 0.85 then 'TRIGGER_ALL' else 'TRIGGER_VERIFY' end as decision, event_type as udk_id,
  'GENERAL' as udk_type, 'exact' as layer, round({CONF}, 3) as confidence, {SECONDS} as timestamp, null::varchar as location, 'v1' as processing_version, 'vad-1' as vad, 'stt-1' as stt
  from events where {CONF} >= 0.6""")
def event_projection(d: Tables) -> DataFrame:
    """Alerts in the shape that is sent (the versions stay nested until the end)."""
    e = d.events.withColumn("c", confidence()).where("c >= 0.6")
    out = e.select(
        event_id(F.col("user_id"), millis(), F.col("event_type")).alias("event_id"), F.col("user_id").alias("journey_id"),
        F.when(F.col("c") >= 0.85, "TRIGGER_ALL").otherwise("TRIGGER_VERIFY").alias("decision"), F.col("event_type").alias("udk_id"), F.lit("GENERAL").alias("udk_type"),
        F.lit("exact").alias("layer"), F.round("c", 3).alias("confidence"), seconds().alias("timestamp"), F.lit(None).cast("string").alias("location"), F.lit("v1").alias("processing_version"),
        F.struct(F.lit("vad-1").alias("vad"), F.lit("stt-1").alias("stt")).alias("model_version"),
    )
    return out.select(*[c for c in out.columns if c != "model_version"], "model_version.vad", "model_version.stt")


@R.add("select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) * 2 as k2 from events")
def json_payload_extract(d: Tables) -> DataFrame:
    e = d.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.from_json("props", "k long")["k"].alias("j"))
    return e.select("event_id", "k", (F.col("k") + F.col("j")).alias("k2"))


@R.add("select event_id, user_id, event_type from events where length(event_type) > 4")
def nested_struct(d: Tables) -> DataFrame:
    s = d.events.select(F.struct("event_id", F.struct("user_id", "event_type").alias("who")).alias("e"))
    return s.where(F.length("e.who.event_type") > 4).select("e.event_id", "e.who.user_id", "e.who.event_type")


@R.add("""select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as counts from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def map_counter(d: Tables) -> DataFrame:
    """Counters by name as a map per journey, printed in key order."""
    n = d.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.array_join(F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.col("m")[k].cast("string"))), ",").alias("counts"))


@R.add("""select n_regionkey, string_agg(n_nationkey || ':' || cs, ';' order by n_nationkey) as names from (
  select n_regionkey, n_nationkey, string_agg(s_name, ',' order by s_name) as cs from nation join supplier on s_nationkey = n_nationkey group by 1, 2) group by 1""")
def group_map_list(d: Tables) -> DataFrame:
    """Lists by key gathered to a map per group."""
    lists = d.nation.join(d.supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.sort_array(F.collect_list("s_name")).alias("l"))
    m = lists.groupBy("n_regionkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_nationkey", "l")))).alias("m"))
    return m.select("n_regionkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.array_join(e["value"], ","))), ";").alias("names"))
