"""WARC archives and a two-level capture index.

Writing: each task writes the records of its partition to one archive of per-record gzip members, in
the shared folder, under a name of its own attempt; the table of what was written (and so the name
that counts) is committed by Spark, so a repeated task leaves at most an unused file.

A revisit needs its payload's digest and length alone, so payloads are shuffled once for each distinct
page and equal rows meet before that shuffle; a payload that very many pages share is dealt out.

Index: captures sorted by reversed-host key are cut into compressed blocks of ``BLOCK_ROWS`` lines;
each index shard is one file of blocks, and a sparse directory keeps each block's first key and place.
A look-up finds the shards by their first keys, binary-searches a shard's directory, reads the blocks by
range, and gets each capture's file, offset and length; records are then read by range, in file order.

The work folder is reached through pyarrow's file systems (file, hdfs, s3, ...), the tables through Spark.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_split, materialise, passing, work_path

BLOCK_ROWS = 512
LEVEL = 3  # gzip
READ_GAP = 1 << 16  # records this near each other are read in one range
DATE = "2024-01-01T00:00:00Z"
NO_ID = -(2**63)  # stands for a null page_id in the order of the index


def surt(url: str | None) -> str:
    """The sort key of a URL: reversed host, then port, path and query (null: empty).

    The scheme, user, fragment and a leading ``www.`` do not count; the host is lower-cased.
    """
    if not url:
        return ""
    try:
        u = urlsplit(url if "://" in url else "//" + url)
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest_text(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, url: str, digest: str, copy: int) -> str:
    """``copy`` numbers the rows with equal page, URL and payload; a response that others revisit is number 0."""
    return f"<urn:page:{'' if page_id is None else page_id}:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {copy} {digest} {url}')}>"


def page_of(name: str) -> int | None:
    """The page_id in a record's id."""
    page = name.split(":")[2]
    return int(page) if page else None


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, copy: int, to_page: int | None, to_url: str) -> bytes:
    """One WARC record, not yet compressed.  Without a payload it is a revisit, which says the payload's length."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url, digest, copy)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(to_page, to_url, digest, 0)}", f"WARC-Refers-To-Target-URI: {to_url}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, the payload's full length, and the payload (empty for a revisit) of a record."""
    end = raw.index(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in raw[:end].decode().split("\r\n")[1:])
    block = raw[end + 4 : end + 4 + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    return fields, length, payload


def _files(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(root if "://" in root else "file:" + root if root.startswith("file:/") else "file://" + root)


def _name(kind: str) -> str:
    t = TaskContext.get()
    return f"{kind}-{t.partitionId():06d}-{t.taskAttemptId()}"


def _clean(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


CAPTURES = "key string, page_id long, file string, offset long, length long"


def write_archives(pages: DataFrame, root: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for every row; ``key, page_id, file, offset, length``, one row per record.

    Of rows with equal payloads of ``least_bytes`` at least, that with the largest page_id (ties: the
    largest URL; of equal rows any one) is the response and the others revisit it.  Null page_ids are the
    smallest; a null payload is an empty one, a null URL too.  Rows that repeat a page_id have records of
    their own.  A very long payload is one record like any other.  Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    short = rows.select("page_id", "url", F.sha1("html").alias("sha"), F.octet_length("html").cast("long").alias("size"))
    equal = materialise(spark, short.groupBy("page_id", "url", "sha", "size").agg(F.count("*").alias("n")), "page-kinds")
    alike = equal.where(F.col("size") >= least_bytes)
    last = alike.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("to"), F.count("*").alias("pages"))
    typed = join_split(alike, last, "sha", "pages", F.struct("page_id", "url")).withColumn("is_last", F.col("to").eqNullSafe(F.struct("page_id", "url")))
    typed = materialise(spark, typed, "page-records")

    again = typed.where("not is_last or n > 1").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - F.col("is_last").cast("long"))))
    revisits = again.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha", "size", "copy", F.col("to.page_id").alias("to"), F.col("to.url").alias("to_url"))
    revisits = revisits.repartition("sha", "page_id", "url", "copy")  # rows of one page, however many, go to many archives
    whole = typed.where("is_last").select("page_id", "url", "sha", "size", F.lit(1).cast("long").alias("n")).unionByName(equal.where(F.col("size") < least_bytes))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("name")
    bodies = rows.select(name, "url", F.sha1("html").alias("sha"), "html").groupBy("name", "url", "sha").agg(F.first("html").alias("html"))
    responses = whole.withColumn("name", name).join(bodies, ["name", "url", "sha"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    responses = responses.select("page_id", "url", "html", "sha", "size", "copy", F.lit(None).cast("long").alias("to"), F.lit("").alias("to_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _files(root)
        file, out, at = _name("archive") + ".warc.gz", None, 0
        for batch in batches:
            if out is None:
                fs.create_dir(path)
                out = fs.open_output_stream(f"{path}/{file}", compression=None)
            made = []
            for page_id, url, html, sha, size, copy, to, to_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                z = gzip.compress(record(page_id, _clean(url), None if html is None else html.encode(), size, digest_text(bytes.fromhex(sha)), copy, to, _clean(to_url)), LEVEL, mtime=0)
                out.write(z)
                made.append((surt(url), page_id, file, at, len(z)))
                at += len(z)
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    made = materialise(spark, responses.unionByName(revisits).mapInArrow(run, CAPTURES), "captures")
    discard(equal, typed)
    return made


def _plain(key: str) -> str:
    return key.replace("\t", "%09").replace("\n", "%0A")


ORDER = ("key", "page_id", "file", "offset")  # nulls come first


def build_index(captures: DataFrame, root: str, shards: int) -> DataFrame:
    """Write the sorted captures as compressed blocks; the sparse directory, one row per block."""
    spark = captures.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _files(root)
        name, out, at, lines, first, made = _name("index"), None, 0, [], None, []

        def flush():
            nonlocal at, lines
            z = zlib.compress("\n".join(lines).encode(), 3)
            out.write(z)
            made.append((name, first[0], first[1], at, len(z), len(lines)))
            at, lines = at + len(z), []

        for batch in batches:
            if out is None:
                fs.create_dir(path)
                out = fs.open_output_stream(f"{path}/{name}", compression=None)
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not lines:
                    first = key, NO_ID if page_id is None else page_id
                lines.append("\t".join((_plain(key), "" if page_id is None else str(page_id), file, str(offset), str(length))))
                if len(lines) == BLOCK_ROWS:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], ["shard", "key", "page_id", "offset", "length", "n"])

    # the place is part of the order, so captures of one key and page may lie in several shards
    ordered = captures.select("key", "page_id", "file", "offset", "length").repartitionByRange(shards, *ORDER).sortWithinPartitions(*ORDER)
    return materialise(spark, ordered.mapInArrow(run, "shard string, key string, page_id long, offset long, length long, n long"), "directory")


def look_up(queries: DataFrame, directory: DataFrame, root: str) -> DataFrame:
    """``page_id, file, offset, length`` of every capture of each query (key, page_id); a null page_id asks for
    those without one.  Repeated queries are asked once.

    The driver holds one row per shard (their number is a parameter of the index, not of the data);
    a task holds the sparse directory of the shard that it searches.
    """
    tops = sorted((r["m"]["key"].encode(), r["m"]["page_id"], r["shard"]) for r in directory.groupBy("shard").agg(F.min(F.struct("key", "page_id")).alias("m")).collect())
    bounds, names = [t[:2] for t in tops], [t[2] for t in tops]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spots = [_span(bounds, (k.encode(), p)) for k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            own = pa.array([i for i, (x, y) in enumerate(spots) for _ in range(x, y)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for x, y in spots for k in range(x, y)], pa.string()), *(c.take(own) for c in b.columns)], ["shard", "key", "page_id"])

    routed = queries.select("key", F.coalesce("page_id", F.lit(NO_ID)).alias("page_id")).distinct().mapInArrow(route, "shard string, key string, page_id long")
    blocks = directory.select("shard", F.lit(0).alias("kind"), "key", "page_id", "offset", "length")
    asked = routed.select("shard", F.lit(1).alias("kind"), "key", "page_id", F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("length"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's directory rows come first, then its queries by key, so one block is open at a time."""
        fs, path = _files(root)
        shard, firsts, places, source, open_at, lines = None, [], [], None, -1, {}
        for batch in batches:
            made = []
            for name, kind, key, page_id, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    shard, firsts, places, open_at = name, [], [], -1
                    source = fs.open_input_file(f"{path}/{name}")
                if kind == 0:
                    firsts.append((key.encode(), page_id))
                    places.append((offset, length))
                    continue
                wanted = _plain(key), "" if page_id == NO_ID else str(page_id)
                for at in range(*_span(firsts, (key.encode(), page_id))):
                    if at != open_at:
                        source.seek(places[at][0])
                        rows = (x.split("\t") for x in zlib.decompress(source.read(places[at][1])).decode().split("\n"))
                        open_at, lines = at, {k: [r[2:] for r in g] for k, g in groupby(rows, key=lambda r: (r[0], r[1]))}
                    made += [(None if page_id == NO_ID else page_id, file, int(begin), int(size)) for file, begin, size in lines.get(wanted, ())]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["page_id", "file", "offset", "length"])

    n = max(1, len(names))
    together = blocks.unionByName(asked).repartitionByRange(n, "shard").sortWithinPartitions("shard", "kind", "key", "page_id")
    return together.mapInArrow(find, "page_id long, file string, offset long, length long")


def _span(firsts: list[tuple[bytes, int]], wanted: tuple[bytes, int]) -> tuple[int, int]:
    """The blocks (or shards) that may hold ``wanted``: the last that begins before it, and all that begin with it."""
    return max(0, bisect.bisect_left(firsts, wanted) - 1), bisect.bisect_right(firsts, wanted)


def read_records(places: DataFrame, root: str, parts: int) -> DataFrame:
    """Read the records at (file, offset, length) by range and verify them.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok``; the digest of a
    response is computed from the payload read, that of a revisit comes from its header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _files(root)
        name, source = None, None
        for batch in batches:
            rows, made, at = list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), [], 0
            while at < len(rows):
                to, begin = at, rows[at][2]
                end = begin + rows[at][3]
                while to + 1 < len(rows) and rows[to + 1][1] == rows[at][1] and rows[to + 1][2] <= end + READ_GAP and end - begin < 4 << 20:
                    to += 1
                    end = max(end, rows[to][2] + rows[to][3])
                if rows[at][1] != name:
                    name = rows[at][1]
                    source = fs.open_input_file(f"{path}/{name}")
                source.seek(begin)
                raw = source.read(end - begin)
                for page_id, _, offset, length in rows[at : to + 1]:
                    fields, size, payload = parse(gzip.decompress(raw[offset - begin : offset - begin + length]))
                    said, to_page = fields["WARC-Payload-Digest"][5:], fields.get("WARC-Refers-To")
                    kind = fields["WARC-Type"]
                    digest = digest_text(hashlib.sha1(payload).digest()) if kind == "response" else said
                    made.append((page_id, size, digest, kind, page_of(to_page) if to_page else None, digest == said and (kind == "revisit" or size == len(payload))))
                at = to + 1
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload_ok"])

    ordered = places.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.select("page_id", "file", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean")


def archive_and_read_back(pages: DataFrame, least_bytes: int = 0, shards: int | None = None) -> DataFrame:
    """Write all pages, index them, look every page up by its URL and read its records back.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, payload_ok``, one row per row of
    ``pages``; see ``write_archives`` for nulls, ties and repeated rows.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    shards = shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    root = passing(spark, work_path(spark, "warc"))
    captures = write_archives(pages, root, least_bytes)
    directory = build_index(captures, root, shards)
    return read_records(look_up(captures.select("key", "page_id"), directory, root), root, shards)


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as html, coalesce(url, '') as url from pages),
     d as (
  select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as hex,
    row_number() over w as place, first_value(page_id) over w as last
  from p window w as (partition by sha1(html) order by page_id desc nulls last, url desc)
)
select page_id, cast(payload_bytes as bigint) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((('0x' || substr(hex, cast(1 + 5 * (i // 4) as int), 5))::bigint >> (15 - 5 * (i % 4))::bigint) & 31) as int), 1)), 'string_agg', '') as payload_digest,
  case when place = 1 then 'response' else 'revisit' end as record_type,
  case when place = 1 then null else last end as refers_to,
  true as payload_ok
from d
"""
