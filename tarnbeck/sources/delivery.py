"""Delivery of events to an endpoint outside Spark, as a data source for streams and batches.

Each task posts the rows of its partition one by one, tries a refused post again after a pause that doubles, and keeps
what is refused to the end in a file of dead letters.  Its commit message says which files are its own; the driver's
commit of a batch writes their names to one small file, so those of failed or repeated tasks do not count.  A batch that runs
again posts again under the same keys: delivery is at least once, and a receiver that knows keys has each event once.

An endpoint is a URL (``https``, or ``http`` on this machine: a signed JSON body) or a folder (a receiver's log, for
tests and replays).  What is posted comes from an encoder: ``webhook`` or ``kafka``.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.error import URLError
from urllib.parse import urlparse
from urllib.request import Request, urlopen

import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")
MOST_PAUSE_S = 30.0
DEAD_SCHEMA = "key string, body string, attempts int"


@dataclass(frozen=True)
class Post:
    key: str
    body: bytes
    headers: dict[str, str]


def webhook(key: str, event: dict, secret: str) -> Post:
    """A JSON body with its id and its signature (HMAC-SHA256 of the raw body)."""
    body = json.dumps(event, separators=(",", ":"), ensure_ascii=False, default=str).encode()
    return Post(key, body, {"Content-Type": "application/json", "X-Event-Id": key, "X-Signature": "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()})


def kafka(key: str, event: dict, secret: str) -> Post:
    """Key and value as a broker's REST proxy takes them."""
    record = {"records": [{"key": key, "value": event}]}
    return Post(key, json.dumps(record, separators=(",", ":"), ensure_ascii=False, default=str).encode(), {"Content-Type": "application/vnd.kafka.json.v2+json"})


ENCODERS = {"webhook": webhook, "kafka": kafka}


class HttpEndpoint:
    """Accepts where the answer is 2xx; anything else, no answer too, is a refusal."""

    def __init__(self, url: str, timeout: float):
        self.url, self.timeout = url, timeout

    def accepts(self, post: Post, attempt: int) -> bool:
        try:
            with urlopen(Request(self.url, data=post.body, method="POST", headers=post.headers), timeout=self.timeout) as answer:
                return 200 <= answer.status < 300
        except (URLError, OSError):
            return False

    def close(self) -> None:
        pass


class FolderEndpoint:
    """A receiver that logs what it accepts, one file a connection, and refuses a stated share.

    ``refuse`` lists ``(below, tries)`` pairs: a post whose CRC-32 of the key, modulo 100, is below a bound is accepted
    at that try; zero tries means never.  The first pair that fits counts.
    """

    def __init__(self, path: str, refuse: list[tuple[int, int]]):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        self.refuse, self.log = refuse, fs.open_output_stream(f"{folder}/{uuid.uuid4().hex}.jsonl")

    def accepts(self, post: Post, attempt: int) -> bool:
        lot = zlib.crc32(post.key.encode()) % 100
        tries = next((t for below, t in self.refuse if lot < below), 1)
        if tries == 0 or attempt < tries:
            return False
        self.log.write(json.dumps({"key": post.key, "body": post.body.decode(), "attempts": attempt}).encode() + b"\n")
        return True

    def close(self) -> None:
        self.log.close()


def endpoint(options: dict[str, str]):
    to = options["endpoint"]
    kind = urlparse(to)
    if kind.scheme in ("http", "https"):
        if kind.scheme != "https" and kind.hostname not in LOCAL_HOSTS:
            raise ValueError("events carry transcripts: the endpoint must be https")
        return HttpEndpoint(to, float(options.get("timeout", "5")))
    return FolderEndpoint(to, json.loads(options.get("refuse", "[]")))


@dataclass
class Sent(WriterCommitMessage):
    delivered: int = 0
    dead: int = 0
    files: list[str] = field(default_factory=list)


def deliver(rows: Iterator[Row], options: dict[str, str]) -> Sent:
    """Post every row; what is refused to the end goes to a file of dead letters of this attempt."""
    encode, key = ENCODERS[options.get("encoder", "webhook")], options["key"]
    attempts, pause = int(options.get("attempts", "3")), float(options.get("pause", "0.1"))
    to, sent, letters = endpoint(options), Sent(), None
    fs, folder = pyarrow.fs.FileSystem.from_uri(options["letters"])
    for row in rows:
        event = row.asDict(recursive=True)
        post = encode(str(event[key]), event, options.get("secret", ""))
        for attempt in range(1, attempts + 1):
            if to.accepts(post, attempt):
                sent.delivered += 1
                break
            if attempt < attempts:
                time.sleep(min(MOST_PAUSE_S, pause * 2 ** (attempt - 1)))
        else:
            if letters is None:
                fs.create_dir(folder, recursive=True)
                sent.files.append(f"letters-{uuid.uuid4().hex}.jsonl")
                letters = fs.open_output_stream(f"{folder}/{sent.files[-1]}")
            letters.write(json.dumps({"key": post.key, "body": json.dumps(event, default=str), "attempts": attempts}).encode() + b"\n")
            sent.dead += 1
    if letters is not None:
        letters.close()
    to.close()
    return sent


def _commit(options: dict[str, str], messages: list[Sent | None], name: str) -> None:
    fs, folder = pyarrow.fs.FileSystem.from_uri(options["letters"])
    fs.create_dir(folder, recursive=True)
    got = [m for m in messages if m is not None]
    body = {"delivered": sum(m.delivered for m in got), "dead": sum(m.dead for m in got), "files": [f for m in got for f in m.files]}
    with fs.open_output_stream(f"{folder}/{name}.commit") as out:
        out.write(json.dumps(body).encode())


class StreamDelivery(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[Row]) -> Sent:
        return deliver(iterator, self.options)

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        _commit(self.options, messages, f"batch-{batchId:012d}")  # a batch that runs again takes its old commit's place

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        pass  # files that no commit names do not count


class BatchDelivery(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def write(self, iterator: Iterator[Row]) -> Sent:
        return deliver(iterator, self.options)

    def commit(self, messages: list[Sent | None]) -> None:
        _commit(self.options, messages, f"run-{uuid.uuid4().hex}")


class Delivery(DataSource):
    """``format("delivery")`` with ``endpoint``, ``key`` (a column) and ``letters`` (the folder of dead letters).

    More options: ``encoder`` (webhook, kafka), ``secret``, ``attempts`` (3), ``pause`` (seconds before the second try, 0.1),
    ``timeout`` (5 s), ``refuse`` (of a folder endpoint).
    """

    @classmethod
    def name(cls) -> str:
        return "delivery"

    def _checked(self) -> dict[str, str]:
        options = dict(self.options)
        missing = [k for k in ("endpoint", "key", "letters") if not options.get(k)]
        if missing or (options.get("encoder", "webhook") == "webhook" and not options.get("secret")):
            raise ValueError(f"delivery needs {', '.join(missing) or 'a secret, so that the receiver can verify what it gets'}")
        scheme = urlparse(options["endpoint"])
        if scheme.scheme == "http" and scheme.hostname not in LOCAL_HOSTS:
            raise ValueError("events carry transcripts: the endpoint must be https")
        return options

    def streamWriter(self, schema, overwrite: bool) -> StreamDelivery:
        return StreamDelivery(self._checked())

    def writer(self, schema, overwrite: bool) -> BatchDelivery:
        return BatchDelivery(self._checked())


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """``key, body, attempts`` of the letters in committed files."""
    commits = spark.read.schema("files array<string>").option("pathGlobFilter", "*.commit").json(path)
    names = [r["f"] for r in commits.selectExpr("explode(files) as f").distinct().collect()]  # a name a task with refusals
    if not names:
        return spark.createDataFrame([], DEAD_SCHEMA)
    return spark.read.schema(DEAD_SCHEMA).json([f"{path}/{n}" for n in names])


def received(spark: SparkSession, path: str) -> DataFrame:
    """``key, body, attempts``: what a folder endpoint has accepted, once for each key."""
    from pyspark.sql import functions as F

    posts = spark.read.schema("key string, body string, attempts int").json(path)
    return posts.groupBy("key").agg(F.min("body").alias("body"), F.min("attempts").alias("attempts"), F.count("*").alias("posts"))
