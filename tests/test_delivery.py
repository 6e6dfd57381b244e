import hashlib
import hmac
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from tarnbeck.sources import delivery as dl


def options(tmp_path, **more):
    return {"endpoint": f"file://{tmp_path}/to", "key": "event_id", "letters": f"file://{tmp_path}/letters", "secret": "s", "pause": "0", **more}


def send(df, **given):
    df.write.format("delivery").mode("append").options(**given).save()


def test_retries_and_dead_letters(spark, tmp_path):
    spark.dataSource.register(dl.Delivery)
    df = spark.createDataFrame([(i, f"né {i}") for i in range(400)], "event_id long, text string").repartition(3)
    send(df, **options(tmp_path, refuse=json.dumps([[10, 3], [30, 2], [97, 1], [100, 0]])))
    got = {r.key: r for r in dl.received(spark, f"file://{tmp_path}/to").collect()}
    dead = {r.key: r for r in dl.dead_letters(spark, f"file://{tmp_path}/letters").collect()}
    assert {*got, *dead} == {str(i) for i in range(400)} and not got.keys() & dead.keys() and 0 < len(dead) < 40
    assert {r.attempts for r in got.values()} == {1, 2, 3} and all(r.attempts == 3 for r in dead.values())
    assert json.loads(got[next(iter(got))].body)["text"].startswith("né")
    # a run that posts again changes nothing for a receiver that knows keys; files without a commit do not count
    send(df, **options(tmp_path))
    assert {r.key for r in dl.received(spark, f"file://{tmp_path}/to").collect()} == {str(i) for i in range(400)}
    (tmp_path / "letters" / "letters-stray.jsonl").write_text('{"key": "x", "body": "", "attempts": 1}\n')
    assert dl.dead_letters(spark, f"file://{tmp_path}/letters").count() == len(dead)
    assert dl.dead_letters(spark, f"file://{tmp_path}/none").count() == 0 if (tmp_path / "none").mkdir() is None else False


def test_http_posts_are_signed(spark, tmp_path):
    spark.dataSource.register(dl.Delivery)
    seen, tries = [], {}

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            body, key = self.rfile.read(int(self.headers["Content-Length"])), self.headers["X-Event-Id"]
            tries[key] = tries.get(key, 0) + 1
            good = self.headers["X-Signature"] == "sha256=" + hmac.new(b"s", body, hashlib.sha256).hexdigest()
            self.send_response(200 if good and tries[key] > 1 else 503)
            self.end_headers()
            if good and tries[key] > 1:
                seen.append(json.loads(body)["event_id"])

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(i,) for i in range(5)], "event_id long")
    send(df.repartition(1), **options(tmp_path, endpoint=f"http://127.0.0.1:{server.server_port}/"))
    server.shutdown()
    assert sorted(seen) == list(range(5)) and set(tries.values()) == {2}


def test_encoders_and_refused_options(spark, tmp_path):
    spark.dataSource.register(dl.Delivery)
    assert json.loads(dl.kafka("k", {"a": 1}, "").body) == {"records": [{"key": "k", "value": {"a": 1}}]}
    df = spark.createDataFrame([(1,)], "event_id long")
    for bad in ({"endpoint": "http://elsewhere.example/"}, {"secret": ""}, {"key": ""}):
        with pytest.raises(Exception, match="https|secret|key"):
            send(df, **options(tmp_path, **bad))
