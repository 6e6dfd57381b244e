import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import audio, security
from tarnbeck.functions.vectors import dtw
from tarnbeck.operators import corpus
from tarnbeck.plans.streams import through_stream
from tarnbeck.sources import files, frames, logs
from tarnbeck.streaming import processors as p


def test_dtw_matches_the_cell_by_cell_table():
    rng = np.random.default_rng(1)
    for n, k in ((1, 1), (1, 6), (7, 3), (12, 12)):
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(n, 5)), rng.normal(size=(k, 5))))
        table = np.full((n + 1, k + 1), np.inf)
        table[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, k + 1):
                table[i, j] = 1 - a[i - 1] @ b[j - 1] + min(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1])
        assert abs(dtw(a, b) - table[n, k] / max(n, k)) < 1e-9


def test_pitch():
    assert audio.pitch_elevation(audio.tone(200, 0.5)) == 0 and audio.pitch_elevation(b"") == 0 and audio.pitch_elevation(bytes(32000)) == 0
    assert abs(audio.pitch_elevation(audio.tone(650, 0.5)) - 0.5) < 0.05


def test_sound():
    smooth, rough = audio.tone(300, 1.0), audio.tone(300, 1.0, 80)
    assert audio.roughness(rough) > audio.roughness(smooth) + 0.2
    assert audio.energy(b"") == 0 and audio.energy(smooth) > 0
    assert audio.si_sdr(smooth, smooth) > 60 and 8 < audio.si_sdr(audio.add_noise(smooth, 10), smooth) < 12
    assert len(audio.overlap(smooth, rough[:1000])) == len(smooth) and len(audio.overlap(smooth, rough[:1000], "truncate")) == 1000
    high, low = audio.tone(6000, 0.5), audio.tone(300, 0.5)
    rms = lambda x: np.sqrt(np.mean(audio.to_float(x) ** 2))
    assert rms(audio.muffle(high)) < 0.1 * rms(high) and 0.4 < rms(audio.muffle(low)) / rms(low) < 0.6
    assert len(audio.read_wav(audio.write_wav(low, 8000))) == 2 * len(low)
    stereo = np.stack([np.full(10, 100), np.full(10, 300)], 1).astype("<i2").tobytes()
    assert set(np.frombuffer(audio.read_wav(audio.write_wav(stereo, 16000, 2)), "<i2")) == {200}


def test_frames_tokens_and_fields(spark):
    df = spark.createDataFrame([(struct.pack(">Qd", 7, 1.5) + b"ab",), (struct.pack(">Qd", 2**33, -2.0),), (b"short",), (None,)], "f binary")
    got = [(r.seq, r.client_ts, None if r.pcm is None else bytes(r.pcm)) for r in frames.unpack(df, "f").collect()]
    assert got == [(7, 1.5, b"ab"), (2**33, -2.0, b""), (None, None, None), (None, None, None)]
    t = spark.range(1).select(security.sign_token(F.lit(50), F.lit("/a"), "s").alias("t"))
    ok = t.select(*[security.token_valid(F.col("t"), F.lit(path), F.lit(now), secret) for path, now, secret in (("/a", 40, "s"), ("/a", 60, "s"), ("/b", 40, "s"), ("/a", 40, "z"))]).first()
    assert list(ok) == [True, False, False, False]
    e = spark.range(1).select(security.encrypt(F.lit("x"), "0123456789abcdef", "k1").alias("e"))
    assert list(e.select(security.decrypt(F.col("e"), {"k1": "0123456789abcdef"}), security.decrypt(F.col("e"), {"k2": "0123456789abcdef"})).first()) == ["x", None]


def test_lenient_lines_logs_and_binary_files(spark, tmp_path):
    lines = ["```json", '{"text": "a", "label": 1},', '{"text": "b", "label": 2}', '{"text": "", "label": 0}', "Sure!", '{"text": "c", "label": 0, "category": "z"}', "{bad", "```"]
    got = files.lenient_jsonl(spark.createDataFrame([(x,) for x in lines], "value string"), "text string, label long, category string", "stem").collect()
    assert sorted(map(tuple, got)) == [("a", 1, "stem"), ("c", 0, "z")]
    log = "header\n" + "=" * 100 + "\nclip one\nexpected: x\n  heard [parakeet]: 'get away'\n    -> TRIGGER_ALL\n  heard: 'hi'\n    -> NO_ACTION/sentence\n" + "=" * 100 + "\nnot a clip\n"
    assert [tuple(r) for r in logs.parse_blocks(spark.createDataFrame([(log,)], "text string")).collect()] == [("clip one", "parakeet", "get away", "TRIGGER_ALL")]
    (tmp_path / "speech").mkdir()
    (tmp_path / "speech" / "a.wav").write_bytes(b"123")
    (tmp_path / "speech" / "b.txt").write_bytes(b"1")
    with zipfile.ZipFile(tmp_path / "c.zip", "w"):
        pass
    assert [(r.category, r.stem, r.length) for r in files.binary_files(spark, str(tmp_path), "*.wav").collect()] == [("speech", "a", 3)]


def test_corpus_helpers(spark):
    df = spark.createDataFrame([("help me get away from here",), ("nothing of the kind",)], "t string")
    heavy = [r[0] for r in df.select(corpus.asr_heavy(F.col("t"), 3)).collect()]
    assert heavy[0] != "help me get away from here" and heavy[1] == "nothing of the kind"
    noisy = [r[0] for r in df.select(corpus.asr_noise(F.col("t"), 5)).collect()]
    assert all(set(a.split()) <= set(b.split()) for a, b in zip(["help me get away from here", "nothing of the kind"], noisy))
    held = spark.createDataFrame([("Help me, get away from here!",)], "h string")
    assert [r.near for r in corpus.near_held_out(df, "t", held, "h", 90.0).orderBy("t").collect()] == [True, False]
    assert [r.t for r in corpus.unlike_held_out(df, "t", held, "h", 85.0).collect()] == ["nothing of the kind"]
    more = held.union(spark.createDataFrame([(f"words of line {i}",) for i in range(7)], "h string"))
    assert [r.near for r in corpus.near_held_out(df, "t", more, "h", 90.0).orderBy("t").collect()] == [True, False]
    assert [r.t for r in corpus.unlike_held_out(df, "t", more, "h", 85.0).collect()] == ["nothing of the kind"]
    lint = corpus.lint(spark.createDataFrame([("a b c d e", "x", 1), ("a b c d f", "x", 0), ("a b c d g", "y", 0)], "t string, c string, l int"), "t", "c", "l").collect()
    assert sorted((r.check, r.n) for r in lint) == [("context", 2), ("opening", 3)]


def test_frame_source_streams_every_frame_once(spark):
    frames.register(spark)
    q = spark.readStream.format("tarnbeck_frames").option("journeys", 2).option("frames", 4).load().writeStream.format("memory").queryName("frames_seen").start()
    try:
        q.processAllAvailable()
        for _ in range(30):
            if spark.table("frames_seen").count() >= 8:
                break
            q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.journey_id, r.seq) for r in spark.table("frames_seen").collect()) == [(f"j{j}", s) for j in range(2) for s in range(4)]


def test_reorder_is_the_same_however_frames_come(spark):
    rows = [("a", s, f"x{s}") for s in (2, 0, 1, 1, 4, 6)] + [("b", 1, "y"), ("b", 0, "y")]
    df = spark.createDataFrame(rows, "k string, seq long, body string")
    got = through_stream(df, lambda s: p.reorder(s, "k", "seq", "body"), files=3).collect()
    assert sorted((r.k, r.seq) for r in got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]


def test_every_query_runs_and_has_distinct_columns(spark, sf):
    from tarnbeck.plans import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150
    for name in ("phrase_match_best", "wav_decode_resample", "reference_bank_load", "rate_limit_fixed", "vad_segments"):
        df = queries()[name](spark, sf)
        assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


@pytest.mark.parametrize("part", ["flagship", "store", "rules", "ordered", "metrics", "signals"])
def test_queries_match_sql(spark, sf, part):
    """Row counts and values against DuckDB on the smallest tables."""
    import importlib
    import math

    import duckdb

    registry = importlib.import_module(f"tarnbeck.plans.{part}").R
    con = duckdb.connect()
    import os

    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")

    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    for name, sql in registry.sql.items():
        df = registry.functions[name](spark, sf)
        want = con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(want.columns), name
        a = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
        b = sorted(tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
        assert a == b, (name, [x for x in a if x not in b][:2], [x for x in b if x not in a][:2])


def test_silent_journeys_time_out(spark):
    rows = [("a", 1000, False), ("b", 1000, True), ("a", 1005, False), ("c", 1100, False), ("c", 1101, False)]
    df = spark.createDataFrame(rows, "k string, s long, hit boolean").withColumn("at", F.timestamp_seconds("s"))
    out = through_stream(df, lambda s: p.timeouts(s, "k", "at", "hit"), order=F.col("s")).collect()
    assert sorted((r.k, r.status, r.last_ms) for r in out) == [("a", "TIMED_OUT", 1005000), ("b", "TIMED_OUT_AFTER_TRIGGER", 1000000)]


def test_language_changes_after_three_checks_running(spark):
    heard = "te te en te te te te hi hi te hi hi hi".split()
    df = spark.createDataFrame([("j", i, v) for i, v in enumerate(heard)], "k string, i long, v string")
    out = through_stream(df, lambda s: p.language_streak(s, "k", "i", "v"), order=F.col("i")).collect()
    now, run, want = "en", [], []
    for v in heard:
        run = [] if v == now else (run + [v] if run and run[-1] == v else [v])
        if len(run) == 3:
            now, run = v, []
        want.append(now)
    assert [r.language for r in sorted(out, key=lambda r: r.i)] == want and want[-1] == "hi"


def test_gap_deadline_and_idempotent_sink(spark, tmp_path):
    from tarnbeck.sources.sinks import deliver_once

    out = str(tmp_path / "sink")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "id long, v string")
    assert [deliver_once(batch, out, "id"), deliver_once(batch, out, "id")] == [2, 0]
    assert spark.read.parquet(out).count() == 2


def test_roughness_is_judged_a_bounded_number_at_a_time(monkeypatch):
    import pandas as pd

    sounds = pd.Series([audio.tone(300, 0.2, am) for am in range(40, 80)] + [None, b""] + [audio.tone(200, 0.15, 60)])
    together, seen, of = audio.roughness_batch(sounds), [], audio.roughness_of
    monkeypatch.setattr(audio, "STACKED", 10_000)
    monkeypatch.setattr(audio, "roughness_of", lambda x, rate: seen.append(x.size) or of(x, rate))
    assert np.allclose(audio.roughness_batch(sounds), together, equal_nan=True) and max(seen) <= 10_000 and len(seen) > 10


def test_sdr_is_one_evaluation_of_the_sound(spark, sf):
    from tarnbeck.plans import queries

    df = queries()["si_sdr"](spark, sf)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").limit(20).collect()}
    got = {r.vec_id: r.db for r in df.where(F.col("vec_id").isin(list(e))).collect()}
    for i, x in e.items():
        pcm = audio.to_pcm(np.tile(np.asarray(x, np.float64) * 3, 50))
        assert abs(got[i] - audio.si_sdr(audio.add_noise(pcm, 10.0, "traffic"), pcm)) < 1e-4


def test_streams_call_python_by_bucket_and_not_by_key(spark, monkeypatch):
    import random

    monkeypatch.setattr(p, "BUCKETS", 3)
    r = random.Random(4)
    frames_ = [(k, s, f"{k}.{s}") for k in [None, *range(40)] for s in range(8) for _ in range(r.choice([0, 1, 1, 1, 2]))]
    r.shuffle(frames_)
    df = spark.createDataFrame(frames_, "k long, seq long, body string")
    stream = lambda f, rows, **o: through_stream(rows, f, **o)
    made = stream(lambda s: p.reorder(s, "k", "seq", "body"), df)
    want = [(k, s, f"{k}.{s}", False) for k in {k for k, *_ in frames_} for s in range(8) if all((k, x, f"{k}.{x}") in frames_ for x in range(s + 1))]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str) and len(want) > 100

    rows = [(r.choice([None, *range(12)]), float(i), i, *(r.random() < x for x in (0.5, 0.4, 0.5, 0.3))) for i in range(400)]
    waiting, out = {}, []
    for k, _, i, alert, sent, beat, up in rows:
        if beat and waiting.get(k):
            waiting[k] = {a: n + 1 for a, n in waiting[k].items()}
            if up:
                out += [(k, a, i, n) for a, n in waiting.pop(k).items()]
        if alert and sent:
            out.append((k, i, i, 1))
        elif alert:
            waiting.setdefault(k, {})[i] = 1
    df = spark.createDataFrame(rows, "k long, t double, i long, alert boolean, sent boolean, beat boolean, up boolean")
    got = stream(lambda s: p.drain(s, "k", ["t", "i"], "i"), df, order=F.col("t"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(out, key=str)
