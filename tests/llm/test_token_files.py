import io
import random
import zlib

import numpy as np
import pytest
import zstandard
from tokenizers import Tokenizer

from tarnbeck.llm import token_files as tf
from tarnbeck.llm.queries import op12_token_files


def texts(n=300):
    r = random.Random(4)
    parts = ["Hello", "world,", "don't", "naïve", "İzmir", "ΣΑΣ", "é", "日本語", "12", "3.5", " ", "\n", "\t", "\x1f", " ", "　", "<|endoftext|>", "<|ENDOFTEXT|>", ".", "?!", "***", "x" * 150, "Ǆ", "ß", "\x00", "\x85", "\x0b", "a.b", "we'll.", "é,", ",é"]
    return ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 30))) for _ in range(n)]


def want_ids(path, texts):
    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [tf.END_ID] for x in texts]


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 20)  # generations turn over
    e, rows = tf.Encoder(tf.VOCABULARY), texts()
    assert e.by_word
    for t, got, want in zip(rows, e.encode(rows), want_ids(tf.VOCABULARY, rows), strict=True):
        assert np.frombuffer(got, "<u4").tolist() + [1] == want, repr(t)


def test_a_file_decodes_whole_and_by_frames(monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 3)
    out = io.BytesIO()
    out.close = lambda: None
    w, docs = tf.FileWriter(out), [(None, [1]), (2, list(range(10))), (2, [7, 1]), (5, [9, 9, 1])]
    for i, ids in docs:
        w.add(i, np.array(ids, "<u4").tobytes())
    assert w.close() == (4, 7, 16, 2, 5, True)
    body = out.getvalue()
    assert b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True).readall() for _ in [0]) == b"".join(np.array(x, "<u4").tobytes() for _, x in docs)
    f = tf.FileReader(io.BytesIO(body), len(body))
    for k, (_, ids) in enumerate(docs):
        rows = f.documents(k, k + 1)
        assert np.frombuffer(b"".join(p for _, p in f.frames(rows)), "<u4").tolist() == ids
    # a broken frame is noticed by who reads it, and by nobody else
    at = int(f.documents()["offset"][2]) + 10
    broken = body[:at] + bytes([body[at] ^ 255]) + body[at + 1 :]
    g = tf.FileReader(io.BytesIO(broken), len(broken))
    assert len(list(g.frames(g.documents(3, 4)))) == 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(g.frames(g.documents(2, 3)))


def brute(path, rows):
    """Rows (doc_id, start, n_tokens, crc) in the defined order, as far as it shows in the result."""
    ids = want_ids(path, [t for _, t in rows])
    return {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True)}, sum(map(len, ids))


def test_dataframe_against_brute_force(spark, tmp_path):
    rows = [(k // 2, t) for k, t in enumerate(texts(200))] + [(None, None), (None, "a b"), (-5, ""), (-5, ""), (1000, "y " * 50_000)] + [(3000, "Copy.")] * 50
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, start int, file string").repartition(7)
    root = f"file://{tmp_path}"
    manifest = tf.write_token_files(df, root)
    got = tf.read_token_digests(manifest, root).collect()
    want, total = brute(tf.VOCABULARY, rows)
    assert len(got) == len(rows) and {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.concatenate([[0], np.cumsum([r.n_tokens for r in by_start])[:-1]]).tolist()
    assert sum(r.n_tokens for r in got) == total
    order = [-(10**9) if r.doc_id is None else r.doc_id for r in by_start]
    assert order == sorted(order)
    some = tf.read_documents(manifest, root, [None, 3, 1000, 77777]).collect()
    assert sorted((r.doc_id or -1, r.start, len(r.ids)) for r in some) == sorted((r.doc_id or -1, r.start, r.n_tokens) for r in got if r.doc_id in (None, 3, 1000))
    assert {tuple(r.ids) for r in some if r.doc_id == 3} == {tuple(x) for x in want_ids(tf.VOCABULARY, [t for i, t in rows if i == 3])}
    empty = tf.write_token_files(df.limit(0), root)
    assert tf.read_token_digests(empty, root).count() == 0 and tf.read_documents(empty, root, [1]).count() == 0


def test_query_on_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op12_token_files(spark, sf).collect()}
    at = 0
    for d, ids in zip(docs, want_ids(tf.VOCABULARY, [d.text for d in docs]), strict=True):
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
