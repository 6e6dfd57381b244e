import hashlib
import random
from array import array

from tarnbeck.llm.pieces import MODEL, Segmenter, decode, encode, load


def brute(seg, s, n):
    into = seg.lattice(s)
    found = []

    def walk(at, score, ids):
        if at == 0:
            found.append((score, ids))
        for i, x, own in into[at]:
            walk(i, score + x, own + ids)

    walk(len(s), 0.0, ())
    return sorted(found, key=lambda x: -x[0])[:n]


def test_nbest_matches_enumeration():
    r = random.Random(3)
    seg = Segmenter(load(MODEL), 5)
    words = ["the", "lait", "éa", "12", ",", ".", "\n", "日本", "x", " ", "  ", "!", "▁", "ré", "²", "²."]
    for _ in range(150):
        text = "".join(r.choice(words) for _ in range(r.randint(1, 4)))
        want = brute(seg, " " + text, 5)
        got = seg.nbest(text)
        assert [round(a) for a, _ in got] == [round(a) for a, _ in want], text
        assert all(seg.decode(ids) == text for _, ids in got), text
        assert len({tuple(i) for _, i in got}) == len(got)


def test_dataframe_round_trip_and_edge_rows(spark):
    texts = [None, "", " ", "a", "a", "naïve ▁ x\r\n\t" * 50, "y" * 30000, "😀 \x00 z"]
    df = spark.createDataFrame([(i, t, i, "n") for i, t in enumerate(texts)], "doc_id long, text string, score int, ids string")
    out = decode(encode(df, n=3, with_nbest=True)).orderBy("doc_id").collect()
    assert [r.decoded for r in out] == texts
    assert [r.round_trip for r in out] == [None] + [True] * 7
    assert out[1].n_pieces == 0 and out[3].ids == out[4].ids
    seg = Segmenter(load(MODEL), 3)
    for r, text in list(zip(out, texts, strict=True))[1:]:
        assert r.nbest_ids == [ids for _, ids in seg.nbest(text)] and r.nbest_ids[0] == r.ids
        assert [hashlib.sha1(array("i", ids).tobytes()).hexdigest() for ids in r.nbest_ids] == r.nbest_sha1
        assert all(seg.decode(ids) == text for ids in r.nbest_ids) and len(r.losses) == len(r.nbest_ids) - 1
    assert encode(df.limit(0)).count() == 0


def test_viterbi_and_loss_match_the_search():
    r = random.Random(9)
    seg = Segmenter(load(MODEL), 3)
    for _ in range(300):
        s = "".join(r.choice("  etaéx,日\nb") for _ in range(r.randint(1, 9)))
        found = seg.segment_nbest(s, 2)
        ids, score, loss = seg.best_and_loss(s)
        assert score == found[0][0]
        assert loss == (found[0][0] - found[1][0] if len(found) > 1 else float("inf")), s
