import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnbeck.llm import language_id as li

TEXTS = {"en": ["the cat sat on the mat and the rat", "that is that, the end"], "fr": ["le chat est là, le rat aussi", "éà la fin"]}


def brute_cost(texts, text):
    """Nats under PPM with method C and exclusion, contexts of up to three bytes, by walking the counts."""
    counts = defaultdict(Counter)
    for t in texts:
        data = t.lower().encode()
        for i, b in enumerate(data):
            past = (bytes([10] * 3) + data)[i : i + 3]
            for k in range(4):
                counts[past[3 - k :]][b] += 1
    total, data = 0.0, text.lower().encode()
    for i, b in enumerate(data):
        past, seen = (bytes([10] * 3) + data)[i : i + 3], set()
        for k in (3, 2, 1, 0):
            c = {x: n for x, n in counts[past[3 - k :]].items() if x not in seen}
            if not c:
                continue
            t, d = sum(c.values()), len(c)
            if b in c:
                total += math.log((t + d) / c[b])
                break
            total += math.log((t + d) / d)
            seen |= set(c)
        else:
            total += math.log(256 - len(seen))
    return total


def test_code_lengths_match_the_walk(spark):
    rows = [(i, t, lang) for lang, ts in TEXTS.items() for i, t in enumerate(ts)]
    trees = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["the end", "là, zut!", "THE CAT", "日本", "a", "", "le rat sat"]
    nats, length = li.code_lengths(trees, pa.array(texts))
    for row, t in zip(nats, texts, strict=True):
        assert np.allclose(row, [brute_cost(TEXTS[x], t) for x in trees.languages], rtol=1e-5), t
    assert length.tolist() == [len(t.encode()) for t in texts]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = li.language_scores(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = out.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and right >= 0.95 * n


def test_edge_rows(spark):
    rows = [(1, "the cat sat", "en", "x"), (2, None, "en", "x"), (3, "", "fr", "x"), (4, "12 34 !", None, "x"), (None, "le chat", "fr", "x"), (5, "z" * 300000, None, "x"), (5, "z" * 300000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = {r.doc_id: r for r in li.language_scores(df).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (2, 3, 4))
    assert got[1].lang_pred in ("en", "fr") and 0 <= got[5].score <= 1 and got[None].held_out is False
    assert li.language_scores(df).count() == 7
    nothing = li.language_scores(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert li.language_scores(df.limit(0)).count() == 0


def test_the_most_frequent_labels_are_learnt(spark):
    rows = [(i, t, lang) for lang, ts in {**TEXTS, "xx": ["rare"]}.items() for i, t in enumerate(ts)]
    trees = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_languages=2)
    assert trees.languages == ["en", "fr"]


def test_code_lengths_match_the_walk_on_random_bytes(spark):
    rng = np.random.default_rng(3)
    make = lambda letters, n: "".join(rng.choice(list(letters), n))
    texts = {"a": [make("abcd é", 300), make("abx", 50)], "b": [make("abce", 200), "abc"], "c": ["d"]}
    rows = [(i, t, lang) for lang, ts in texts.items() for i, t in enumerate(ts)]
    trees = li.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [make("abcdexé ", n) for n in (1, 2, 3, 40, 200)]
    nats, _ = li.code_lengths(trees, pa.array(asked))
    for row, t in zip(nats, asked, strict=True):
        assert np.allclose(row, [brute_cost(texts[x], t) for x in trees.languages], rtol=1e-5), t
