import random

from pyspark.sql import functions as F

from tarnbeck.functions import similarity as sim
from tarnbeck.operators import matching as mt
from tarnbeck.operators.dictionary import Dictionary, SuffixAutomaton


def test_suffix_automaton_knows_every_substring():
    r = random.Random(2)
    phrases = ["".join(r.choice("ab ") for _ in range(r.randint(1, 9))) for _ in range(40)]
    known = SuffixAutomaton(phrases)
    for _ in range(600):
        t = "".join(r.choice("ab c") for _ in range(r.randint(0, 5)))
        assert sorted(known.holding(t)) == [k for k, p in enumerate(phrases) if t and t in p], t


def test_hits_and_loose_equal_all_pairs():
    r = random.Random(6)
    words = ["help", "me", "now", "the", "police", "polise", "dont", "hurt", "please", "go", "away"]
    say = lambda n: " ".join(r.choice(words) for _ in range(r.randint(1, n)))
    phrases = [say(5) for _ in range(60)]
    d = Dictionary(phrases)
    for _ in range(150):
        t = say(12)
        inside = {k for k, p in enumerate(phrases) if p in t}
        assert d.inside(t) == inside and sorted(d.holding(t)) == [k for k, p in enumerate(phrases) if t in p]
        got = {(k, w) for k, w, *_ in d.loose(t, inside, 0.55)}
        assert got == {(k, w) for k, p in enumerate(phrases) if k not in inside and (w := sim.token_set_ratio(p, t) / 100) >= 0.55}
    assert Dictionary([]).inside("x") == set() and Dictionary([]).holding("x") == []


def test_blocks_of_the_dictionary_give_the_same_hits(spark):
    p = [("U1", "ring the doctor", 1), ("U2", "ring the bell", 2), ("U3", "the bell tower", 3), ("U4", "?!", 4), ("U5", "ring the doctor", 5)]
    phrases = spark.createDataFrame(p, "udk_id string, phrase string, ord int")
    texts = spark.createDataFrame([("Ring the doctor, now!",), ("ring the",), ("the bell",), ("bell",), (None,), ("",), ("please",), ("bell",)], "x string")
    rows = lambda most: sorted((tuple(r) for r in mt.exact_layer(texts, "x", phrases, most).collect()), key=str)
    whole = rows(100)
    assert whole == rows(2) and {(r[0], r[2]) for r in whole} == {("Ring the doctor, now!", "U1"), ("Ring the doctor, now!", "U5"), ("the bell", "U2"), ("the bell", "U3"), ("bell", "U2"), ("bell", "U3"), ("ring the", "U1"), ("ring the", "U2"), ("ring the", "U5")}
    got = {(r.text, r.udk_id) for r in mt.anchored_phrases(texts, "x", phrases).collect()}
    every = [(r.x, u, sim.has_anchor(ph, t)) for r in texts.where("x <> ''").distinct().collect() for u, ph, _ in p[:3] + p[4:] for t in [r.x.lower().replace(",", "").replace("!", "")]]
    assert got == {(x, u) for x, u, yes in every if yes and x != "please"}


def test_no_table_of_texts_and_phrases(spark):
    phrases = spark.createDataFrame([(f"U{k}", f"phrase number {k}", k) for k in range(50)], "udk_id string, phrase string, ord int")
    texts = spark.range(100).select(F.concat(F.lit("text "), "id").alias("x"))
    plan = mt.exact_layer(texts, "x", phrases)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan
