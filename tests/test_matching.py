import unicodedata

import pytest
from pyspark.sql import functions as F

from tarnbeck.functions import text as tx
from tarnbeck.operators import decisions as dec
from tarnbeck.operators import matching as mt
from tarnbeck.plans.store import phrases


@pytest.fixture(scope="module")
def english(spark):
    return phrases(spark).where("language = 'en'").cache()


def match(spark, english, texts):
    rows = mt.best_match(spark.createDataFrame([(t,) for t in texts], "x string"), "x", english).withColumn("tier", dec.tier(F.col("confidence"))).collect()
    return {r.text: r for r in rows}


def test_tiers(spark, english):
    want = {
        "Oh help me, please do": "TRIGGER_ALL", "call the polise right away": "TRIGGER_VERIFY", "stop it, someone is trying to hurt me": "TRIGGER_ALL",
        "the soup was cold again today": "NO_ACTION", "we should paint the fence before winter": "NO_ACTION",
    }
    got = match(spark, english, want)
    assert {k: got[k].tier for k in want} == want
    # a phrase of the dictionary that is verified by default is found like any other
    flags = {r.udk_id: r.verify_by_default for r in english.collect()}
    texts = [r.phrase + ", truly" for r in english.where("verify_by_default").collect()]
    by_default = match(spark, english, texts)
    assert texts and all(r.confidence == 1.0 and flags[r.udk_id] for r in by_default.values())


def test_fragments_fillers_and_anchors(spark, english):
    own = spark.createDataFrame([("UDK_A", "ring the doctor tonight", 1), ("UDK_B", "please save us", 2), ("UDK_C", "you must save him", 3)], "udk_id string, phrase string, ord int")
    got = match(spark, own, ["save", "doctor", "please", "Please. Please!", "Okay?", "it's", "you", ""])
    assert got["save"].layer == "exact" and got["save"].confidence == 0.65
    assert (got["doctor"].udk_id, got["doctor"].confidence) == ("UDK_A", 1.0)
    assert all(got[t].udk_id is None and got[t].layer == "none" for t in ("please", "Please. Please!", "Okay?", "you", ""))
    # short cries are parts of phrases; parts of only the commonest words are none
    phrases_ = [r.phrase for r in english.collect()]
    cries = ["Help", "police!", "scared", "Hurt me"]
    got = match(spark, english, cries + ["I am", "to me", "is it me?"])
    assert all(any(c.lower().strip("!") in p.lower() for p in phrases_) for c in cries)
    assert all(got[t].confidence >= 0.6 for t in cries)
    assert all(got[t].layer not in ("exact", "fuzzy") for t in ("I am", "to me", "is it me?"))


def test_normalize_keeps_combining_marks(spark):
    import re

    texts = ["  Help, ME!! ", "मुझे अभी मदद चाहिए।", "నన్ను తాకవద్దు", "a - b", "\tx\n\ny ", "", " lead", "£5 + 3"]

    def plain(t):
        return re.sub(r"\s+", " ", "".join(c for c in t.lower().strip() if unicodedata.category(c)[0] not in "PS"))

    got = [r.n for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tx.normalize(F.col("t")).alias("n")).collect()]
    assert got == [plain(t) for t in texts]


def test_large_dictionaries_are_met_in_blocks(spark, english):
    texts = spark.createDataFrame([("Oh help me, please do",), ("the soup was cold",), ("save",)], "x string")
    rows = lambda most: sorted((tuple(r) for r in mt.scan(texts, "x", english, 0.55, most).collect()), key=str)
    assert rows(1000) == rows(english.count() // 4) and rows(1000)


def test_anchors_shuffle_no_text_by_word(spark):
    texts = spark.createDataFrame([("Please save the doctor!",), ("the docter came",), ("nothing here",), ("Dont stay",), (None,)], "x string")
    own = spark.createDataFrame([("A", "ring the doctor tonight", 1), ("B", "please dont go", 2)], "udk_id string, phrase string, ord int")
    made = mt.anchored_phrases(texts, "x", own)
    assert sorted((r.text, r.udk_id) for r in made.collect()) == [("Dont stay", "B"), ("Please save the doctor!", "A"), ("the docter came", "A")]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert all("text" not in x for x in plan.splitlines() if "Generate explode" in x)
