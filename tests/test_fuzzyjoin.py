import random

import pytest

from tarnbeck.functions import similarity as sim
from tarnbeck.operators import fuzzyjoin as fj
from tarnbeck.operators import joins

WORDS = ["hello", "world", "hullo", "wrld", "a", "ab", "cat", "cats", "the", "then", "green", "greens", "x", "lavender", "salmon", "salmons", "é"]


def some(seed, n):
    r = random.Random(seed)
    out = set()
    for _ in range(n):
        t = " ".join(r.choice(WORDS) for _ in range(r.randint(1, 7)))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            i = r.randrange(len(t))
            t = t[:i] + r.choice(["", "-", "z", "q", " "]) + t[i + 1 :]
        out.add(t)
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    a, b = sorted({*some(1, 60), "hello wrld", "a", "é", "zz", ""}), sorted({*some(2, 60), "hello-world", "a", "x", " "})
    b = sorted({*b, *a[:15]})
    return a, b, *(spark.createDataFrame([(x,) for x in [*s, None, *s[:5]]], "x string") for s in (a, b))


@pytest.mark.parametrize("join,score,least", [(fj.alike_ratio, sim.ratio, 70.0), (fj.alike_ratio, sim.ratio, 85.0), (fj.alike_words, sim.token_set_ratio, 75.0), (fj.alike_words, sim.token_set_ratio, 90.0)])
def test_no_pair_is_lost(sides, join, score, least, monkeypatch):
    monkeypatch.setattr(fj, "HOT_PAIRS", 50)
    a, b, left, right = sides
    got = [(r.a, r.b) for r in join(left, right, least).collect()]
    want = {(x, y) for x in a for y in b if x.split() and y.split() and score(x, y) >= least}
    assert set(got) == want and len(got) == len(want) and len(want) > 20


@pytest.mark.parametrize("least", [75.0, 90.0])
def test_best_weighted_equals_all_pairs(sides, least):
    a, b, left, right = sides
    got = {r.a: (r.score, r.b) for r in fj.best_weighted(left, right, least).collect()}
    best = {x: max((sim.weighted_ratio(x, y), y) for y in b if y.split()) for x in a if x.split()}
    assert got == {x: m for x, m in best.items() if m[0] >= least} and got["hello wrld"][0] > 80


def test_low_bounds_are_refused(sides):
    with pytest.raises(ValueError):
        fj.alike_ratio(sides[2], sides[3], 60.0)


def test_interval_lookup_keeps_repeated_rows(spark):
    points = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 5.0), (1, 99.0), (2, None), (None, 1.0)], "k int, at double")
    spans = spark.createDataFrame([(1, 0.0, 10.0, "a"), (1, 5.0, 6.0, "b")], "k int, s double, e double, who string")
    got = joins.interval_lookup(points, spans, ["k"], "at", "s", "e", "who", 4.0).collect()
    assert sorted(((r.k, r.at, tuple(r.within)) for r in got), key=str) == sorted([(1, 5.0, ("a", "b"))] * 3 + [(1, 99.0, ()), (2, None, ()), (None, 1.0, ())], key=str)


@pytest.mark.parametrize("join,score,least", [(fj.alike_ratio, sim.ratio, 70.0), (fj.alike_words, sim.token_set_ratio, 75.0), (fj.alike_words, sim.token_set_ratio, 90.0)])
@pytest.mark.parametrize("few,block", [(0, 2048), (16_384, 2048), (16_384, 2500)])
def test_a_dictionary_of_few_texts_is_met_in_the_tasks(sides, join, score, least, few, block, monkeypatch):
    """Alike on both ways, in one block or several; that with few texts has no exchange of pairs."""
    monkeypatch.setattr(fj, "FEW", few)
    if block == 2500:
        monkeypatch.setattr(fj, "BLOCK_TEXTS", 25)
    a, b, left, right = sides
    made = join(left, right, least)
    assert sorted((r.a, r.b) for r in made.collect()) == sorted((x, y) for x in a for y in b if x.split() and y.split() and score(x, y) >= least)
    assert few == 0 or "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_a_block_rules_out_what_cannot_be_alike():
    block = fj.Block(["the green salmon", "a green cat", "salmon the green " + "x" * 40])
    assert block.met("the green salmon", fj.ratio_bound(85.0)) == [0] and block.met(" ", fj.ratio_bound(85.0)) == []
    assert block.met("the green salmon", fj.words_bound(90.0)) == [0, 2]  # the third has all its words


def test_one_text_against_many_at_once():
    texts = ["", *some(5, 80), "x" * 300]
    for t in texts:
        assert sim.ratio_many(t, [(sim._masks(x), len(x)) for x in texts]) == [sim.ratio(t, x) for x in texts]
