import random
import re

from tarnbeck.llm import common
from tarnbeck.llm.jaccard import first_of_groups, jaccard_components


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(d, sets_of(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def make(seed, groups, most):
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)]
    shared = [r.choice(vocab) for _ in range(40)]
    rows, d = [], -20
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(1, 120))]
        if r.random() < 0.4:
            base = base[:60] + shared
        for _ in range(r.randint(1, most)):
            x = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
                x[r.randrange(len(x))] = r.choice(vocab)
            rows.append((d, r.choice([" ", "\n"]).join(x)))
            d += r.randint(1, 3)
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = make(1, 60, 6) + make(2, 1, 1)[:0] + [(5000, None), (5001, ""), (5002, " \n"), (None, "a b c d e f"), (5003, "A b"), (5004, "a B"), (5005, "b a")]
    rows += [(6000 + i, t) for i, (_, t) in enumerate(make(3, 1, 80) + make(4, 1, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "2 as rep", "3 as component_id").repartition(6)
    want = brute(rows)
    for kinds in ({}, {"least": 4, "chunk": 8}, {"least": 10**9, "chunk": 8}):  # the last: long lists that are not known as frequent
        monkeypatch.setattr(common, "HOT_ROWS", 3 if kinds else 1000)
        got = sorted((tuple(x) for x in jaccard_components(df, **kinds).collect()), key=str)
        assert got == want, kinds


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (0, "x")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(df).collect())) == [(0, 1, 0), (1, 2, 1), (1, 2, 1)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_ids_that_stand_for_several_texts(spark):
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, z = words("a", 60), words("z", 60)
    rows = [(3, a), (5, a + " tail"), (5, z), (9, z + " end"), (9, None), (11, None), (12, words("q", 30)), (12, words("r", 30)), (13, words("r", 30) + " s")]
    want = brute(rows)
    assert {(d, c) for d, _, c in want} == {(3, 3), (5, 3), (9, 3), (11, 11), (12, 12), (13, 12)}
    for layout in (rows, rows[1::2] + rows[::2]):
        df = spark.createDataFrame(layout, "doc_id long, text string").repartition(3)
        assert sorted((tuple(x) for x in jaccard_components(df).collect()), key=str) == want
        stay = {r.doc_id: 0 for r in first_of_groups(df).collect()}
        assert stay.keys() == {3, 5, 9, 11, 12}  # 5 with z alone, 9 with its null, 12 with both


def test_rows_of_one_id_are_kept_by_text(spark, sf):
    from corpus_pipeline import keep_one_of_near_copies

    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    a, z = words("a", 60), words("z", 60)
    rows = [(3, a), (5, a + " tail"), (5, z), (None, a), (7, z + " end"), (8, a)]
    for layout in (rows[::-1],):
        df = spark.createDataFrame(layout, "doc_id long, text string")
        assert sorted(map(tuple, keep_one_of_near_copies(spark, df, sf).collect()), key=str) == sorted([(3, a), (5, z), (None, a)], key=str)
