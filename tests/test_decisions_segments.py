import random

from pyspark.sql import functions as F

from tarnbeck.operators import decisions as dec
from tarnbeck.operators import joins
from tarnbeck.operators import metrics as m
from tarnbeck.operators import segments as seg
from tarnbeck.operators import tables as tb


def fold(rows, window=15.0):
    out, by_key = {}, {}
    for k, t, o, p in sorted(rows):
        recent = [(u, q) for u, q in by_key.get(k, []) if u >= t - window] + [(t, p)]
        by_key[k] = recent
        out[k, o] = sum(q == p for _, q in recent), len({q for _, q in recent})
    return out


def test_windows_match_a_sequential_fold(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 3), float(r.randint(0, 60)), i, r.choice("abc")) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t double, o int, p string")
    got = {(x.k, x.o): (x.n_same, x.n_distinct) for x in dec.repeats(df, ["k"], "p", "t", ["o"]).collect()}
    assert got == fold(rows)


def test_escalation_golden(spark):
    rows = [("j1", 0.0, 1, "UDK_14", True), ("j1", 5.0, 2, "UDK_14", True), ("j2", 0.0, 3, "UDK_02", False), ("j2", 1.0, 4, "UDK_05", False), ("j3", 0.0, 5, "UDK_14", True), ("j3", 15.0, 6, "UDK_14", True), ("j4", 0.0, 7, "UDK_14", True), ("j4", 15.5, 8, "UDK_14", True)]
    h = spark.createDataFrame(rows, "k string, t double, o int, p string, verify_by_default boolean").withColumns({"confidence": F.lit(0.7), "corroborated": F.lit(False), "scream": F.lit(False)})
    got = {x.o: (x.decision, x.repeated) for x in dec.escalate(dec.repeats(h, ["k"], "p", "t", ["o"])).collect()}
    v, a = "TRIGGER_VERIFY", "TRIGGER_ALL"
    assert got == {1: (v, False), 2: (a, True), 3: (v, False), 4: (a, False), 5: (v, False), 6: (a, True), 7: (v, False), 8: (v, False)}


def test_episode_gaps(spark):
    def n(times):
        df = spark.createDataFrame([(1, float(t)) for t in times], "k int, t double")
        return seg.episodes(df, ["k"], "t", []).agg(F.max("episode")).first()[0]

    assert [n(x) for x in ([0, 9.5, 19], [0, 10, 20], [0], [0, 9.99, 30])] == [1, 3, 1, 2]


def tiled(flags, pre, post, most):
    """``_Tiles`` over the runs of a list of flags."""
    tiles, out, at, n = seg._Tiles(pre, post, most), [], 0, len(flags)
    while at < n:
        to = at
        while to < n and flags[to]:
            to += 1
        out += tiles.add(at, to) if to > at else []
        at = max(to, at + 1)
    out += [tiles.close()] if tiles.speech is not None else []
    return [(a, min(b, n)) for a, b in out]


def test_speech_segments():
    t, f = True, False
    assert tiled([t] * 20 + [f] * 5, 1, 1, 266) == [(0, 21)]
    pieces = tiled([t] * 250, 1, 1, 100)
    assert pieces[0][0] == 0 and pieces[-1][1] == 250 and all(b[0] <= a[1] for a, b in zip(pieces, pieces[1:])) and len(pieces) == 3
    apart = tiled([t] * 6 + [f] * 55 + [t] * 8 + [f] * 60, 10, 50, 266)
    assert len(apart) == 2 and apart[0][1] <= apart[1][0]
    assert tiled([t] * 5 + [f] * 20 + [t] * 30 + [f] * 60, 10, 50, 266) == [(0, 105)]
    assert tiled([], 1, 1, 5) == [] and tiled([f] * 4, 1, 1, 5) == []


def test_gaps_prefix_and_writes(spark):
    df = spark.createDataFrame([("a", 0, "x"), ("a", 1, "x"), ("a", 2, "x"), ("a", 4, "x"), ("b", 2, "x"), ("b", 2, "y"), ("a", 4, "x")], "k string, s int, v string").withColumn("at", F.monotonically_increasing_id())
    assert sorted((r.k, r.s) for r in seg.missing_seqs(df, "k", "s").collect()) == [("a", 3)]
    assert sorted((r.k, r.n_prefix) for r in seg.contiguous_prefix(df, "k", "s", 0).collect()) == [("a", 3), ("b", 0)]
    w = {(r.k, r.s): (r.n_writes, r.conflict) for r in tb.chunk_writes(df, ["k", "s"], F.col("v"), ["at"]).collect()}
    assert w["a", 4] == (2, False) and w["b", 2] == (2, True)


def test_nearest_rank_and_sweep(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (None, True)], "v double, y boolean")
    r = m.nearest_rank(df.withColumn("k", F.lit(1)), ["k"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.p50, r.p95, r.greatest, r.n) == (2.0, 2.0, 2.0, 2)
    rnd = random.Random(7)
    vals = [(k, rnd.choice([rnd.gauss(0, 50), float(rnd.randint(-3, 3)), 100.0 + rnd.random() / 100, float("inf")])) for k in ["a", None, "a", "b"] for _ in range(60)]
    got = m.nearest_rank(spark.createDataFrame(vals, "k string, v double"), ["k"], "v", {"p5": 0.05, "p95": 0.95, "low": lambda n: F.floor((n - 1) / 2)}).collect()
    for x in got:
        own = sorted(v for k, v in vals if k == x.k)
        at = [min(len(own) - 1, int(len(own) * p)) for p in (0.05, 0.95)]
        assert (x.p5, x.p95, x.low, x.greatest, x.n) == (own[at[0]], own[at[1]], own[(len(own) - 1) // 2], own[-1], len(own))
    assert {x.k for x in got} == {"a", "b", None}
    rnd = random.Random(2)
    rows = [(rnd.choice([rnd.random(), rnd.randint(0, 100) / 100]), rnd.random() < 0.4) for _ in range(200)]
    s = spark.createDataFrame(rows, "s double, y boolean")
    for at_most in (False, True):
        got = {x.g: (x.recall, x.fpr) for x in m.sweep(s, "s", "y", 100, at_most).collect()}
        for g in range(1, 100):
            hit = [y for v, y in rows if (v <= g / 100 if at_most else v >= g / 100)]
            assert got[g] == (sum(hit) / sum(y for _, y in rows), (len(hit) - sum(hit)) / sum(not y for _, y in rows)), g


def test_rate_limit_and_streak(spark):
    df = spark.createDataFrame([("k", float(t)) for t in (0, 1, 2, 3, 10, 10.5, 21)] + [("l", 0.0)], "k string, t double")
    got = {(r.k, r.t): r.allowed for r in seg.rate_limit(df, "k", "t", 2, 10.0).collect()}
    assert got == {("k", 0.0): True, ("k", 1.0): True, ("k", 2.0): False, ("k", 3.0): False, ("k", 10.0): False, ("k", 10.5): True, ("k", 21.0): True, ("l", 0.0): True}
    c = spark.createDataFrame([(1, i, v, "en") for i, v in enumerate("te te en te te te hi".split())], "k int, i int, v string, now string")
    assert [r.i for r in seg.confirmation_streak(c, ["k"], ["i"], "v", "now").where("switches").collect()] == [5]


def test_joins_match_brute_force(spark):
    r = random.Random(8)
    pts = [(r.randint(0, 2), i, r.uniform(0, 100), r.choice("ab")) for i in range(80)]
    spans = [(r.randint(0, 2), s, s + r.uniform(0, 30), r.choice("xyz")) for s in (r.uniform(0, 100) for _ in range(30))]
    p = spark.createDataFrame(pts, "k int, i int, t double, c string")
    s = spark.createDataFrame(spans, "k int, a double, b double, n string")
    got = {x.i: x.within for x in joins.interval_lookup(p, s, ["k"], "t", "a", "b", "n", 10.0).collect()}
    assert got == {i: sorted({n for q, a, b, n in spans if q == k and a <= t <= b}) for k, i, t, _ in pts}
    assert {x.i: x.within for x in joins.interval_lookup(p, s, ["k"], "t", "a", "b", "n", 0.5).collect()} == got
    assert not any(x.within for x in joins.interval_lookup(p, s.limit(0), ["k"], "t", "a", "b", "n", 0.5).collect())
    got = {x.i: x.agrees for x in joins.band_differs(p, ["k"], "t", 3.0, "c").collect()}
    assert got == {i: any(q == k and j != i and abs(u - t) <= 3 and d != c for q, j, u, d in pts) for k, i, t, c in pts}
    got = {x.i: x.nearest for x in joins.nearest(p, s, ["k"], "t", "a", "n").collect()}
    assert got == {i: min(((abs(a - t), a, n) for q, a, _, n in spans if q == k), default=(0, 0, None))[2] for k, i, t, _ in pts}


def test_plans_are_pushed_down(spark, sf):
    from tarnbeck.plans import queries

    plan = queries()["journey_point_lookup"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,42)]" in plan
    scan = queries()["journeys_projection"](spark, sf)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in scan


def test_many_phrases_and_nulls_are_counted(spark):
    r = random.Random(5)
    rows = [(1, float(r.randint(0, 400)), i, f"p{r.randint(0, 299)}") for i in range(900)]
    df = spark.createDataFrame(rows, "k int, t double, o int, p string")
    got = {(x.k, x.o): (x.n_same, x.n_distinct) for x in dec.repeats(df, ["k"], "p", "t", ["o"]).collect()}
    assert got == fold(rows)
    nulls = spark.createDataFrame([(1, 0.0, 1, None), (1, 1.0, 2, "a"), (1, 2.0, 3, None)], "k int, t double, o int, p string")
    assert [x.n_distinct for x in dec.repeats(nulls, ["k"], "p", "t", ["o"]).orderBy("o").collect()] == [0, 1, 1]
    assert dec.repeats(df.limit(0), ["k"], "p", "t", ["o"]).count() == 0


def test_drain_matches_a_sequential_fold(spark):
    r = random.Random(6)
    rows = [(r.randint(0, 2), float(r.randint(0, 40)), i, *(r.random() < s for s in (0.4, 0.3, 0.4, 0.5))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t double, id long, alert boolean, sent boolean, beat boolean, up boolean")
    want, waiting = {}, {}
    for k, _, i, alert, sent, beat, up in sorted(rows, key=lambda x: (x[1], x[2])):
        mine = waiting.setdefault(k, {})
        if beat:
            for a in list(mine):
                mine[a] += 1
                if up:
                    want[a] = (i, mine.pop(a))
        if alert and sent:
            want[i] = (i, 1)
        elif alert:
            mine[i] = 1
    want.update({a: (None, n) for m in waiting.values() for a, n in m.items()})
    out = dec.drain(df, "k", ["t", "id"], "id", *(F.col(c) for c in ("alert", "sent", "beat", "up")))
    assert {x.id: (x.delivered_by, x.attempts) for x in out.collect()} == want


def test_known_titles_win_over_likeness(spark):
    titles = spark.createDataFrame([("old red bolt", "zinc nut"), ("old red nut", "gone"), ("quite other", None), (None, "zinc nut"), ("old red bolt", None)], "title string, known string")
    files = spark.createDataFrame([("red bolt",), ("red nut",), ("zinc nut",), (None,)], "f string")
    got = {x.title: (x.file, x.score) for x in joins.best_titles(titles, "title", "known", files, "f").collect()}
    assert got.keys() == {"old red bolt", "old red nut", "quite other"}
    assert got["old red bolt"] == ("zinc nut", 100.0) and got["old red nut"][0] == "red nut" and got["quite other"] == (None, None)
