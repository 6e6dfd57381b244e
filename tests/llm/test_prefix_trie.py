import hashlib
import random
import zlib
from collections import defaultdict

import duckdb

from tarnbeck.llm import prefix_trie as pt
from tarnbeck.llm.queries import op11_prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, pt_sha(role, text), role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + mine[h:]
    return out


def pt_sha(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows):
    convs = rebuilt(rows)
    members = defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)]
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), len(leaf),
                    sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, depth int, n string").repartition(partitions)
    return sorted((tuple(r[c] for c in COLUMNS) for r in pt.conversation_trie(df).collect()), key=str)


def test_random_conversations_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pt, "ID_CHUNK", 4)
    r = random.Random(8)
    rows = []
    for c in [*range(40), *range(95, 112), 305, 777]:
        for t in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            rows.append((c, t, r.choice(["user", "bot", None]), r.choice(["", "a", "bé", None, "😀"])))
    rows += [(k, None, None, "first") for k in (3, 4, 100)] + [(5, 0, "user", "again")] * 3 + [(None, 1, "user", "nowhere")]
    assert run(spark, rows) == brute(rows)


def test_one_long_conversation_copies_and_turnless(spark):
    long = [(200, t, "user", f"t{t % 7}") for t in range(70)] + [(201, t, "user", f"t{t % 7}") for t in range(70)]
    same = [(c, t, "u", "hi" * (t + 1)) for c in range(1000, 1060) for t in range(2)]  # many turnless ones: no such base, few own turns
    far = [(100 * k + 7, 0, "u", "x") for k in range(20, 40)]
    for rows in (long + same + far, far, [(7, 0, "a", "b")]):
        assert run(spark, rows, 5) == brute(rows)


def test_empty_table(spark):
    assert run(spark, [(None, 1, "a", "b")]) == [] and pt.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_sql_and_query_agree(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.sql(f"select {', '.join(COLUMNS)} from ({pt.OP11_SQL})").fetchall()
    got = [tuple(r[c] for c in COLUMNS) for r in op11_prefix_trie(spark, sf).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 40
