import random

import duckdb
import pandas as pd
import pytest

from tarnbeck.llm import common, quoting
from tarnbeck.llm.quoting import OP5_SQL, link_quotes, reply_order

ROWS = [
    (1, 0, "user", "Hello there\nHow are  you\tnow?"), (1, 1, "assistant", "> hello THERE\r\nFine.\n\nAnd you?"), (1, 2, "user", ">> Hello there\n > Fine.\n>and you?\nGood too"),
    (1, 3, "user", "> Hello there\n> nobody said this\n"), (1, 3, "user", "another text"), (1, 3, "user", "another text"), (1, 300, "x", "> fine.\n> hello there\n>\n"), (1, 301, "x", "> Good too\n> Good too\n> fine."),
    (1, 302, "x", ">> hello there how are you now?\nonly the deeper quote is known"), (1, 303, "x", "> hello there how\n> are you now?\n>\n> nobody\nwrapped anew"), (1, 304, "x", "> fine. and you?\nboth paragraphs in one"),
    (2, 5, "user", "> Fine.\nnot in this conversation"), (2, 9, "user", None), (2, 10, "user", ""), (2, 11, None, "  \n> > deep\n  end \n"), (3, 0, "a", "> self\nself"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def sql(rows):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    return sorted(str(tuple(None if x is pd.NA else x for x in r)) for r in con.sql(OP5_SQL).fetchall())


def test_matches_sql(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = link_quotes(df.selectExpr("*", "1 as h", "'z' as body", "2 as first").repartition(3)).collect()
    assert sorted(map(str, map(tuple, got))) == sql(ROWS)
    by = {(r.conv_id, r.turn, r.body): r for r in got}
    assert by[1, 2, "Good too"].parent_turn == 1 and by[1, 2, "Good too"].quote_depth == 2 and by[1, 2, "Good too"].n_linked == 3
    assert by[1, 301, ""].parent_turn == 2
    assert by[1, 302, "only the deeper quote is known"].parent_turn == 0 and by[1, 303, "wrapped anew"].n_linked == 2
    assert by[1, 304, "both paragraphs in one"].parent_turn == 1


def test_random_conversations_match_sql(spark, monkeypatch):
    monkeypatch.setattr(quoting, "BLOCK", 4)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    r, rows, said = random.Random(5), [], []
    for conv in range(3):
        texts = []
        for turn in range(30):
            own = "\n".join(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 3))) for _ in range(r.randint(1, 5)))
            quotes = []
            for _ in range(r.randint(0, 2)):
                if texts:
                    source, level = r.choice(texts), r.randint(1, 2)
                    quotes += ["> " * level + (x if r.random() < 0.9 else "changed") for x in (source.split("\n") if r.random() < 0.6 else [source.replace("\n", " ")])]
            texts.append(own)
            rows.append((conv, turn * r.choice([1, 3]), "x", "\n".join([*quotes, own])))
    got = sorted(map(str, map(tuple, link_quotes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())))
    assert got == sql(rows) and sum("'quote'" in x for x in got) > 40


@pytest.mark.parametrize("shape", ["random", "two chains", "star"])
def test_reply_order_is_that_of_the_tree(spark, shape, monkeypatch):
    monkeypatch.setattr(quoting, "BLOCK", 8)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    r = random.Random(1)
    turns = sorted(r.sample(range(500), 60))
    parent = {t: (r.choice(turns[:k]) if shape == "random" else turns[max(0, k - 2)] if shape == "two chains" else turns[0]) if k else None for k, t in enumerate(turns)}
    df = spark.createDataFrame([(7, t, parent[t], turns[k - 1] if k else None) for k, t in enumerate(turns)], "conv_id long, turn long, parent_turn long, previous long")
    want, stack = [], [turns[0]]
    while stack:
        at = stack.pop()
        want.append(at)
        stack += sorted((t for t in turns if parent[t] == at), reverse=True)
    assert [x.turn for x in reply_order(df).orderBy("position").collect()] == want


def test_null_keys_long_texts_and_empty(spark):
    df = spark.createDataFrame([(None, 1, "a", "> x\ny"), (1, None, "a", "y"), (1, None, "a", "y")], SCHEMA)
    assert sorted((r.body, r.parent_turn, r.linked_by, r.reply_position) for r in link_quotes(df).collect()) == [("y", None, "none", None)] * 3
    assert link_quotes(df.limit(0)).count() == 0
    long = "\n".join(f"line {k}" for k in range(5000))
    df = spark.createDataFrame([(1, 0, "a", long), (1, 1, "a", "other"), (1, 2, "a", "> " + long.replace("\n", "\n> "))], SCHEMA)
    assert {(r.turn, r.parent_turn, r.n_linked) for r in link_quotes(df).collect()} == {(0, None, 0), (1, 0, 0), (2, 0, 5000)}
