import random

import pytest

from tarnbeck.llm import common
from tarnbeck.llm.line_dedup import _one_edit, _split, dedup_lines, duplicate_lines
from tarnbeck.llm.queries import queries


def brute(rows, least=5, short=False):
    """The earliest match of every line that has one: place -> (place, edits)."""
    lines = sorted((d, h, i, _split(x), x) for d, h, t in rows for i, x in enumerate(t.split("\n")) if _split(x))
    found = {}
    for k, (d, h, i, x, raw) in enumerate(lines):
        for e, g, j, y, other in lines[:k]:
            if (e, g, j) < (d, h, i) and ((x == y and (short or len(x) >= least)) or (min(len(x), len(y)) >= least and _one_edit(raw, other))):
                found[d, h, i] = ((e, g, j), int(x != y))
                break
    return found


def hashed(df):
    """(id, text hash, text) of the rows that take part, null ids last."""
    return [(2**63 - 1 if r.doc_id is None else r.doc_id, r.h, r.text) for r in df.selectExpr("doc_id", "xxhash64(text) as h", "text").collect() if r.text is not None]


def random_rows(seed, n=120):
    r, rows = random.Random(seed), []
    for d in range(n):
        text = []
        for _ in range(r.randint(0, 6)):
            line = r.choice(["a b c d e f g", "the cat sat on a mat", "x " * 12, "p q r s t", "so it is"]).split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k = r.randrange(len(line))
                r.choice([lambda: line.insert(k, r.choice("uvw")), lambda: line.pop(k) if len(line) > 1 else None, lambda: line.__setitem__(k, r.choice("uvw"))])()
            text.append(r.choice([" ", "  "]).join(line))
        rows.append((r.choice([d * 7 - 50, d // 2, None]), "\n".join(text)))
    return rows


def as_dict(got):
    big = lambda x: 2**63 - 1 if x is None else x
    return {(big(r.doc_id), r.text_hash, r.line_no): ((big(r.of_doc_id), r.of_text_hash, r.of_line_no), r.edits) for r in got}


@pytest.mark.parametrize("parts,hot", [(1, 1000), (5, 3), (40, 1000)])
def test_matches_brute_force_in_any_layout(spark, parts, hot, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", hot)  # also with keys dealt out to several tasks
    rows = random_rows(11) + [(None, "a b c d e f g"), (900, None), (901, ""), (902, "\n\n"), (903, "a b c d e f g\n"), (904, "w " * 20000), (904, "w " * 19999 + "\nz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("doc_id", "text", "1 as line_no", "2 as h", "3 as row", "4 as _gone", "5 as _gone_id")
    for short in (False, True):
        got = duplicate_lines(df, short=short).collect()
        want = brute(hashed(df), short=short)
        assert as_dict(got) == want
    gone = brute(hashed(df))
    kept = sorted(map(str, ((r.doc_id, r.text) for r in dedup_lines(df).collect())))
    cut = []
    for d, h, t in df.selectExpr("doc_id", "xxhash64(text)", "text").collect():
        cut.append((d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (2**63 - 1 if d is None else d, h, i) not in gone)))
    assert kept == sorted(map(str, cut))


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    rows = [(5, "k l m n o p\nkeep this line as it is"), (5, "totally different words live here\nsecond line of the second row"), (4, "k l m n o p")]
    got = {r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {"keep this line as it is", rows[1][1], rows[2][1]}


def test_the_earliest_match_does_not_depend_on_the_files(spark):
    rows = [(1, "a b c d e f"), (10, "a b c d e x"), (11, "a b c d e y")]
    for parts in (1, 2, 3):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
        assert {(r.doc_id, r.of_doc_id) for r in duplicate_lines(df).collect()} == {(10, 1), (11, 1)}


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert duplicate_lines(df).count() == 0
    assert duplicate_lines(df.limit(0)).count() == 0 and dedup_lines(df.limit(0)).count() == 0


def test_short_lines_and_scripts_without_spaces(spark):
    rows = [
        (1, "All rights reserved.\nLes.\n\n }\nAll rights kept."),
        (2, "Les.\n \n}\nAll  rights reserved.\nLes chats.\nLes."),
        (3, "今天的天气非常好我们去公园散步\nถ้าวันนี้อากาศดี\n第一章总则\nabc今天 的天气x"),
        (4, "今天的天气非常好我们去公园跑步\n今天的天气非常好我们去公园散步\n第二章总则\nถ้าวันนี้อากาศดี\nabc 今天的天气 y"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.line_no): (r.of_doc_id, r.of_line_no, r.edits) for r in duplicate_lines(df, short=True).collect()}
    want = {(2, 0): (1, 1, 0), (2, 2): (1, 3, 0), (2, 3): (1, 0, 0), (2, 5): (1, 1, 0)}
    assert got == want | {(4, 0): (3, 0, 1), (4, 1): (3, 0, 0), (4, 3): (3, 1, 0)}
    assert {r.doc_id: r.text for r in dedup_lines(df, short=True).collect()}[2] == " \nLes chats."


def test_the_query_reports_every_exact_repeat(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id is not null and text is not null").collect()}
    seen, again = set(), set()
    for d in sorted(docs):
        for i, x in enumerate(docs[d].split("\n")):
            key = tuple(_split(x))
            again |= {(d, i)} if key and key in seen else set()
            seen.add(key)
    got = {(r.doc_id, r.line_no) for r in queries()["op4_line_dedup"](spark, sf).collect()}
    assert again <= got and any(len(_split(docs[d].split("\n")[i])) < 5 for d, i in again)
