import duckdb
import pandas as pd

from tarnbeck.llm import common, warc
from tarnbeck.llm.warc import OP1_SQL, archive_and_read_back, build_index, look_up, surt, write_archives


def test_keys():
    assert surt("https://www.M.example.net:8080/en/25?x=1#top") == "net,example,m:8080)/en/25?x=1"
    assert surt(None) == "" and surt("http://a.b") == "b,a)/"
    assert surt("http://[bad") == "http://[bad"


ROWS = [(i, f"http://h{i % 3}.org/{i % 5}\n", "x" * (i % 4) + "é" * (i % 2)) for i in range(-5, 40)] + [
    (100, None, None), (101, "u\tv", ""), (102, "u\tv", "long " * 50000), (None, "u", "v"), (None, "u", "v"), (None, "w", None), (103, "z", "same"), (103, "z", "same"),
    (103, "y", "same"), (104, "z", "same"), (104, "z", "other"), (105, "z", "one"), (105, "q", "two"),
] + [(200, "http://many.org/", "again")] * 40


def sql(rows, least):
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}))
    rows = con.sql(OP1_SQL).fetchall()
    short = [(a, b, c, "response", None, ok) if b < least else (a, b, c, d, e, ok) for a, b, c, d, e, ok in rows]
    return sorted(map(str, short))


def test_one_record_per_row_with_copies_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 8)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 as offset", "'k' as key", "2 as n", "'t' as sha").repartition(3)
    for least in (0, 3):
        got = sorted(str(tuple(r)) for r in archive_and_read_back(df, least, 3).collect())
        assert got == sql(ROWS, least)
    assert archive_and_read_back(df.limit(0)).count() == 0


def test_a_look_up_finds_what_is_there_and_nothing_else(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    root = common.passing(spark, common.work_path(spark, "warc"))
    directory = build_index(write_archives(df, root), root, 2)
    asked = spark.createDataFrame([("org,many)/", 200), ("org,many)/", 200), ("org,many)/", 201), ("", 1), ("~", None), ("u)/", None)], "key string, page_id long")
    assert sorted((r.page_id or 0) for r in look_up(asked, directory, root).collect()) == [0, 0] + [200] * 40
