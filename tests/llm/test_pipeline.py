import re

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tarnbeck.llm.queries import queries


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf)
        assert made.columns == docs.columns, name
        path = corpus_pipeline.work_path(spark, "test")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before), name
        if name == "ngram_jaccard":
            assert set(after) == {d for d, _, c in brute(list(before.items())) if d == c}
        before = after
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for text in before.values():
        flat = " ".join(re.findall(r"\w+", text.lower()))
        assert not any(" ".join(i) in flat for i in items)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in out} == set(before) and all(r.round_trip and len(r.ids) == r.n_pieces for r in out)


def test_edge_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "12 34", None, "s", 5), (0, "aaa", "en", "s", 3)], docs.schema)
    for table in (docs.unionByName(odd), docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            path = corpus_pipeline.work_path(spark, "test")
            stage(spark, table, sf).write.parquet(path)
            table = spark.read.parquet(path)
    assert {f"op{n}_" for n in range(1, 14)} == {re.match(r"op\d+_", k)[0] for k in queries() if k not in ("pipeline", "quoted_conversations")}


def test_only_the_first_of_exact_copies_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = sorted((r for r in docs.collect() if r.text and re.search(r"[^\W\d]", r.text)), key=lambda r: r.doc_id)[:40]
    tail = [(10**6 + k, "\n".join(x[::-1] for x in r.text.split("\n")) + f"\nHaanth.\nEnd {k}.", r.lang, r.source, 0) for k, r in enumerate(some)]
    copies = [(10**7 + k, t, a, s, n) for k, (_, t, a, s, n) in enumerate(tail)]
    table = docs.unionByName(spark.createDataFrame(tail + copies, docs.schema))
    groups = {}
    for r in table.where("doc_id is not null and text is not null").collect():
        groups.setdefault(r.text, []).append(r.doc_id)
    later = {d for ids in groups.values() for d in ids if d > min(ids)}
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = corpus_pipeline.work_path(spark, "test")
        stage(spark, table, sf).write.parquet(path)
        table = spark.read.parquet(path)
    left = {r.doc_id for r in table.collect()}
    assert len(later) >= 40 and not left & later
    assert left & {d for d, *_ in tail}  # the first copies are whole up to here
