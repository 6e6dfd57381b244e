import threading

import pytest

from tarnbeck.llm.common import passing, work_path
from tarnbeck.llm.compaction import Store, compact_arrivals


def test_rows_are_kept_and_tiers_are_merged(spark):
    df = spark.range(-3, 4000).selectExpr("if(id < 0, if(id = -3, null, 5), id) as doc_id", "if(id < -1, null, repeat(cast(id as string), 50)) as text", "'x' as _shard", "1 as shard_rows").repartition(3)
    got = compact_arrivals(df, target_bytes=60_000, least_bytes=2_000, rows_a_shard=100)
    out = got.collect()
    assert sorted(str((r.doc_id, r.text, r._shard)) for r in out) == sorted(str((r.doc_id, r.text, r._shard)) for r in df.collect())
    assert sum(r.shard_merged for r in out) > 3000 and all(r.shard_min_id <= r.doc_id <= r.shard_max_id for r in out if r.doc_id is not None)
    assert compact_arrivals(df.limit(0)).count() == 0


def test_a_very_long_text_is_one_row_of_its_shard(spark):
    df = spark.createDataFrame([(1, "word " * 400_000), (2, "b"), (2, "b"), (2, None)], "doc_id long, text string")
    assert sorted(len(r.text or "") for r in compact_arrivals(df, target_bytes=1000, least_bytes=10).collect()) == [0, 1, 1, 2_000_000]


def _store(spark, path, **sizes):
    return Store(spark, path, rows_a_shard=10, least_bytes=100, **sizes)


def test_versions_are_atomic_and_readers_keep_theirs(spark):
    path = passing(spark, work_path(spark, "shards"))
    a, b = _store(spark, path), _store(spark, path)
    df = spark.range(100).selectExpr("id as doc_id", "'t' as text").coalesce(1)
    assert a.append(df) == 1
    old = b.read(df.schema, 1)
    assert not b.commit(0, b.manifest(1))  # version 1 exists
    assert b.append(df) == 2 and a.read(df.schema).count() == 200
    assert a.compact(df.schema) > 2
    assert old.count() == 100 and a.read(df.schema).count() == 200
    shards = a.manifest().count()
    assert shards < 20
    a.vacuum()
    assert a.read(df.schema).count() == 200 and a.manifest().count() == shards
    with pytest.raises(Exception):
        a.manifest(1).count()
    assert a.append(df.limit(0)) == a.version()


def test_vacuum_spares_what_a_writer_has_not_committed(spark):
    path = passing(spark, work_path(spark, "shards"))
    a, b = _store(spark, path), _store(spark, path)
    df = spark.range(100).selectExpr("id as doc_id", "'t' as text").coalesce(1)
    a.append(df)
    lease = b._lease()
    written = b._write(df, lease, 0, 2)
    a.vacuum()
    assert b.commit(1, b.manifest(1).unionByName(written)) and b.read(df.schema).count() == 200
    b._release(lease)
    lost = b._write(df, b._lease(), 0, 3)  # its writer dies
    a.vacuum()
    assert lost.count() == 1
    a.vacuum(grace=0)
    with pytest.raises(Exception):
        lost.count()
    assert a.read(df.schema).count() == 200


def test_writers_at_once_lose_nothing(spark):
    path = passing(spark, work_path(spark, "shards"))
    failed = []

    def work(k):
        try:
            store = _store(spark, path, fanout=2)
            for j in range(3):
                df = spark.range(30).selectExpr(f"id + {100 * (3 * k + j)} as doc_id", "'t' as text").coalesce(1)
                store.append(df)
                if k == 0:
                    store.compact(df.schema)
                    store.vacuum()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    store = _store(spark, path)
    ids = [r.doc_id for r in store.read("doc_id long, text string").collect()]
    assert sorted(ids) == sorted(i + 100 * k for k in range(9) for i in range(30))
