"""Joins on bands, intervals and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_differs(rows: DataFrame, keys: list[str], at: str, width: float, label: str) -> DataFrame:
    """``rows`` with ``agrees``: whether another row of the keys within ``width`` has another label.

    It has if the least or the greatest label in reach is not the row's own, so no pairs are made.  A key's
    rows are dealt out to cells of 32 widths, those near an edge to both sides, so a hot key is many tasks.
    A null key, place or label agrees with nothing.
    """
    cell = lambda c: F.floor(c / (32.0 * width))
    known = F.col(at).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    reach = F.array_distinct(F.array(cell(F.col(at) - width), cell(F.col(at)), cell(F.col(at) + width)))
    dealt = rows.withColumn("_cell", F.explode(F.when(known, reach).otherwise(F.array(F.lit(None).cast("long")))))
    over = f"over (partition by {', '.join([*keys, '_cell'])} order by {at} range between {float(width)}D preceding and {float(width)}D following)"
    other = known & ((F.col("_least") != F.col(label)) | (F.col("_most") != F.col(label)))
    out = dealt.withColumns({"_least": F.expr(f"min({label}) {over}"), "_most": F.expr(f"max({label}) {over}")})
    return out.where(~known | (F.col("_cell") == cell(F.col(at)))).withColumn("agrees", F.coalesce(other, F.lit(False))).drop("_cell", "_least", "_most")


def interval_lookup(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, label: str, cell: float) -> DataFrame:
    """``points`` with ``within``: sorted distinct labels of the spans that hold the point (ends included).

    A span longer than ``cell`` takes cells of that width doubled as often as it needs, so it is listed in three at
    most; points are listed once for each width in use (not over 64 for lengths that differ by up to 2**64).
    """
    spans = spans.where(F.col(end) >= F.col(start))
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)) / cell))).cast("int")
    wide = F.pow(F.lit(2.0), F.col("_level")) * cell
    listed = spans.withColumn("_level", level)
    levels = sorted(r["_level"] for r in listed.select("_level").distinct().collect()) or [0]
    listed = listed.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(start) / wide), F.floor(F.col(end) / wide))))
    distinct = points.groupBy(*points.columns).agg(F.count("*").alias("_n"))  # rows that repeat are looked up once
    p = distinct.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]))).withColumn("_cell", F.floor(F.col(at) / wide))
    joined = p.join(listed.select(*keys, "_level", "_cell", start, end, label), [*keys, "_level", "_cell"], "left")
    inside = F.when(F.col(at).between(F.col(start), F.col(end)), F.col(label))
    found = joined.groupBy(*points.columns, "_n").agg(F.array_sort(F.collect_set(inside)).alias("within"))
    return repeat_rows(found, "_n")


def repeat_rows(rows: DataFrame, times: str, most: int = 4_096) -> DataFrame:
    """Each row as often as its column ``times`` says, which goes; no array is longer than ``most`` or the number of such arrays."""
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / most)))
    rows = rows.where(F.col(times) > 0).withColumn("_many", many)
    return rows.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(most), F.col(times) - most * F.col("_many"))))).drop("_many", "_one", times)


def beside(rows: DataFrame, few: DataFrame, most: int) -> DataFrame:
    """Every row beside every row of ``few``, a stated set that is counted and sent along in blocks of about ``most``."""
    blocks = max(1, -(-few.count() // most))
    if blocks == 1:
        return rows.crossJoin(F.broadcast(few))
    block = F.pmod(F.xxhash64(*few.columns), F.lit(blocks))
    out = rows.crossJoin(F.broadcast(few.where(block == 0)))
    for b in range(1, blocks):
        out = out.unionByName(rows.crossJoin(F.broadcast(few.where(block == b))))
    return out


def best_titles(titles: DataFrame, title: str, known: str, files: DataFrame, file: str, least: float = 75.0) -> DataFrame:
    """``title, file, score`` for every different title: its known file where that exists (score 100), else the file of
    the best weighted score of ``least`` at least (ties: the last by name), else null.

    The join loses no pair (``fuzzyjoin.best_weighted``).  A title with several known files takes the first by name.
    """
    from .fuzzyjoin import best_weighted

    files = files.select(F.col(file).alias("file")).where("file is not null").distinct()
    sure = titles.join(files, F.col(known) == F.col("file")).groupBy(F.col(title).alias("title")).agg(F.min("file").alias("sure"))
    every = titles.select(F.col(title).alias("title")).where("title is not null").distinct().join(sure, "title", "left")
    best = best_weighted(every.where("sure is null").select("title"), files, least).toDF("title", "best", "score")
    out = every.join(best, "title", "left")
    return out.select("title", F.coalesce("sure", "best").alias("file"), F.when(F.col("sure").isNotNull(), 100.0).otherwise(F.col("score")).alias("score"))


def nearest(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, label: str) -> DataFrame:
    """``points`` with the label of the nearest mark of the keys (ties: the earlier mark, then the label).

    An as-of join from both sides by one window over points and marks together: no pairs are made.
    """
    carried = F.struct(F.col(mark_at).alias("t"), F.col(label).alias("label"))
    rest = [c for c in points.columns if c not in (*keys, at)]
    both = points.select(*keys, F.col(at).alias("_at"), F.struct(*[F.col(c) for c in rest], F.lit(1).alias("_p")).alias("_row"), F.lit(None).cast(marks.select(carried.alias("m")).schema["m"].dataType).alias("_mark"))
    both = both.unionByName(marks.select(*keys, F.col(mark_at).alias("_at"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), carried.alias("_mark")))
    w = Window.partitionBy(*keys)
    # among marks of one time the least label stands for all
    back = F.max(F.when(F.col("_mark").isNotNull(), F.col("_mark.t"))).over(w.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("_mark").isNotNull(), F.col("_mark.t"))).over(w.orderBy("_at").rangeBetween(0, Window.unboundedFollowing))
    found = both.withColumn("_b", back).withColumn("_a", ahead).where(F.col("_row").isNotNull())
    best = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).when(F.col("_at") - F.col("_b") <= F.col("_a") - F.col("_at"), F.col("_b")).otherwise(F.col("_a"))
    names = marks.groupBy(*keys, F.col(mark_at).alias("_t")).agg(F.min(label).alias("nearest"))
    found = found.select(*keys, F.col("_at").alias(at), "_row", best.alias("_t")).join(names, [*keys, "_t"], "left")
    return found.select(*keys, at, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_t").alias("nearest_at"), "nearest")


def context_window(rows: DataFrame, keys: list[str], at: str, order: str, text: str, span: float) -> DataFrame:
    """``rows`` with ``context``: the texts of earlier rows no more than ``span`` before, in order."""
    near = F.sort_array(F.expr(f"collect_list(struct({at} as t, {order} as o, {text} as x)) over (partition by {', '.join(keys)} order by {at} range between {float(span)}D preceding and current row)"))
    rows = rows.withColumn("_near", near)
    earlier = F.filter("_near", lambda r: F.struct(r["t"].alias("t"), r["o"].alias("o")) < F.struct(F.col(at).alias("t"), F.col(order).alias("o")))
    return rows.withColumn("context", F.array_join(F.transform(earlier, lambda r: r["x"]), " ")).drop("_near")
