"""Detection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict) -> DataFrame:
    """Percentiles by nearest rank: of n sorted values the one at min(n - 1, int(n * p)), from 0.

    A share may also be a function from the column n to a rank.  Rows are first counted by ranges of the value (64 to
    an octave), which finds the range that a rank lies in; only that range's different values are then put in order.
    ``n`` and ``greatest`` come with it, and a null value does not count.
    """
    from pyspark.sql import Window

    rows = rows.where(F.col(value).isNotNull())
    x = F.col(value).cast("double")
    size = F.floor(F.log2(F.least(F.abs(x), F.lit(1e300)) + 1.0) * 64.0)
    # a range grows with the value, below zero too; not-a-number is the greatest
    part = F.when(F.isnan(x), F.lit(1 << 20)).when(x < 0, -size - 1).otherwise(size).cast("long")
    counts = rows.groupBy(*keys, part.alias("_b")).agg(F.count("*").alias("_c"), F.max(value).alias("_m"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy("_b"))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: p(F.col("_n")) if callable(p) else F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(float(p))))
    found = [F.min(F.when(F.col("_upto") > at(p), F.struct("_b", (at(p) - F.col("_upto") + F.col("_c")).alias("rank")))).alias(name) for name, p in shares.items()]
    groups = counts.groupBy(*keys).agg(*found, F.max("_m").alias("greatest"), F.first("_n").alias("n"))
    wanted = groups.select(*keys, "greatest", "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), f"{name}._b", f"{name}.rank") for name in shares])).alias("_s"))
    wanted = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "greatest", "n", "_s.name", F.col("_s._b").alias("_at"), "_s.rank")
    # the groups' ranges meet the values of the same range only
    same = F.col("_b") == F.col("_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    chosen = wanted.select(*[f"_k{i}" for i in range(len(keys))], "_at").distinct()
    values = rows.select(*keys, F.col(value).alias("_v"), part.alias("_b")).join(chosen, same, "left_semi").groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_c"))
    values = values.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("_v")))
    met = values.join(wanted, same).where(F.col("_upto") > F.col("rank"))
    return met.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in shares], F.first("greatest").alias("greatest"), F.first("n").alias("n"))


def confusion(rows: DataFrame, keys: list[str], truth: Column, said: Column) -> DataFrame:
    """``tp, fn, fp, tn`` and the rates over them; an empty side counts as one in the denominator."""
    g = rows.groupBy(*keys).agg(F.count_if(truth & said).alias("tp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & said).alias("fp"), F.count_if(~truth & ~said).alias("tn"))
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    return g.select(*keys, "tp", "fn", "fp", "tn", over(tp, tp + fn).alias("recall"), over(fp, fp + tn).alias("fpr"), over(tp + tn, tp + fn + fp + tn).alias("accuracy"), over(tp, tp + fp).alias("precision"))


def sweep(rows: DataFrame, score: str, truth: str, steps: int, at_most: bool = False) -> DataFrame:
    """``g, recall, fpr`` at each threshold g / steps, 0 < g < steps; ``at_most`` for distances.

    Each row falls into one step, the steps are counted, and the counts are summed up from the end: the
    rows are read once however many thresholds there are.
    """
    from pyspark.sql import Window

    s = F.col(score)
    # the number of thresholds that a row passes, settled against the thresholds themselves
    guess = F.floor(s * steps)
    if at_most:
        step = F.ceil(s * steps)
        step = F.when(s <= (step - 1) / float(steps), step - 1).when(s <= step / float(steps), step).otherwise(step + 1)
    else:
        step = F.when(s >= (guess + 1) / float(steps), guess + 1).when(s >= guess / float(steps), guess).otherwise(guess - 1)
    binned = rows.select(step.cast("long").alias("g"), F.col(truth).alias("y")).groupBy("g").agg(F.count_if("y").alias("p"), F.count_if(~F.col("y")).alias("n"))
    grid = rows.sparkSession.range(1, steps).withColumnRenamed("id", "g").withColumn("grid", F.lit(True))
    both = binned.join(grid, "g", "full_outer").na.fill(0, ["p", "n"])
    order = Window.orderBy("g") if at_most else Window.orderBy(F.desc("g"))  # one row per step
    every = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = both.withColumn("tp", F.sum("p").over(order)).withColumn("fp", F.sum("n").over(order)).withColumn("P", F.sum("p").over(every)).withColumn("N", F.sum("n").over(every))
    return out.where("grid").select("g", (F.col("tp") / F.greatest("P", F.lit(1))).alias("recall"), (F.col("fp") / F.greatest("N", F.lit(1))).alias("fpr"))
