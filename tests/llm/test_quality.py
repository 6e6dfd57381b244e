import numpy as np
from pyspark.sql import functions as F

from tarnbeck.llm.quality_qda import fit_discriminant, quality_scores, transform
from tarnbeck.llm.quality_rules import fit_trees, quality_rules


def data(n=600, k=14):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (n, k))
    return x, (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(float)


def test_trees_fit_and_stay_monotone():
    x, y = data()
    sign = np.zeros(14)
    sign[0], sign[1] = 1, -1
    model = fit_trees(x, y, sign)
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85
    for j, s in ((0, 1), (1, -1)):
        ladder = np.repeat(x[:20], 50, axis=0)
        ladder[:, j] = np.tile(np.linspace(-0.5, 1.5, 50), 20)
        steps = np.diff(model.raw(ladder).reshape(20, 50), axis=1)
        assert (s * steps >= -1e-12).all()
    one = fit_trees(x[:5], np.ones(5), sign)
    assert np.allclose(one.probability(x), 6 / 7) and np.allclose(fit_trees(x[:0], y[:0], sign).probability(x), 0.5)


def test_discriminant_is_the_gaussian_ratio():
    x, y = data()
    d = fit_discriminant(x, y)
    z = (transform(x) - d.centre) / d.scale
    log = []
    for c in (0, 1):
        cov = np.linalg.inv(d.inverse[c].T @ d.inverse[c])
        diff = z - d.means[c]
        log.append(np.log((y == c).mean()) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(d.probability(x), 1 / (1 + np.exp(log[0] - log[1])))
    assert ((d.probability(x) > 0.5) == y).mean() > 0.8
    assert np.allclose(fit_discriminant(x[:3], np.zeros(3)).probability(x), 0.2)


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("crc32(cast(doc_id as string)) % 4 = 2")
    n, right = quality_scores(docs, labels).join(held, "doc_id").agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert right >= 0.9 * n
    n, right = quality_rules(docs, labels).where("not base_failed").join(held, "doc_id").agg(F.count("*"), F.count_if(F.col("kept") == (F.col("quality") == 1))).first()
    assert right >= 0.9 * n


def test_labels_of_the_held_out_fold_teach_nothing(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_edge_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(1, None, 1.0), (2, "", 1.0), (None, "a b", 1.0), (3, "w " * 100000, 1.0), (3, "w " * 100000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    for labelled in (labels, labels.limit(0), labels.unionByName(labels.withColumn("quality", F.lit(None).cast("int")))):
        out = quality_scores(df, labelled).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in out)
        out = {r.doc_id: r for r in quality_rules(df, labelled).collect()}
        assert out[1].base_failed and not out[1].kept and out[2].n_words == 0 and out[3].n_repeat_words == 100000
    assert quality_scores(df.limit(0), labels).count() == 0 and quality_rules(df.limit(0), labels).count() == 0
