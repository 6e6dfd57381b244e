"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each class has its own mean and a covariance shrunk towards the pooled one and towards a multiple of
the identity.  The Cholesky factors are computed once; a score is the logistic of the difference of
the two Gaussian log densities (Mahalanobis distance by triangular solve, and log determinant).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .doc_stats import FEATURES, doc_stats, labelled

MOST_LABELLED = 20_000
#: Features that are shares or rates are spread out by a square root; the logarithmic ones stay.
_ROOT = np.array([not f.startswith("log_") for f in FEATURES])


@dataclass(frozen=True)
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # two rows: class 0, class 1
    inverse: np.ndarray  # inverse Cholesky factors, so that a distance is one matrix product
    constant: np.ndarray  # log prior minus half the log determinant, per class

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = (transform(x) - self.centre) / self.scale
        if not len(self.means):
            return np.full(len(x), self.constant[0])
        log = [self.constant[c] - 0.5 * (((z - self.means[c]) @ self.inverse[c].T) ** 2).sum(1) for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0], -50, 50)))


def transform(x: np.ndarray) -> np.ndarray:
    return np.where(_ROOT, np.sqrt(np.maximum(x, 0)), x)


def fit_discriminant(x: np.ndarray, y: np.ndarray, pooled: float = 0.3, ridge: float = 0.1) -> Discriminant:
    """Fit the two classes.  ``pooled`` and ``ridge`` are the shrinkage weights.

    Where a class has no row the score is the smoothed share of ones.
    """
    t, k = transform(x), x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        return Discriminant(np.zeros(k), np.ones(k), np.zeros((0, k)), np.zeros((0, k, k)), np.array([(y.sum() + 1) / (len(y) + 2)]))
    centre, scale = t.mean(0), np.maximum(t.std(0), 1e-6)
    z = np.clip((t - centre) / scale, -1e6, 1e6)
    of = [z[y == c] for c in (0, 1)]
    means = np.stack([o.mean(0) for o in of])
    own = [((o - m).T @ (o - m)) / max(len(o) - 1, 1) for o, m in zip(of, means, strict=True)]
    within = sum(c * len(o) for c, o in zip(own, of, strict=True)) / len(z)
    inverse, constant = [], []
    for c, o in zip(own, of, strict=True):
        s = (1 - pooled) * c + pooled * within
        s = (1 - ridge) * s + ridge * max(np.trace(s) / k, 1e-6) * np.eye(k)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        constant.append(np.log(len(o) / len(z)) - np.log(np.diag(factor)).sum())
    return Discriminant(centre, scale, means, np.stack(inverse), np.array(constant))


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", least_score: float = 0.7, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    The model learns from at most ``most_labelled`` labelled rows outside the held-out fold (a
    documented bound; the counts themselves cover whole texts).  Null and empty texts are scored as
    texts without words; repeated rows give repeated rows; other columns are ignored.
    """
    stats = materialise(docs.sparkSession, doc_stats(docs), "doc-stats")
    model = fit_discriminant(*labelled(stats, labels, label_col, most_labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.probability(f))], ["doc_id", "score"])

    scored = stats.select("doc_id", "features").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 4 = 2, false)").alias("held_out"), "score", (F.col("score") >= least_score).cast("int").alias("predicted"))
