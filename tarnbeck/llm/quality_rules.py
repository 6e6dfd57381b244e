"""Quality rules: base rules plus gradient-boosted trees over document statistics.

The trees are grown on histograms with Newton steps, kept monotone in chosen features by refusing
splits that go the wrong way and by bounding the children's values, and flattened into numpy arrays
(complete binary trees), so that a batch is scored with a few gathers per level.
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

#: A document may only look worse as these rise.
FALLING = ("symbol_rate", "dup_line_share", "repeat_share", "upper_share", "exclaim_rate", "pipe_rate", "same_next_share")
MOST_LABELLED = 20_000


@dataclass(frozen=True)
class Trees:
    """``feature``, ``threshold``, ``value``: one row per tree, one column per node (children 2i+1, 2i+2)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50)))


def fit_trees(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Boost ``trees`` trees on the logistic loss.  ``sign``: per feature 1, -1 (monotone) or 0.

    With no rows, or one class only, the model is the smoothed share of ones.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base, nodes = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((0, nodes))
        return Trees(none.astype(np.int64), none, none, base, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # x <= cut: left
    width, wide = bins, x.shape[1]
    flat = binned + np.arange(wide) * width
    raw, made = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        feature, threshold, value = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(nodes)
        low, high = np.full(nodes, -np.inf), np.full(nodes, np.inf)
        at = np.zeros(len(y), np.int64)
        value[0] = -g.sum() / (h.sum() + l2)
        for node in range(2**depth - 1):
            mine = np.flatnonzero(at == node)
            left, right = 2 * node + 1, 2 * node + 2
            value[left] = value[right] = value[node]
            low[[left, right]], high[[left, right]] = low[node], high[node]
            if len(mine):
                spots = flat[mine].ravel()
                gs = np.bincount(spots, np.repeat(g[mine], wide), wide * width).reshape(wide, width)
                hs = np.bincount(spots, np.repeat(h[mine], wide), wide * width).reshape(wide, width)
                gl, hl = np.cumsum(gs, 1)[:, :-1], np.cumsum(hs, 1)[:, :-1]
                gt, ht = g[mine].sum(), h[mine].sum()
                gr, hr = gt - gl, ht - hl
                vl, vr = np.clip(-gl / (hl + l2), low[node], high[node]), np.clip(-gr / (hr + l2), low[node], high[node])
                loss = lambda gg, hh, v: gg * v + 0.5 * (hh + l2) * v * v
                gain = loss(gt, ht, value[node]) - loss(gl, hl, vl) - loss(gr, hr, vr)
                gain[(hl < least) | (hr < least) | (sign[:, None] * (vr - vl) < 0)] = -np.inf
                for j, c in enumerate(cuts):
                    gain[j, len(c) :] = -np.inf
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] > 1e-9:
                    feature[node], threshold[node] = j, cuts[j][b]
                    value[left], value[right] = vl[j, b], vr[j, b]
                    if sign[j]:
                        mid = (vl[j, b] + vr[j, b]) / 2
                        lower, upper = (left, right) if sign[j] > 0 else (right, left)
                        high[lower], low[upper] = min(high[lower], mid), max(low[upper], mid)
            at[mine] = np.where(x[mine, feature[node]] > threshold[node], right, left) if len(mine) else at[mine]
        leaf = value * rate
        raw += leaf[at]
        for kept, one in zip(made, (feature, threshold, leaf), strict=True):
            kept.append(one)
    return Trees(*(np.stack(m) for m in made), base, depth)


def quality_rules(docs: DataFrame, labels: DataFrame, label_col: str = "quality", least_words: int = 50, repeat_percent: int = 50, least_probability: float = 0.5, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """Base counts, base rule verdict, tree probability and final verdict for every document.

    A document fails the base rules with fewer than ``least_words`` words or with more than
    ``repeat_percent`` percent of its words in repeated 3-word windows; the others are kept when the
    trees give them ``least_probability`` at least.  The trees learn from at most ``most_labelled``
    labelled rows outside the held-out fold.  Null and empty texts have zero counts (and fail);
    repeated rows give repeated rows; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    stats = materialise(spark, doc_stats(docs), "doc-stats")
    x, y = labelled(stats, labels, label_col, most_labelled)
    model = fit_trees(x, y, np.array([-1 if f in FALLING else 0 for f in FEATURES]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.asarray(b.column(6).flatten(), np.float64).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(model.probability(f))], [*b.schema.names[:6], "probability"])

    scored = stats.mapInArrow(score, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least_probability))
