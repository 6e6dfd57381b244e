"""Vectors as arrays.  Built-in functions only, but for the warping distance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def subset_max(probs: Column, indices: list[int]) -> Column:
    """The greatest of a few classes' probabilities (any of them, not their sum)."""
    return F.array_max(F.transform(F.array(*[F.lit(i) for i in indices]), lambda i: F.get(probs, i)))


def softmax_binary(yes: Column, no: Column) -> Column:
    m = F.greatest(yes, no)
    return F.exp(yes - m) / (F.exp(yes - m) + F.exp(no - m))


def dtw_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping of pairs of runs of unit vectors, ``[pair, frame, value]``: cost 1 - cosine, over the
    longer length.

    A path enters a row of the table from the one above at some frame and follows the row to where it
    leaves, so with the row's running sums a whole row, of all pairs at once, is one running minimum.
    """
    cost = 1.0 - np.einsum("pid,pjd->pij", a, b)
    row = np.cumsum(cost[:, 0], 1)
    for line in cost.transpose(1, 0, 2)[1:]:
        so_far = np.cumsum(line, 1)
        enter = np.minimum(row, np.concatenate([np.full((len(row), 1), np.inf), row[:, :-1]], 1))
        row = so_far + np.minimum.accumulate(enter - so_far + line, 1)
    return row[:, -1] / max(a.shape[1], b.shape[1])


def dtw(a: np.ndarray, b: np.ndarray) -> float:
    return float(dtw_many(a[None], b[None])[0])


def dtw_column(width: int) -> Callable[[Column, Column], Column]:
    """The warping distance of two flat arrays of frames of ``width`` values (frames are normalised first)."""

    def unit(x: np.ndarray) -> np.ndarray:
        f = x.reshape(len(x), -1, width)
        return f / np.maximum(np.linalg.norm(f, axis=2, keepdims=True), 1e-12)

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, a.index, "float64")
        sizes = pd.DataFrame({"a": a.map(len, na_action="ignore"), "b": b.map(len, na_action="ignore")})
        for _, at in sizes.dropna().groupby(["a", "b"]).groups.items():  # pairs of one shape together
            out[at] = dtw_many(*(unit(np.stack(x[at].to_list()).astype(np.float64)) for x in (a, b)))
        return out

    return run
