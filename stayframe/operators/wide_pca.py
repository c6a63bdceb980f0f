"""Principal components of wide tables (E10): randomised range finding by passes over packed rows.

No d x d matrix exists anywhere. A random d x l start (l = k + ``OVERSAMPLE``) is improved by ``iterations`` passes, each a sum of
``x (x . Q)`` over the centred rows (d x l values a task) and an orthonormalisation in the driver. A last pass reduces the
tall matrix of ``x . Q`` to its triangular factor, block by block and task by task (a tree of small QR factorisations),
whose singular values are those of the table on that range. The driver holds d x l values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.operators import blocks as B

OVERSAMPLE = 8


def principal_components(df: DataFrame, features: str | list[str], k: int, iterations: int = 6, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components d x k, shares of the variance they explain, means). Rows with a missing value are left out.
    A component's largest entry is positive."""
    data = B.pack(df.withColumn("_y", F.lit(0.0)), None, features, "_y", (0,))
    d = data.dim
    whole = lambda rows: rows.x[~np.isnan(rows.x).any(1)]
    # sums about a value of each column, so that large means cost no digits
    first = B.summed(data, lambda rows: np.concatenate([whole(rows).sum(0), [len(whole(rows))]]), d + 1)
    n = max(first[-1], 1.0)
    mean = first[:-1] / n
    total = B.summed(data, lambda rows: ((whole(rows) - mean) ** 2).sum(0), d).sum() / n
    size = min(d, k + OVERSAMPLE)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, size)))
    for _ in range(iterations):
        def product(rows: B.Rows, q=q) -> np.ndarray:
            x = whole(rows) - mean
            return (x.T @ (x @ q)).ravel()

        q, _ = np.linalg.qr(B.summed(data, product, d * size).reshape(d, size))

    def factor(rows: B.Rows) -> np.ndarray:
        return _triangle((whole(rows) - mean) @ q)

    r = B.summed(data, factor, size * size, lambda a, b: _triangle(np.concatenate([a.reshape(size, size), b.reshape(size, size)])))
    _, s, vt = np.linalg.svd(r.reshape(size, size))
    parts = (q @ vt.T)[:, :k]
    parts *= np.where(parts[np.abs(parts).argmax(0), np.arange(parts.shape[1])] < 0, -1, 1)
    return parts, s[:k] ** 2 / n / total if total else np.zeros(min(k, size)), mean


def _triangle(x: np.ndarray) -> np.ndarray:
    """The triangular factor of a tall matrix, filled up with zero rows where it has fewer."""
    r = np.linalg.qr(x, mode="r")
    out = np.zeros((x.shape[1], x.shape[1]))
    out[:len(r)] = r
    return out.ravel()


def wide_pca_table(df: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(component, explained_variance), as ``encode.pca_table`` gives them."""
    _, shares, _ = principal_components(df, cols, k)
    return df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(shares)], "component int, explained_variance double")
