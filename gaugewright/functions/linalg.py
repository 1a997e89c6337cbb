"""Tall-skinny QR over a DataFrame's rows, and what follows from its small factor on the driver.

Each task folds its rows into one p x p factor (R of [R; batch]); the factors are shuffled and folded again in fewer tasks,
so rows are read by as many tasks as they have partitions, and the driver gets a bounded number of factors. Singular values of R are those of the whole matrix, without squaring its condition as a
Gram matrix would.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FOLDS = 8


def _folded(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, width)), 0
        for b in batches:
            if b.num_rows:
                rows = np.asarray(b.column(0).flatten(), float).reshape(-1, width)
                r = np.linalg.qr(np.vstack([r, rows]), mode="r")
                n += int(np.asarray(b.column(1)).sum())
        if len(r):  # rows of a factor without its first, which has the number, may come alone
            yield pa.RecordBatch.from_arrays([pa.array(r.tolist(), pa.list_(pa.float64())), pa.array([n] + [0] * (len(r) - 1), pa.int64())], ["row", "n"])

    return run


def factor(rows: DataFrame, columns: list) -> tuple[np.ndarray, int]:
    """(R, number of rows) of the matrix whose columns are the given Columns; R has at most len(columns) rows."""
    width = len(columns)
    matrix = rows.select(F.array(*columns).alias("row"), F.lit(1).cast("long").alias("n"))
    schema = "row array<double>, n long"
    parts = matrix.mapInArrow(_folded(width), schema).repartition(_FOLDS).mapInArrow(_folded(width), schema).toArrow()
    if not parts.num_rows:
        return np.zeros((0, width)), 0
    stacked = np.array(parts["row"].to_pylist(), float)
    r = np.linalg.qr(stacked, mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if r.shape[0] == width else r, int(sum(parts["n"].to_pylist()))


def least_squares(r: np.ndarray, n: int, inputs: int) -> tuple[np.ndarray, int, np.ndarray]:
    """Minimum-norm coefficients, rank and singular values, from the factor of [inputs | outputs] over n rows."""
    a, b = r[:inputs, :inputs] if len(r) >= inputs else r[:, :inputs], r[:inputs, inputs:] if len(r) >= inputs else r[:, inputs:]
    u, s, v = np.linalg.svd(a, full_matrices=False)
    s_full = s[: min(n, inputs)]
    cut = np.finfo(float).eps * max(n, inputs) * (s[0] if len(s) else 0.0)
    keep = s > cut
    inverse = np.where(keep, 1 / np.where(keep, s, 1), 0)
    return v.T @ (inverse[:, None] * (u.T @ b)), int(keep.sum()), s_full
