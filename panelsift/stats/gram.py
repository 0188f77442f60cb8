"""Cross-product matrix of many columns in one distributed pass.

What comes to the driver is one k x k matrix, whatever the number of rows; VIFs,
their iterative removal, correlations and the linear model are algebra on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelsift.columns import all_of

# up to this many columns plain sums stay inside generated code
SQL_COLUMNS = 12
# eigenvalues of the scaled matrix below this count as exact collinearity
SINGULAR = 1e-10


@dataclass
class Gram:
    """Cross products of named columns and of the constant 1, over complete rows.

    ``centred`` holds the products about the means. It is summed on values near their
    mean, so an offset many times a column's spread does not use up its digits.
    """

    names: list[str]
    n: float
    sums: np.ndarray
    products: np.ndarray
    centred: np.ndarray

    def keep(self, names: Sequence[str]) -> Gram:
        at = [self.names.index(name) for name in names]
        cut = np.ix_(at, at)
        return Gram(list(names), self.n, self.sums[at], self.products[cut], self.centred[cut])

    def correlations(self) -> np.ndarray:
        width = np.sqrt(np.clip(np.diag(self.centred), 0, None))
        width[width == 0] = np.nan
        return self.centred / np.outer(width, width)


def _about(names: list[str], n: float, sums: np.ndarray, products: np.ndarray, pilot: np.ndarray | None) -> Gram:
    """Gram matrix from sums of values less a pilot mean."""
    means = sums / n if n else sums
    centred = products - n * np.outer(means, means)
    whole = means if pilot is None else means + pilot
    return Gram(names, n, n * whole, centred + n * np.outer(whole, whole), centred)


def gram_matrix(df: DataFrame, columns: dict[str, Column]) -> Gram:
    """Gram matrix of the given expressions over rows where none is missing."""
    names = list(columns)
    values = {
        f"__x{i}": F.nanvl(col.cast("double"), F.lit(None).cast("double"))
        for i, col in enumerate(columns.values())
    }
    rows = df.select(*[col.alias(n) for n, col in values.items()])
    rows = rows.where(all_of([F.col(n).isNotNull() for n in values]))
    means = rows.agg(*[F.avg(n) for n in values]).first() if values else []
    pilot = np.array([0.0 if m is None else float(m) for m in means])
    rows = rows.select(*[(F.col(n) - F.lit(m)).alias(n) for n, m in zip(values, pilot.tolist())])
    if len(names) <= SQL_COLUMNS:
        return _by_sums(rows, names, list(values), pilot)
    return _by_row_matrix(rows, names, list(values), pilot)


def _by_sums(rows: DataFrame, names: list[str], columns: list[str], pilot: np.ndarray | None = None) -> Gram:
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = rows.agg(
        F.count(F.lit(1)),
        *[F.sum(n) for n in columns],
        *[F.sum(F.col(columns[i]) * F.col(columns[j])) for i, j in pairs],
    ).first()
    cells = [0.0 if v is None else float(v) for v in row]
    products = np.zeros((k, k))
    for (i, j), v in zip(pairs, cells[1 + k :]):
        products[i, j] = products[j, i] = v
    return _about(names, cells[0], np.array(cells[1 : 1 + k]), products, pilot)


def _by_row_matrix(rows: DataFrame, names: list[str], columns: list[str], pilot: np.ndarray | None = None) -> Gram:
    with_one = rows.withColumn("__one", F.lit(1.0))
    vectors = VectorAssembler(inputCols=["__one", *columns], outputCol="v").transform(with_one)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select("v"), "v"))
    full = matrix.computeGramianMatrix().toArray()
    return _about(names, float(full[0, 0]), full[0, 1:].copy(), full[1:, 1:].copy(), pilot)


def scaled_inverse(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Pseudo-inverse of a positive semidefinite matrix, and which columns are redundant.

    Columns are brought to unit length first. A column is redundant when it takes
    part in an exact linear dependency. Also returns the rank.
    """
    size = np.sqrt(np.clip(np.diag(matrix), 0, None))
    usable = size > 0
    safe = np.where(usable, size, 1.0)
    values, vectors = np.linalg.eigh(matrix / np.outer(safe, safe))
    cut = SINGULAR * max(float(values[-1]), 1.0)
    kept = values > cut
    inverse = (vectors[:, kept] / values[kept]) @ vectors[:, kept].T
    redundant = (vectors[:, ~kept] ** 2).sum(axis=1) > 1e-8
    return inverse / np.outer(safe, safe), redundant | ~usable, int(kept.sum())
