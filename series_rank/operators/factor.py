"""Factor analysis of a wide table.

The rows are read by two aggregations (column statistics, then the p x p
correlation inside MLlib); only p x p numbers reach the driver. Fits to a part of
the columns take their block of the same matrix, so any number of fits to one
table costs these two passes. Scores and composites are linear expressions of the columns.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from series_rank.functions.stats import (
    EPSILON,
    ColumnStats,
    column_stats,
    constant_columns,
    linear,
    name,
    number,
    usable_columns,
)

NEAR = 1e-8  # distances below this make factor counts or orders unreliable


def canonical_sign(vectors: np.ndarray) -> np.ndarray:
    """Flip each column so that its component of largest size is positive."""
    lead = np.argmax(np.abs(vectors), axis=0)
    signs = np.sign(vectors[lead, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


@dataclass(frozen=True)
class FactorModel:
    columns: Sequence[str]
    stats: Mapping[str, ColumnStats]
    eigenvalues: np.ndarray  # all p, largest first
    vectors: np.ndarray  # p x p, one column per eigenvalue
    kept: int

    @property
    def shares(self) -> np.ndarray:
        return self.eigenvalues[: self.kept] / len(self.columns)

    @property
    def loadings(self) -> np.ndarray:
        return self.vectors[:, : self.kept] * np.sqrt(self.eigenvalues[: self.kept])

    def _linear(self, coefficients: Sequence[float]) -> Column:
        # z-score and weight of a column fold into one factor
        stats = [self.stats[c] for c in self.columns]
        return linear(
            self.columns, [s.mean for s in stats], [float(w) / (s.std + EPSILON) for w, s in zip(coefficients, stats)]
        )

    def scores(self) -> dict[str, Column]:
        """Regression scores; for retained factors these are z . v / sqrt(eigenvalue)."""
        weights = self.vectors[:, : self.kept] / np.sqrt(self.eigenvalues[: self.kept])
        return {f"factor_{j + 1}": self._linear(weights[:, j]) for j in range(self.kept)}

    def composite(self) -> Column:
        """Scores weighted by variance share, collapsed to one weight per column."""
        return self._linear(self.loadings.sum(axis=1) / len(self.columns))

    def variance_table(self, spark: SparkSession) -> DataFrame:
        rows = zip(range(1, self.kept + 1), self.eigenvalues, self.shares, np.cumsum(self.shares))
        return spark.createDataFrame(
            [(f, float(e), float(s), float(c)) for f, e, s, c in rows],
            "factor long, eigenvalue double, variance double, cumulative double",
        )

    def loadings_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c, j + 1, float(self.loadings[i, j])) for i, c in enumerate(self.columns) for j in range(self.kept)
        ]
        return spark.createDataFrame(rows, "feature string, factor long, loading double")


def _vectors(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """One vector column from the given SQL expressions."""
    assembler = VectorAssembler(inputCols=list(columns), outputCol="_v")
    return assembler.transform(df.selectExpr(*(f"{e} as {name(n)}" for n, e in columns.items()))).select("_v")


def factor_count(eigenvalues: np.ndarray, cap: int) -> int:
    """Eigenvalues above one, at least one, at most the cap."""
    if np.min(np.abs(eigenvalues - 1.0)) < NEAR:
        warnings.warn("an eigenvalue lies at the threshold 1; the factor count is not reliable", stacklevel=3)
    return int(min(max(1, int(np.sum(eigenvalues > 1.0))), cap, len(eigenvalues)))


@dataclass(frozen=True)
class Moments:
    """What every fit to a table needs to know of it."""

    stats: Mapping[str, ColumnStats]
    varying: Sequence[str]
    correlation: np.ndarray  # of the varying columns

    def block(self, columns: Sequence[str]) -> np.ndarray:
        at = [self.varying.index(c) for c in columns]
        return self.correlation[np.ix_(at, at)]


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Two passes: statistics, then the correlation of the columns that vary, centred first so that nothing cancels."""
    stats = column_stats(df, columns)
    constant = set(constant_columns(stats))
    varying = [c for c in columns if c not in constant]
    z = {c: f"({name(c)} - {number(stats[c].mean)}) * {number(1.0 / stats[c].std)}" for c in varying}
    matrix = np.asarray(Correlation.corr(_vectors(df, z), "_v").head()[0].toArray()) if varying else np.empty((0, 0))
    return Moments(stats, varying, matrix)


def fit_factors(
    df: DataFrame, columns: Sequence[str], cap: int, on_constant: str = "error", known: Moments | None = None
) -> FactorModel:
    """Factors of the columns; with the moments of a table that has them, without reading it."""
    if not columns:
        raise ValueError("no columns to factor")
    known = known or moments(df, columns)
    stats = {c: known.stats[c] for c in columns}
    kept_columns = usable_columns(stats, on_constant)
    eigenvalues, vectors = np.linalg.eigh(known.block(kept_columns))
    eigenvalues, vectors = eigenvalues[::-1], canonical_sign(vectors[:, ::-1])
    kept = factor_count(eigenvalues, cap)
    gaps = -np.diff(eigenvalues[: kept + 1])
    if len(gaps) and gaps.min() < NEAR:
        warnings.warn("two retained eigenvalues coincide; their factors are not unique", stacklevel=2)
    return FactorModel(kept_columns, {c: stats[c] for c in kept_columns}, eigenvalues, vectors, kept)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """p x p Pearson correlation, computed over the rows by MLlib."""
    matrix = Correlation.corr(_vectors(df, {c: name(c) for c in columns}), "_v").head()[0]
    return np.asarray(matrix.toArray())


def matrix_table(spark: SparkSession, columns: Sequence[str], matrix: np.ndarray, value: str = "r") -> DataFrame:
    schema = T.StructType(
        [T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField(value, T.DoubleType())]
    )
    rows = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return spark.createDataFrame(rows, schema)
