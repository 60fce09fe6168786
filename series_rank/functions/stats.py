"""Column statistics and normalisations.

A statistic over all rows is fitted with one aggregation whose single result
row (a few numbers per column) comes back to the driver and is put into the
following projection as literals, the way an estimator fits a model. Fit on a
materialised table when the input is expensive.

The columns are summarised as one vector, in one pass whose state is a few
vectors and whose rows stay as many as they are; one aggregate per column and
statistic would outgrow what the JVM can compile. Columns with missing values,
which vectors cannot leave out, go as (column number, value) pairs instead.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

EPSILON = 1e-12  # fixed value: guard in the denominator of the factor z-score


@dataclass(frozen=True)
class ColumnStats:
    n: int
    mean: float | None
    std: float | None  # sample standard deviation
    low: float | None
    high: float | None
    total: float | None


def number(value: float) -> str:
    """A double as SQL text that reads back as the same double."""
    return f"({float(value)!r}D)"


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, v): every value with the number of its column."""
    values = ", ".join(f"cast({name(c)} as double)" for c in columns)
    return df.select(F.expr(f"posexplode(array({values}))").alias("i", "v"))


def literal_array(values: Sequence[float]) -> Column:
    return F.expr(f"array({', '.join(map(number, values))})")


def linear(columns: Sequence[str], centres: Sequence[float], factors: Sequence[float]) -> Column:
    """Sum of (column - centre) * factor, as one SQL expression.

    Text, because a wide sum built from Column objects takes seconds of calls
    between Python and the JVM before anything runs.
    """
    return F.expr(" + ".join(f"({name(c)} - {number(m)}) * {number(w)}" for c, m, w in zip(columns, centres, factors)))


def vector_summary(df: DataFrame, expressions: Sequence[str], metrics: Sequence[str]) -> Row | None:
    """Vector statistics of SQL expressions, NaN where a value is missing; None for a table without rows."""
    cells = ", ".join(f"coalesce(cast({e} as double), double('NaN'))" for e in expressions)
    vectors = df.select(array_to_vector(F.expr(f"array({cells})")).alias("v"))
    # Grouped by a constant, so that a table without rows, which a summary does not take, gives no group.
    row = vectors.groupBy(F.lit(1)).agg(Summarizer.metrics(*metrics).summary(F.col("v")).alias("s")).first()
    return row["s"] if row else None


def column_stats(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    """Count, mean, sample std, min, max and sum of each column in one pass."""
    s = vector_summary(df, [name(c) for c in columns], ("count", "mean", "std", "min", "max", "sum"))
    if s is None:
        return {c: ColumnStats(0, None, None, None, None, None) for c in columns}
    n = s["count"]
    numbers = zip(columns, *(s[m].toArray().tolist() for m in ("mean", "std", "min", "max", "sum")))
    found = {c: ColumnStats(n, mean, std if n > 1 else None, *rest) for c, mean, std, *rest in numbers}
    # Missing or infinite values show in the sums.
    odd = [c for c, f in found.items() if not math.isfinite(f.total) or (f.std is not None and not math.isfinite(f.std))]
    return found | (_stats_of_present(df, odd) if odd else {})


def _stats_of_present(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnStats]:
    functions = (F.count, F.avg, F.stddev_samp, F.min, F.max, F.sum)
    rows = long_values(df, columns).groupBy("i").agg(*(f("v").alias(f"s{n}") for n, f in enumerate(functions))).collect()
    found = {r.i: ColumnStats(*(r[f"s{n}"] for n in range(len(functions)))) for r in rows}
    return {c: found.get(i, ColumnStats(0, None, None, None, None, None)) for i, c in enumerate(columns)}


def constant_columns(stats: Mapping[str, ColumnStats]) -> list[str]:
    return [c for c, s in stats.items() if s.low is None or s.low == s.high]


def usable_columns(stats: Mapping[str, ColumnStats], on_constant: str = "error") -> list[str]:
    """The columns that vary; constant ones raise or, on request, are left out."""
    constant = constant_columns(stats)
    if constant and on_constant == "error":
        raise ValueError(f"constant columns cannot be scaled: {', '.join(constant)}")
    if constant:
        warnings.warn(f"constant columns left out: {', '.join(constant)}", stacklevel=2)
    return [c for c in stats if c not in set(constant)]


def zscore(c: str, s: ColumnStats, epsilon: float = 0.0) -> Column:
    """(c - mean) / (std + epsilon), NULL where that is undefined."""
    if s.std is None or s.std + epsilon == 0:
        return F.lit(None).cast("double")
    return (F.col(c) - F.lit(s.mean)) * F.lit(1.0 / (s.std + epsilon))


def minmax(c: str, s: ColumnStats) -> Column:
    """Scaled to [0, 1]; a constant column becomes 0."""
    if s.low is None or s.low == s.high:
        return F.col(c) * 0
    return (F.col(c) - F.lit(s.low)) * F.lit(1.0 / (s.high - s.low))


def smallest_nonzero(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    rows = long_values(df, columns).where(F.col("v") != 0).groupBy("i").agg(F.min("v").alias("v")).collect()
    found = {r.i: r.v for r in rows}
    return {c: found.get(i) for i, c in enumerate(columns)}


def zero_replace(c: str, smallest: float | None) -> Column:
    """Exact zeros become the smallest non-zero value of the column."""
    return F.when(F.col(c) == 0, F.lit(smallest).cast("double")).otherwise(F.col(c))


def invert(c: str) -> Column:
    return F.try_divide(F.lit(1.0), F.col(c))


def share(c: str, s: ColumnStats) -> Column:
    return F.try_divide(F.col(c), F.lit(s.total).cast("double"))


def variation_weights(stats: Mapping[str, ColumnStats]) -> dict[str, float]:
    """Coefficient of variation of each column, as weights that sum to 1."""
    cv = {c: s.std / s.mean for c, s in stats.items()}
    return normalised(cv)


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {c: w / total for c, w in weights.items()}


@dataclass(frozen=True)
class ScaledModel:
    """Min-max scaling, zero replacement and inversion, with the statistics after them."""

    ranges: Mapping[str, ColumnStats]
    replacement: Mapping[str, float]
    inverted: frozenset[str]
    stats: Mapping[str, ColumnStats]

    @property
    def weights(self) -> dict[str, float]:
        return variation_weights(self.stats)

    def score(self) -> Column:
        """Column shares weighted by their coefficient of variation.

        Range, share and weight of a column fold into one factor.
        """
        terms = []
        for c, w in self.weights.items():
            factor, r = w / self.stats[c].total, self.ranges[c]
            above = f"({name(c)} - {number(r.low)})"
            if c in self.inverted:
                at_low, value = factor / self.replacement[c], f"{number(factor * (r.high - r.low))} / {above}"
            else:
                at_low, value = factor * self.replacement[c], f"{above} * {number(factor / (r.high - r.low))}"
            terms.append(f"if({above} = 0, {number(at_low)}, {value})")
        return F.expr(" + ".join(terms))


def fit_scaled(
    df: DataFrame,
    columns: Sequence[str],
    lower: Sequence[str],
    on_constant: str = "error",
    ranges: Mapping[str, ColumnStats] | None = None,
) -> ScaledModel:
    """Two passes: the ranges, unless they are given, then everything after them.

    The zeros of a scaled column are its minima. Their replacement is only known
    after the second pass, so that pass summarises the other rows, which count as
    nothing in its sums, and the zeros are merged in as that many copies of one
    value. *df* has no missing values in the columns.
    """
    ranges = {c: ranges[c] for c in columns} if ranges is not None else column_stats(df, columns)
    kept = usable_columns(ranges, on_constant)
    ranges = {c: ranges[c] for c in kept}
    inverted = frozenset(lower) & set(kept)
    above = {c: f"({name(c)} - {number(r.low)}) * {number(1.0 / (r.high - r.low))}" for c, r in ranges.items()}
    inverse = [f"coalesce(try_divide(1.0D, {a}), 0.0D)" for a in above.values()]
    values = [i if c in inverted else a for (c, a), i in zip(above.items(), inverse)]
    s = vector_summary(df, [*values, *inverse], ("numNonZeros", "sum", "normL2", "max"))
    p = len(kept)
    present, sums, roots, most = (s[m].toArray().tolist() for m in ("numNonZeros", "sum", "normL2", "max"))
    replacement, stats = {}, {}
    for i, c in enumerate(kept):
        n, others = ranges[c].n, present[i]
        replacement[c] = small = 1.0 / most[p + i]
        at_zero = 1.0 / small if c in inverted else small
        zeros = n - others
        total = sums[i] + zeros * at_zero
        squares = roots[i] ** 2 + zeros * at_zero**2 - total**2 / n
        stats[c] = ColumnStats(n, total / n, math.sqrt(max(squares, 0.0) / (n - 1)), None, None, total)
    return ScaledModel(ranges, replacement, inverted, stats)
