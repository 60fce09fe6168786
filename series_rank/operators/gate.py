"""Entity-level validation: one bad series removes the entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from series_rank.config import MIN_FALL_POINTS

REJECT_COLUMNS = ["entity", "stage", "reason"]


def regime_order(regimes: Sequence[str], regime: Column | None = None) -> Column:
    """Position of a regime in the requested list; unlisted regimes come last."""
    c = F.col("regime") if regime is None else regime
    pos = F.array_position(F.array(*(F.lit(r) for r in regimes)), c)
    return F.when(F.coalesce(pos, F.lit(0)) > 0, pos - 1).otherwise(F.lit(len(regimes))).cast("int")


def series_reason(min_fall_points: int = MIN_FALL_POINTS) -> Column:
    """Why one series fails, or NULL. Needs n_points, n_bad and n_fall."""
    where = F.concat(F.lit(" (regime="), F.coalesce("regime", F.lit("")), F.lit(")"))
    return (
        F.when(F.col("n_points") == 0, F.concat(F.lit("empty series"), where))
        .when(F.col("n_bad") > 0, F.concat(F.lit("non-numeric values in series"), where))
        .when(F.col("n_fall") < min_fall_points, F.concat(F.lit("insufficient fall region"), where))
    )


def gate_aggregates(series: DataFrame, regimes: Sequence[str], min_fall_points: int) -> list[Column]:
    """Per entity: number of series, and the first failing one in (regime order, seq)."""
    reason = series_reason(min_fall_points)
    order = [regime_order(regimes).alias("o"), F.col("regime").alias("r")]
    if "seq" in series.columns:
        order.append(F.col("seq").alias("s"))
    failing = F.when(reason.isNotNull(), F.struct(*order, reason.alias("reason")))
    return [F.count(F.lit(1)).alias("n_series"), F.min(failing).alias("failing")]


def entity_reason(regimes: Sequence[str], min_series: int | None = None) -> Column:
    """Too few series (by default, fewer than regimes) goes before any reason of a single one."""
    min_series = len(regimes) if min_series is None else min_series
    few = F.when(F.col("n_series") < min_series, F.lit(f"fewer than {min_series} regimes available"))
    return F.coalesce(few, F.col("failing.reason"))


def validate(
    series: DataFrame,
    regimes: Sequence[str],
    min_series: int | None = None,
    min_fall_points: int = MIN_FALL_POINTS,
) -> DataFrame:
    """One row per entity: ``n_series`` and ``reason`` (NULL for a valid entity).

    Series of unlisted regimes count like the others; rows without an entity are ignored.
    """
    checked = (
        series.where(F.col("entity").isNotNull())
        .groupBy("entity")
        .agg(*gate_aggregates(series, regimes, min_fall_points))
    )
    return checked.select("entity", "n_series", entity_reason(regimes, min_series).alias("reason"))


def rejects(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNotNull()).select("entity", F.lit("validation").alias("stage"), "reason")


def valid_entities(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reason").isNull()).select("entity")
