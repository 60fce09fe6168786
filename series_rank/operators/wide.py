"""Wide feature table: pivot, completeness, attributes, range filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from series_rank.config import FEATURES, LOWER_BETTER, MIN_FALL_POINTS, Bounds, feature_columns
from series_rank.operators.gate import entity_reason, gate_aggregates, regime_order
from series_rank.session import materialize


def wide_aggregates(series: DataFrame, regimes: Sequence[str], features: Sequence[str] = FEATURES) -> list[Column]:
    """Per entity and listed regime, the record of its series row (the largest ``seq`` wins)."""
    record = F.struct(*features)
    picked = []
    for r in regimes:
        here = F.col("regime") == r
        if "seq" in series.columns:
            picked.append(F.max_by(F.when(here, record), F.when(here, F.col("seq"))).alias(r))
        else:
            picked.append(F.first(F.when(here, record), ignorenulls=True).alias(r))
    return picked


def wide_select(regimes: Sequence[str], features: Sequence[str] = FEATURES) -> list[Column]:
    return [F.expr(f"`{r}`.`{f}` as `{r}_{f}`") for r in regimes for f in features]


def to_wide(series: DataFrame, regimes: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """One row per entity with ``<regime>_<feature>`` columns for the listed regimes."""
    wide = series.where(F.col("entity").isNotNull()).groupBy("entity").agg(*wide_aggregates(series, regimes, features))
    return wide.select("entity", *wide_select(regimes, features))


def entity_table(
    series: DataFrame,
    regimes: Sequence[str],
    min_series: int | None = None,
    min_fall_points: int = MIN_FALL_POINTS,
) -> DataFrame:
    """Gate and pivot in one grouping: wide features, and in ``gate`` why the entity is invalid (or NULL)."""
    grouped = (
        series.where(F.col("entity").isNotNull())
        .groupBy("entity")
        .agg(*gate_aggregates(series, regimes, min_fall_points), *wide_aggregates(series, regimes))
    )
    return grouped.select("entity", entity_reason(regimes, min_series).alias("gate"), *wide_select(regimes))


def present(columns: Sequence[str]) -> Column:
    """No listed column is missing.

    One small condition per column: the optimizer derives filters from them one
    by one, where a single condition over many columns (``dropna``) makes it try
    every combination of their aliases.
    """
    return F.expr(" and ".join(f"`{c}` is not null" for c in columns))


def complete_features(entities: DataFrame, regimes: Sequence[str]) -> DataFrame:
    """Valid entities with every feature."""
    return entities.where(F.col("gate").isNull() & present(feature_columns(regimes))).drop("gate")


def entity_rejects(entities: DataFrame, regimes: Sequence[str]) -> DataFrame:
    """(entity, stage, reason): stage ``validation`` for the gate, ``features`` for a missing feature."""
    incomplete = missing_reason(feature_columns(regimes))
    return entities.select(
        "entity",
        F.when(F.col("gate").isNotNull(), "validation").otherwise("features").alias("stage"),
        F.coalesce("gate", incomplete).alias("reason"),
    ).where(F.col("reason").isNotNull())


def missing_reason(columns: Sequence[str]) -> Column:
    """Names the first missing column, NULL when the row is complete."""
    # "c is null" per column as text: hundreds of Column objects are slow to build
    return F.expr("case " + " ".join(f"when `{c}` is null then 'missing {c}'" for c in columns) + " end")


def drop_incomplete(wide: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows, rejects of stage ``features``)."""
    reason = missing_reason(columns)
    failed = wide.where(reason.isNotNull()).select("entity", F.lit("features").alias("stage"), reason.alias("reason"))
    return wide.where(present(columns)), failed


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coerce the columns to double and keep the rows without a missing value."""
    types = dict(df.dtypes)
    coerced = df.withColumns({c: F.col(c).try_cast("double") for c in columns if types[c] != "double"})
    return coerced.where(present(columns) & F.expr(" and ".join(f"not isnan(`{c}`)" for c in columns)))


def feature_projection(df: DataFrame, meta: Sequence[str]) -> list[str]:
    """Every column except the named ones, in table order."""
    return [c for c in df.columns if c not in set(meta)]


def direction_split(columns: Sequence[str], lower: Sequence[str] = LOWER_BETTER) -> tuple[list[str], list[str]]:
    """(lower-is-better, higher-is-better) columns, by the feature that a column name ends in."""
    below = {c: c.rpartition("_")[2] in lower for c in columns}
    return [c for c in columns if below[c]], [c for c in columns if not below[c]]


def first_per_key(df: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The columns of the first row of each key, by an explicit order."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(picked).select(key, *(F.col(f"r.{c}") for c in columns))


def series_attributes(series: DataFrame, regimes: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Attributes of an entity, taken from its first series row."""
    order = [regime_order(regimes), F.col("regime")] + ([F.col("seq")] if "seq" in series.columns else [])
    return first_per_key(series, "entity", columns, order)


def attach_attributes(features: DataFrame, attributes: DataFrame) -> DataFrame:
    return features.join(attributes, "entity", "left")


def range_reason(bounds: Sequence[Bounds]) -> Column:
    """``<column> < <v>`` or ``<column> > <v>`` of the first limit that fails, else NULL."""
    checks = [F.lit(None).cast("string")]
    for b in bounds:
        if b.low is not None:
            checks.append(F.when(F.col(b.column) < b.low, F.lit(f"{b.column} < {b.low}")))
        if b.high is not None:
            checks.append(F.when(F.col(b.column) > b.high, F.lit(f"{b.column} > {b.high}")))
    return F.coalesce(*checks)


def range_filter(df: DataFrame, bounds: Sequence[Bounds]) -> DataFrame:
    """Rows inside every limit. Plain comparisons, so they reach the scan."""
    for b in bounds:
        if b.low is not None:
            df = df.where(F.col(b.column) >= b.low)
        if b.high is not None:
            df = df.where(F.col(b.column) <= b.high)
    return df


def _tagged(joined: DataFrame, earlier: Sequence[tuple[str, Column]], required: Sequence[str], bounds: Sequence[Bounds]) -> DataFrame:
    """Add the first (stage, reason) for which a row is rejected, and whether it is kept."""
    absent = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    checks = [*earlier, ("attributes", F.coalesce(F.lit(None).cast("string"), *absent)), ("range", range_reason(bounds))]
    failed = F.coalesce(*(F.when(r.isNotNull(), F.struct(F.lit(s).alias("stage"), r.alias("reason"))) for s, r in checks))
    columns = joined.columns
    found = joined.withColumn("_failed", failed)
    return found.select(*columns, F.col("_failed.stage"), F.col("_failed.reason"), F.col("_failed").isNull().alias("kept"))


def tag_entities(
    entities: DataFrame, regimes: Sequence[str], attributes: DataFrame | None, required: Sequence[str], bounds: Sequence[Bounds]
) -> DataFrame:
    """Every entity with its features and attributes, and why it is rejected: ``stage``, ``reason``, ``kept``.

    One join and one pass for the kept and the rejected; without attributes only the gate and the features decide.
    """
    checks = [("validation", F.col("gate")), ("features", missing_reason(feature_columns(regimes)))]
    joined = entities if attributes is None else attach_attributes(entities, attributes)
    return _tagged(joined, checks, *((required, bounds) if attributes is not None else ((), ()))).drop("gate")


def split_tagged(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejects) of a tagged table. Save it first: each side reads it again."""
    kept = tagged.where("kept").drop("stage", "reason", "kept")
    return kept, tagged.where("not kept").select("entity", "stage", "reason")


def tag_attributes(features: DataFrame, attributes: DataFrame, required: Sequence[str], bounds: Sequence[Bounds]) -> DataFrame:
    """Features with attributes, and why the attributes reject a row: ``stage``, ``reason``, ``kept``."""
    return _tagged(attach_attributes(features, attributes), (), required, bounds)


def filter_attributes(
    features: DataFrame, attributes: DataFrame, required: Sequence[str], bounds: Sequence[Bounds]
) -> tuple[DataFrame, DataFrame]:
    """(kept features with attributes, rejects of the stages attributes and range), joined once and saved."""
    return split_tagged(materialize(tag_attributes(features, attributes, required, bounds), "tagged"))


def missing_attribute_report(joined: DataFrame, column: str, sample: int = 10) -> DataFrame:
    """Number of entities without the attribute and the first few of them, in one row."""
    missing = joined.where(F.col(column).isNull()).select("entity")
    names = missing.orderBy("entity").limit(sample).agg(F.array_sort(F.collect_list("entity")).alias("first_entities"))
    # Two one-row tables, put side by side as a scalar subquery would.
    total = missing.agg(F.count(F.lit(1)).alias("n_missing")).withColumn("k", F.lit(0))
    return total.join(F.broadcast(names.withColumn("k", F.lit(0))), "k").drop("k")

