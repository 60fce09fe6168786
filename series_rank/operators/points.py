"""Shape features of ordered series held as points, one row per point.

Columns of a points table: ``entity``, ``regime``, ``ord`` (any orderable
value, total within a series), ``x``, ``y``, ``d``, ``m`` and optionally the
given ``ratioMax``/``ratioMaxX`` of the series.

An ordinary series is sorted and summarised inside one task. A series above
``hot_rows`` points is cut into pieces at values of its own order; each piece is
summarised on its own and the summaries are merged, with the one step that
crosses a cut added back, so that no task ever holds the whole series. The cuts
are a small saved table, so every pass and every repeated task cuts alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from series_rank.config import FEATURES
from series_rank.session import materialize

SERIES = ["entity", "regime"]
HOT_ROWS = 4_000_000
MAX_PIECES = 500_000  # of all hot series; beyond it pieces grow, so that the broadcast table of cuts does not
SAMPLE_PER_CUT = 16  # values a cut is chosen from
SEGMENTS = ("rise", "fall", "cost")
STATS = ["n_points", "n_bad", "peak_pos", "n_fall"]


def missing_if_nan(c: Column) -> Column:
    """NaN and NULL both mean missing; NULL is the only form kept."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def as_points(
    df: DataFrame,
    entity: Column,
    regime: Column,
    order: Sequence[Column],
    x: Column,
    y: Column,
    d: Column,
    m: Column,
    ratio_max: Column | None = None,
    ratio_max_x: Column | None = None,
) -> DataFrame:
    """Bind a table to the points layout; rows without an entity are dropped."""
    cols = [
        entity.alias("entity"),
        regime.cast("string").alias("regime"),
        (order[0] if len(order) == 1 else F.struct(*order)).alias("ord"),
        *(missing_if_nan(c).alias(n) for n, c in (("x", x), ("y", y), ("d", d), ("m", m))),
    ]
    if ratio_max is not None:
        cols += [missing_if_nan(ratio_max).alias("ratioMax"), missing_if_nan(ratio_max_x).alias("ratioMaxX")]
    return df.where(entity.isNotNull()).select(*cols)


def _peak() -> Column:
    # Smallest (-y, ord): the largest y, and its first place on ties.
    return F.min(F.when(F.col("y").isNotNull(), F.struct((-F.col("y")).alias("ny"), F.col("ord").alias("at"))))


def mark_segments(points: DataFrame) -> DataFrame:
    """Values of the points that belong to each segment, given the ``peak`` struct."""
    before = F.col("ord") < F.col("peak.at")
    return points.withColumns(
        {
            "before": before,
            "rise": F.when(before & (F.col("y") > 0), F.col("y")),
            "fall": F.when(~before, F.col("y")),
            "cost": F.when(before & (F.col("x") >= 0), F.col("d")),
        }
    )


def segment_steps(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference to the previous point *of the same segment*, within ``keys``."""
    earlier = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumns(
        {f"{s}_step": F.col(s) - F.last(s, ignorenulls=True).over(earlier) for s in SEGMENTS}
    )


def _ratio(points: DataFrame) -> Column:
    """(-ratio, place, x) of a point; the smallest is the first largest ratio. Given ratios are passed through."""
    if "ratioMax" in points.columns:
        return F.struct((-F.col("ratioMax")).alias("nr"), F.col("ord").alias("at"), F.col("ratioMaxX").alias("x"))
    r = F.try_divide("y", "d")
    return F.when(r.isNotNull(), F.struct((-r).alias("nr"), F.col("ord").alias("at"), F.col("x").alias("x")))


def _crossing() -> Column:
    """(place, m) of a point right of zero; the smallest is the first crossing."""
    return F.when(F.col("x") >= 0, F.struct(F.col("ord").alias("at"), F.col("m").alias("m")))


def _counts() -> list[Column]:
    bad = F.col("x").isNull() | F.col("y").isNull() | F.col("d").isNull() | F.col("m").isNull()
    return [
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(bad).alias("n_bad"),
        F.count_if("before").alias("peak_pos"),
        F.count_if(~F.col("before")).alias("n_fall"),
        F.max("cost").alias("dMax"),
    ]


def _feature_select(extra: Sequence[str] = ()) -> list[Column]:
    expressions = {
        "ratioMax": -F.col("nr"),
        "ratioMaxX": F.col("rx"),
        "yMax": -F.col("ny"),
        "yStdRate": F.col("rise_std"),
        "yMeanRate": F.col("rise_mean"),
        "yStdFallRate": F.col("fall_std"),
        "yMeanFallRate": F.abs("fall_mean"),
        "dMax": F.col("dMax"),
        "dStdRate": F.col("cost_std"),
        "dMeanRate": F.col("cost_mean"),
        "mAtZero": F.abs("cm"),
    }
    return [
        *(F.col(c) for c in SERIES),
        *(F.col(c) for c in extra),
        *(F.col(c) for c in STATS),
        # "+ 0.0" turns a negative zero into a plain one
        *((expressions[f] + F.lit(0.0)).alias(f) for f in FEATURES),
    ]


def _features_of_ordinary(points: DataFrame) -> DataFrame:
    whole = Window.partitionBy(*SERIES).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Shuffled and sorted here and not by the window, which would move its structs (ord again) along.
    together = points.repartition(*SERIES).sortWithinPartitions(*SERIES, "ord")
    placed = together.withColumns(
        {"peak": _peak().over(whole), "ratio": F.min(_ratio(points)).over(whole), "crossing": F.min(_crossing()).over(whole)}
    )
    steps = segment_steps(mark_segments(placed), SERIES)
    # Only plain numbers are aggregated, which keeps the grouping a compiled hash aggregate.
    constants = {"ny": "peak.ny", "nr": "ratio.nr", "rx": "ratio.x", "cm": "crossing.m"}
    steps = steps.withColumns({n: F.col(c) for n, c in constants.items()})
    moments = [
        agg(f"{s}_step").alias(f"{s}_{name}") for s in SEGMENTS for name, agg in (("mean", F.avg), ("std", F.stddev_pop))
    ]
    firsts = [F.first(n).alias(n) for n in constants]
    return steps.groupBy(*SERIES).agg(*_counts(), *firsts, *moments).select(*_feature_select())


def _same_series(suffix: str = "hot") -> Column:
    # Null-safe: a series without a regime is a series as well.
    return (F.col("entity") == F.col(f"{suffix}_entity")) & F.col("regime").eqNullSafe(F.col(f"{suffix}_regime"))


def _hot_series(points: DataFrame, hot_rows: int) -> tuple[DataFrame, int] | None:
    """(hot_entity, hot_regime, n) of the series to cut, at most MAX_PIECES / 2, and the most points of a piece."""
    sizes = points.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = materialize(sizes.toDF("hot_entity", "hot_regime", "n"), "hot-series")
    total = hot.agg(F.sum("n")).first()[0]
    if total is None:
        return None
    most = max(hot_rows, -(-2 * total // MAX_PIECES))
    return hot.where(F.col("n") > most), most


def cut_points(points: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """(hot_entity, hot_regime, pieces, coarse, fine, peak) of every hot series, from one pass over their points.

    The cuts are quantiles of values drawn by a hash. They are held in two levels:
    ``fine`` has them in groups of equal size and ``coarse`` the first of each
    group, so that a point is placed by comparing it with the root of their number, twice.
    """
    here = points.join(F.broadcast(hot), _same_series())
    pieces = F.ceil(F.col("n") * 2 / F.lit(most)).cast("int")
    one_in = F.greatest(F.lit(1), F.floor(F.col("n") / (pieces * SAMPLE_PER_CUT)).cast("long"))
    drawn = F.when(F.pmod(F.xxhash64("ord"), one_in) == 0, F.col("ord"))
    grouped = here.groupBy("hot_entity", "hot_regime", "n").agg(
        _peak().alias("peak"), F.array_sort(F.collect_list(drawn)).alias("drawn")
    )
    grouped = grouped.withColumn("pieces", pieces).withColumn("width", F.ceil(F.sqrt("pieces")).cast("int"))
    cuts = """array_distinct(transform(filter(sequence(1, pieces), j -> j < pieces and size(drawn) > 0),
        j -> drawn[cast(floor(cast(size(drawn) as bigint) * j / pieces) as int)]))"""
    grouped = grouped.withColumn("cuts", F.expr(cuts))
    groups = "filter(transform(sequence(0, width), g -> slice(cuts, g * width + 1, width)), g -> size(g) > 0)"
    return grouped.withColumn("fine", F.expr(groups)).select(
        "hot_entity", "hot_regime", "pieces", "width", F.expr("transform(fine, g -> g[0])").alias("coarse"), "fine", "peak"
    )


def with_piece(points: DataFrame) -> DataFrame:
    """Add ``piece``, the number of cuts up to the point: all of the groups before its own, and those inside it."""
    grouped = points.withColumn("_group", F.expr("size(filter(coarse, c -> c <= ord)) - 1"))
    inside = F.expr("if(_group < 0, 0, _group * width + size(filter(fine[_group], c -> c <= ord)))")
    return grouped.withColumn("piece", inside).drop("_group")


def _features_of_hot(points: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    spark = points.sparkSession
    cuts = materialize(cut_points(points, hot, most), "series-cuts")
    cut = with_piece(points.join(F.broadcast(cuts.drop("peak", "pieces")), _same_series()))
    keys = [*SERIES, "piece"]
    # Small pieces share partitions of the usual number; large ones have as many as they need.
    rows = hot.agg(F.sum("n")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * rows // max(most, HOT_ROWS)))
    placed = cut.select(*points.columns, "piece").repartition(parts, *keys)
    # Joined after the exchange, which then moves the bare points only.
    placed = placed.join(F.broadcast(cuts.select("hot_entity", "hot_regime", "peak")), _same_series()).drop("hot_entity", "hot_regime")
    placed = placed.sortWithinPartitions(*keys, "ord")
    steps = segment_steps(mark_segments(placed), keys)

    per_piece = []
    for s in SEGMENTS:
        step, kept = F.col(f"{s}_step"), F.when(F.col(s).isNotNull(), F.col("ord"))
        per_piece += [
            F.count(step).alias(f"{s}_n"),
            F.avg(step).alias(f"{s}_avg"),
            F.var_pop(step).alias(f"{s}_var"),
            F.min_by(s, kept).alias(f"{s}_first"),
            F.max_by(s, kept).alias(f"{s}_last"),
        ]
    extremes = [
        F.min("peak.ny").alias("ny"),
        F.min(_ratio(points)).alias("ratio"),
        F.min(_crossing()).alias("crossing"),
    ]
    summary = steps.groupBy(*SERIES, "piece").agg(*_counts(), *extremes, *per_piece)

    # The step that crosses a cut: first kept point here minus last kept point of any earlier piece.
    by_piece = Window.partitionBy(*SERIES).orderBy("piece")
    earlier = by_piece.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_piece.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summary = summary.withColumns(
        {f"{s}_edge": F.col(f"{s}_first") - F.last(f"{s}_last", ignorenulls=True).over(earlier) for s in SEGMENTS}
    )
    means = {}
    for s in SEGMENTS:
        total = F.sum(F.coalesce(F.col(f"{s}_n") * F.col(f"{s}_avg"), F.lit(0.0)) + F.coalesce(f"{s}_edge", F.lit(0.0)))
        steps_n = F.sum(F.col(f"{s}_n")).over(whole) + F.count(f"{s}_edge").over(whole)
        means[f"{s}_steps"] = steps_n
        means[f"{s}_mean"] = F.try_divide(total.over(whole), steps_n)
    summary = summary.withColumns(means)

    merged = [
        F.sum("n_points").alias("n_points"),
        F.sum("n_bad").alias("n_bad"),
        F.sum("peak_pos").alias("peak_pos"),
        F.sum("n_fall").alias("n_fall"),
        F.min("ny").alias("ny"),
        F.max("dMax").alias("dMax"),
        F.min("crossing").getField("m").alias("cm"),
        F.min("ratio").getField("nr").alias("nr"),
        F.min("ratio").getField("x").alias("rx"),
    ]
    for s in SEGMENTS:
        n, avg, var, edge, mean = (F.col(f"{s}_{p}") for p in ("n", "avg", "var", "edge", "mean"))
        spread = F.coalesce(n * (var + (avg - mean) * (avg - mean)), F.lit(0.0)) + F.coalesce(
            (edge - mean) * (edge - mean), F.lit(0.0)
        )
        merged += [
            F.first(mean).alias(f"{s}_mean"),
            F.sqrt(F.try_divide(F.sum(spread), F.first(f"{s}_steps"))).alias(f"{s}_std"),
        ]
    return summary.groupBy(*SERIES).agg(*merged).select(*_feature_select())


def series_features(points: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """One row per series: point counts, peak position and the eleven features.

    ``hot_rows`` is the largest series one task may hold. Finding the larger
    ones costs a scan of the two key columns; None skips it where the layout
    already bounds the length of a series.
    """
    if hot_rows is None:
        return _features_of_ordinary(points)
    found = _hot_series(points, hot_rows)
    if found is None:
        return _features_of_ordinary(points)
    hot, most = found
    ordinary = points.join(F.broadcast(hot), _same_series(), "left_anti")
    return _features_of_ordinary(ordinary).unionByName(_features_of_hot(points, hot, most))
