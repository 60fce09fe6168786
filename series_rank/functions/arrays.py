"""The same eleven features for series held as array cells, one row per series.

This is the landing layout: every series is one row, so the features are plain
column expressions and need no shuffle at all. A cell is bounded by the size of
the landed file it came from; series of unbounded length use the points layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from series_rank.config import FEATURES


def clean_array(c: Column) -> Column:
    """Array of doubles in which every missing cell is NULL."""
    return F.transform(c, lambda v: F.nanvl(v.cast("double"), F.lit(None).cast("double")))


def first_argmax(c: Column) -> Column:
    """0-based first position of the largest element."""
    return F.array_position(c, F.array_max(c)) - 1


def steps(c: Column) -> Column:
    """Adjacent differences; empty for fewer than two elements."""
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(2), n), F.slice(c, F.lit(1), n), lambda b, a: b - a)


def mean(c: Column) -> Column:
    return F.try_divide(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v), F.size(c).cast("double"))


def std_around(c: Column, centre: Column) -> Column:
    """Population standard deviation around a mean computed beforehand."""
    squares = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + (v - centre) * (v - centre))
    return F.sqrt(F.try_divide(squares, F.size(c).cast("double")))


def count_missing(*arrays: str) -> Column:
    """Number of places at which a cell of any of the array columns is missing; arrays that are NULL have no places."""
    somewhere = " or ".join(f"p.`{a}` is null" for a in arrays)
    zipped = F.expr(f"transform(arrays_zip({', '.join(f'`{a}`' for a in arrays)}), p -> {somewhere})")
    longest = F.expr(f"greatest({', '.join(f'coalesce(size(`{a}`), 0)' for a in arrays)}, 0)")
    return F.when(zipped.isNull(), longest).otherwise(F.size(F.filter(zipped, lambda v: v)))


def array_features(series: DataFrame) -> DataFrame:
    """Add n_points, n_bad, peak_pos, n_fall and the features to a series table.

    ``ratioMax``/``ratioMaxX`` are passed through when the table has them,
    otherwise they are the largest y/d and its x.
    """
    given = {"ratioMax", "ratioMaxX"} <= set(series.columns)
    s = series.withColumns({c: clean_array(F.col(c)) for c in ("x", "y", "d", "m")})
    s = s.withColumns(
        {
            "n_points": F.coalesce(F.size("y"), F.lit(0)).cast("long"),
            "n_bad": count_missing("x", "y", "d", "m").cast("long"),
            "_peak": first_argmax(F.col("y")).cast("int"),
        }
    )
    # Intermediate arrays are columns of their own, so that each is computed once per row. Missing cells
    # have no place in a segment, and a series without any y has no segments.
    peak = F.coalesce(F.col("_peak"), F.lit(0))
    s = s.withColumns(
        {
            "peak_pos": peak.cast("long"),
            "n_fall": F.when(F.col("_peak").isNull(), F.lit(0)).otherwise(F.col("n_points") - F.col("_peak")).cast("long"),
            "_rise_y": F.filter(F.slice("y", F.lit(1), peak), lambda v: v > 0),
            "_fall_y": F.filter(F.slice("y", peak + 1, F.greatest(F.size("y") - peak, F.lit(0))), lambda v: v.isNotNull()),
            "_cost_d": F.transform(
                F.filter(F.slice(F.arrays_zip("x", "d"), F.lit(1), peak), lambda p: (p["x"] >= 0) & p["d"].isNotNull()),
                lambda p: p["d"],
            ),
            "_crossing": F.get(F.filter(F.arrays_zip("x", "m"), lambda p: p["x"] >= 0), F.lit(0)),
        }
    )
    s = s.withColumns({"_rise": steps(F.col("_rise_y")), "_fall": steps(F.col("_fall_y")), "_cost": steps(F.col("_cost_d"))})
    s = s.withColumns({f"{n}_mean": mean(F.col(n)) for n in ("_rise", "_fall", "_cost")})
    if not given:
        ratio = F.zip_with("y", "d", F.try_divide)
        s = s.withColumn("_ratio", ratio).withColumns(
            {
                "ratioMax": F.array_max("_ratio"),
                "ratioMaxX": F.get("x", (F.array_position("_ratio", F.array_max("_ratio")) - 1).cast("int")),
            }
        )
    features = {
        "yMax": F.array_max("y"),
        "yStdRate": std_around(F.col("_rise"), F.col("_rise_mean")),
        "yMeanRate": F.col("_rise_mean"),
        "yStdFallRate": std_around(F.col("_fall"), F.col("_fall_mean")),
        "yMeanFallRate": F.abs("_fall_mean"),
        "dMax": F.array_max("_cost_d"),
        "dStdRate": std_around(F.col("_cost"), F.col("_cost_mean")),
        "dMeanRate": F.col("_cost_mean"),
        "mAtZero": F.abs("_crossing.m"),
    }
    s = s.withColumns({f: features[f] for f in FEATURES if f in features})
    return s.drop(*[c for c in s.columns if c.startswith("_")])
