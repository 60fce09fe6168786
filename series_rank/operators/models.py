"""Fitted models as tables: saved with the run that fitted them, read back, applied to other rows.

    factor_models  a row per fit, factor and column: statistics of the column, eigenvalue, component
    scaled_models  a row per fit and column: range, replacement of zeros, direction, statistics

Both are as large as the fits themselves (columns x columns, columns), whatever the
number of rows they were fitted to.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from series_rank.functions.stats import ColumnStats, ScaledModel
from series_rank.operators.factor import FactorModel

FACTOR_MODELS = (
    "fit string, factor long, eigenvalue double, kept boolean, place long, feature string, component double, "
    "n long, mean double, std double, low double, high double, total double"
)
SCALED_MODELS = (
    "fit string, place long, feature string, low double, high double, replacement double, inverted boolean, "
    "n long, mean double, std double, total double"
)


def factor_table(spark: SparkSession, models: Mapping[str, FactorModel]) -> DataFrame:
    rows = []
    for fit, m in models.items():
        for j, eigenvalue in enumerate(m.eigenvalues.tolist()):
            for i, c in enumerate(m.columns):
                s = m.stats[c]
                rows.append(
                    (fit, j + 1, eigenvalue, j < m.kept, i, c, float(m.vectors[i, j]), s.n, s.mean, s.std, s.low, s.high, s.total)
                )
    return spark.createDataFrame(rows, FACTOR_MODELS)


def factor_models(table: DataFrame) -> dict[str, FactorModel]:
    by_fit = defaultdict(list)
    for r in table.orderBy("fit", "factor", "place").collect():  # columns x columns of each fit
        by_fit[r.fit].append(r)
    out = {}
    for fit, rows in by_fit.items():
        first = [r for r in rows if r.factor == 1]
        columns = [r.feature for r in first]
        stats = {r.feature: ColumnStats(r.n, r.mean, r.std, r.low, r.high, r.total) for r in first}
        vectors = np.array([r.component for r in rows]).reshape(-1, len(columns)).T
        lead = [r for r in rows if r.place == 0]
        kept = sum(r.kept for r in lead)
        out[fit] = FactorModel(columns, stats, np.array([r.eigenvalue for r in lead]), vectors, kept)
    return out


def scaled_table(spark: SparkSession, models: Mapping[str, ScaledModel]) -> DataFrame:
    rows = []
    for fit, m in models.items():
        for i, (c, s) in enumerate(m.stats.items()):
            r = m.ranges[c]
            rows.append((fit, i, c, r.low, r.high, m.replacement[c], c in m.inverted, s.n, s.mean, s.std, s.total))
    return spark.createDataFrame(rows, SCALED_MODELS)


def scaled_models(table: DataFrame) -> dict[str, ScaledModel]:
    by_fit = defaultdict(list)
    for r in table.orderBy("fit", "place").collect():  # one row a column
        by_fit[r.fit].append(r)
    return {
        fit: ScaledModel(
            {r.feature: ColumnStats(r.n, None, None, r.low, r.high, None) for r in rows},
            {r.feature: r.replacement for r in rows},
            frozenset(r.feature for r in rows if r.inverted),
            {r.feature: ColumnStats(r.n, r.mean, r.std, None, None, r.total) for r in rows},
        )
        for fit, rows in by_fit.items()
    }


def explained(table: DataFrame) -> DataFrame:
    """(fit, above_one, kept, explained): the factors of every fit and the share of variance that those kept explain."""
    each = table.where("place = 0").join(table.where("factor = 1").groupBy("fit").agg(F.count(F.lit(1)).alias("p")), "fit")
    return each.groupBy("fit").agg(
        F.count_if(F.col("eigenvalue") > 1).alias("above_one"),
        F.count_if("kept").alias("kept"),
        F.sum(F.when(F.col("kept"), F.col("eigenvalue") / F.col("p"))).alias("explained"),
    )


def score_rows(features: DataFrame, factors: Mapping[str, FactorModel], scaled: Mapping[str, ScaledModel]) -> DataFrame:
    """Scores of the rows by saved fits, without fitting anything: one projection, no pass over the table.

    A column of the fits that is missing in a row makes its scores NULL.
    """
    scores = {}
    for fit, name in (("lower", "score_L"), ("higher", "score_G")):
        if fit in factors:
            scores[name] = factors[fit].composite()
    if "cv" in scaled:
        scores["score_cv"] = scaled["cv"].score()
    joint = factors["joint"].scores() if "joint" in factors and "cv_factor" in scaled else {}
    names = [n for n in ("score_L", "score_G", "score_cv") if n in scores]
    out = features.select("entity", *(scores[n].alias(n) for n in names), *(c.alias(n) for n, c in joint.items()))
    if joint:
        out = out.select("entity", *names, scaled["cv_factor"].score().alias("score_cv_factor"))
    return out
