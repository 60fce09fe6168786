"""Quoted cells, both series layouts on missing cells, ranks by range, statistics and saved models."""

import csv
import io
import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series_rank.config import FEATURES, Params
from series_rank.functions import stats, text
from series_rank.functions.arrays import array_features
from series_rank.operators import factor, models, rankers, ranking
from series_rank.operators.points import as_points, series_features
from series_rank.operators.wide import direction_split

# ---- cells ------------------------------------------------------------------------------

LINES = [
    "a,b,c", "", ",", ",a", "a,", '"a,b",c', '"a ""x, y"" b",c', 'a "b, c" d,e', '"open, and not closed', '"",x', ' "a,b" ,c',
    '"a"b,c', 'é,"日,本",\U0001f600', '"' + "x," * 5000 + '",y',
]


def test_cells_keep_quoted_commas(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LINES)], "i int, v string")
    got = {r.i: (r.n, r.c) for r in df.select("i", text.n_cells(F.col("v")).alias("n"), text.cells(F.col("v")).alias("c")).collect()}
    for i, line in enumerate(LINES):
        n, cells = got[i]
        assert n == len(cells) and ",".join(cells) == line  # nothing is lost but the commas between
        if "open" not in line:
            assert n == len(next(csv.reader(io.StringIO(line.strip()), skipinitialspace=True), [""]))
    assert got[LINES.index('"a,b",c')][1] == ['"a,b"', "c"] and got[LINES.index('"open, and not closed')][0] == 2
    assert spark.range(1).select(text.n_cells(F.lit(None).cast("string")).alias("n")).first().n is None


def test_quoted_cells_in_a_series_file(spark):
    raw = "t\nKey,x\nEntity,a\nRegime,1\nPlace,\"here, there\"\nMach,0\nMax Cl/Cd,4\nMax Cl/Cd alpha,2\n\n\n"
    raw += 'Alpha,Cl,Cd,Cdp,Cm,Top_Xtr,Bot_Xtr\n1,"2",3,4,5,"0,5",1\n2,3,4,5,6,"a",7,8\n'
    df = spark.createDataFrame([("a", "1", raw)], "entity string, regime string, raw string")
    (row,) = text.parse_series(df).collect()
    assert (row.x, row.y, row.top, row.bottom) == ([1.0], [2.0], [None], [1.0])
    header = df.select(text.header_map(F.col("raw")).alias("h")).first().h
    assert header["Place"] == "here, there" and header["Key"] == "x"


# ---- layouts ----------------------------------------------------------------------------------


def test_both_layouts_agree_on_missing_cells(spark):
    rng = np.random.default_rng(4)
    rows, cells = [], []
    for e in range(60):
        n = int(rng.integers(1, 30))
        columns = {}
        for c in "xydm":
            v = rng.normal(0, 2, n).round(int(rng.integers(0, 3)))
            columns[c] = [None if rng.random() < (0.3, 0.0, 1.0)[min(e % 9, 2) if e % 9 < 3 else 0] else float(x) for x in v]
        rows.append((f"e{e}", "A", *(columns[c] for c in "xydm")))
        cells += [(f"e{e}", "A", i, *(columns[c][i] for c in "xydm")) for i in range(n)]
    arrays = spark.createDataFrame(rows, "entity string, regime string, x array<double>, y array<double>, d array<double>, m array<double>")
    table = spark.createDataFrame(cells, "e string, r string, i int, x double, y double, d double, m double")
    points = as_points(table, F.col("e"), F.col("r"), [F.col("i")], *(F.col(c) for c in "xydm"))
    columns = ["n_points", "n_bad", "peak_pos", "n_fall", *FEATURES]
    a = {r.entity: r for r in array_features(arrays).collect()}
    for hot_rows in (None, 4):
        for r in series_features(points, hot_rows=hot_rows).collect():
            for c in columns:
                left, right = a[r.entity][c], r[c]
                assert (left is None) == (right is None), (r.entity, c)
                assert left is None or left == pytest.approx(right, abs=1e-9), (r.entity, c)
    assert {r.n_fall == 0 for r in a.values()} == {True, False}


# ---- ranks by range --------------------------------------------------------------------------------


@pytest.mark.parametrize("shuffle_partitions", ["1", "3", "200"])
def test_no_task_ranks_many_more_rows_than_asked_for(spark, monkeypatch, shuffle_partitions):
    rng = np.random.default_rng(9)
    values = np.concatenate([rng.normal(size=4000), np.full(3000, 0.5), rng.exponential(size=3000) ** 6])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "entity int, score double").repartition(6)
    monkeypatch.setattr(ranking, "PERCENTILE_ACCURACY", 8)  # so rough that ranges have to be cut again
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    try:
        ranked = ranking.global_rank(df, "score", "rank", rows_per_task=250)
        sizes = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 2 * 250 and sum(sizes) == len(values)
        got = ranked.toPandas().set_index("entity").sort_index()["rank"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got == pd.Series(values).rank(ascending=False, method="min")).all()


def test_ranks_of_tables_without_scores(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan"))], "entity int, score double")
    assert [r["rank"] for r in ranking.global_rank(df, "score", "rank").collect()] == [None, None]
    assert ranking.global_rank(df.limit(0), "score", "rank", rows_per_task=1).isEmpty()


# ---- statistics ----------------------------------------------------------------------------------------


def test_column_statistics_with_missing_and_odd_values(spark):
    rows = [(1.0, None, 5, 1.0), (2.5, 3.0, 5, math.inf), (-4.0, float("nan"), 5, 2.0), (0.0, 7.0, 5, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, `c d` int, e double")
    found = stats.column_stats(df, ["a", "b", "c d", "e"])
    plain = [r[0] for r in rows]
    assert (found["a"].n, found["a"].low, found["a"].high) == (4, -4.0, 2.5) and found["a"].total == pytest.approx(-0.5)
    assert found["a"].std == pytest.approx(statistics.stdev(plain)) and found["a"].mean == pytest.approx(-0.125)
    assert found["b"].n == 3 and found["b"].low == 3.0  # NULL is left out, NaN is a value
    assert (found["c d"].std, stats.constant_columns(found)) == (0.0, ["c d"])
    assert found["e"].high == math.inf and found["e"].n == 4
    assert stats.column_stats(df.limit(0), ["a"])["a"] == stats.ColumnStats(0, None, None, None, None, None)
    assert stats.column_stats(df.limit(1), ["a"])["a"].std is None


# ---- shared moments and saved models --------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    params = Params(regimes=["A", "N", "R"])
    data = rng.normal(size=(120, 5)) @ rng.normal(size=(5, len(params.columns))) + rng.normal(size=(120, len(params.columns))) + 5
    pdf = pd.DataFrame(data, columns=params.columns)
    pdf.insert(0, "entity", range(120))
    return spark.createDataFrame(pdf), params


def test_fits_to_blocks_equal_fits_of_their_own(spark, table):
    df, params = table
    known = factor.moments(df, params.columns)
    for columns in direction_split(params.columns):
        shared, alone = factor.fit_factors(df, columns, 8, known=known), factor.fit_factors(df, columns, 8)
        np.testing.assert_allclose(shared.eigenvalues, alone.eigenvalues, rtol=1e-9)
        np.testing.assert_allclose(shared.vectors[:, :3], alone.vectors[:, :3], atol=1e-8)


def test_saved_models_score_as_the_fits_did(spark, table, tmp_path):
    df, params = table
    fits = rankers.Fits(df, params)
    ranked = [rankers.method(n).apply(df, params, fits) for n in params.methods]
    for name, made in (("f", models.factor_table(spark, fits.factors)), ("s", models.scaled_table(spark, fits.scaled))):
        made.write.parquet(f"{tmp_path}/{name}")
    factors = models.factor_models(spark.read.parquet(f"{tmp_path}/f"))
    scaled = models.scaled_models(spark.read.parquet(f"{tmp_path}/s"))
    assert set(factors) == {"lower", "higher", "joint"} and set(scaled) == {"cv", "cv_factor"}
    assert all(factors[k].kept == m.kept and list(factors[k].columns) == list(m.columns) for k, m in fits.factors.items())
    scores = models.score_rows(df, factors, scaled).toPandas().set_index("entity").sort_index()
    for frame in ranked:
        want = frame.toPandas().set_index("entity").sort_index()
        for c in [c for c in want.columns if c.startswith("score")]:
            np.testing.assert_allclose(scores[c], want[c], rtol=1e-12)
    # Rows the models have not seen, one of them incomplete; without a scaled model there is no score of its kind.
    some = df.where("entity < 2").withColumn("A_yMax", F.when(F.col("entity") == 0, F.col("A_yMax")))
    found = models.score_rows(some, factors, {})
    assert found.columns == ["entity", "score_L", "score_G"]
    assert {r.entity: r.score_G is None for r in found.collect()} == {0: False, 1: True}
