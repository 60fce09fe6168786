import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from series_rank.config import FEATURES
from series_rank.functions.arrays import array_features
from series_rank.operators import points
from series_rank.operators.points import as_points, series_features
from tests.reference_numpy import features

HAND = {
    "x": [-2, -1, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    "y": [-0.2, 0.1, -0.05, 0.4, 0.9, 0.9, 0.8, 0.7, 0.65, 0.6, 0.5, 0.45],
    "d": [0.02, 0.015, 0.01, 0.012, 0.02, 0.03, 0.05, 0.07, 0.10, 0.13, 0.17, 0.20],
    "m": [-0.01 * i for i in range(1, 13)],
}
EXPECTED = {
    "ratioMax": 45.0,
    "ratioMaxX": 2.0,
    "yMax": 0.9,
    "yStdRate": 0.0,
    "yMeanRate": 0.3,
    "yStdFallRate": 0.03499271061,
    "yMeanFallRate": 0.06428571429,
    "dMax": 0.012,
    "dStdRate": 0.0,
    "dMeanRate": 0.002,
    "mAtZero": 0.03,
}


def random_series(rng, n):
    y = np.round(rng.normal(0, 3, n)) if rng.random() < 0.3 else rng.normal(0.5, 1, n)
    return {"x": np.arange(n) - n // 3, "y": y, "d": rng.uniform(0.1, 2, n), "m": rng.normal(0, 1, n)}


@pytest.fixture(scope="module")
def collection():
    rng = np.random.default_rng(7)
    out = {("hand", "A"): {k: np.array(v, dtype=float) for k, v in HAND.items()}}
    for i in range(12):
        for regime in "AB":
            out[(f"e{i}", regime)] = random_series(rng, int(rng.integers(1, 60)))
    out[("long", "A")] = random_series(rng, 700)
    return out


def points_table(spark, collection, seed=0):
    rows = [
        (e, r, i, float(s["x"][i]), float(s["y"][i]), float(s["d"][i]), float(s["m"][i]))
        for (e, r), s in collection.items()
        for i in range(len(s["y"]))
    ]
    np.random.default_rng(seed).shuffle(rows)
    rows = [(str(a), str(b), int(i), float(x), float(y), float(d), float(m)) for a, b, i, x, y, d, m in rows]
    df = spark.createDataFrame(rows, "e string, r string, i int, x double, y double, d double, m double")
    return as_points(df, F.col("e"), F.col("r"), [F.col("i")], F.col("x"), F.col("y"), F.col("d"), F.col("m"))


def check(got, collection):
    got = {(r["entity"], r["regime"]): r for r in got.collect()}
    assert set(got) == set(collection)
    for key, s in collection.items():
        for name, want in features(s["x"], s["y"], s["d"], s["m"]).items():
            value = got[key][name]
            if isinstance(want, float) and math.isnan(want):
                assert value is None, (key, name)
            else:
                assert value == pytest.approx(want, rel=1e-9, abs=1e-9), (key, name)


def test_hand_worked_series(spark):
    row = series_features(points_table(spark, {("h", "A"): {k: np.array(v, float) for k, v in HAND.items()}})).first()
    assert row["peak_pos"] == 4 and row["n_fall"] == 8
    for name, want in EXPECTED.items():
        assert row[name] == pytest.approx(want, abs=1e-9), name


@pytest.mark.parametrize("hot_rows", [None, 10**6, 40, 5])
def test_points_equal_numpy_however_series_are_cut(spark, collection, hot_rows):
    check(series_features(points_table(spark, collection), hot_rows=hot_rows), collection)


def test_row_order_and_partitions_do_not_matter(spark, collection):
    check(series_features(points_table(spark, collection, seed=3).repartition(7), hot_rows=30), collection)


@pytest.mark.parametrize("most", [2, 30])
def test_pieces_grow_where_there_would_be_too_many(spark, collection, monkeypatch, most):
    monkeypatch.setattr("series_rank.operators.points.MAX_PIECES", most)
    table = points_table(spark, collection)
    hot, least = points._hot_series(table, 10)
    assert least > 10 and (points.cut_points(table, hot, least).agg({"pieces": "sum"}).first()[0] or 0) <= 2 * most
    check(series_features(table, hot_rows=10), collection)


def test_pieces_are_even_and_follow_the_order(spark, collection):
    table = points_table(spark, {("long", "A"): collection[("long", "A")]})
    cuts = points.cut_points(table, *points._hot_series(table, 50))
    placed = points.with_piece(table.join(cuts.drop("peak"), points._same_series()))
    found = placed.groupBy("piece").agg(F.count("ord").alias("n"), F.min("ord").alias("low"), F.max("ord").alias("high"))
    rows = found.orderBy("piece").collect()
    assert len(rows) == 28 and max(r.n for r in rows) <= 50 and sum(r.n for r in rows) == 700
    assert all(a.high < b.low for a, b in zip(rows, rows[1:]))


def test_series_without_a_regime_is_kept_when_cut(spark, collection):
    bare = points_table(spark, {("long", "A"): collection[("long", "A")]}).withColumn("regime", F.lit(None).cast("string"))
    row = series_features(bare, hot_rows=50).first()
    want = features(*(collection[("long", "A")][k] for k in "xydm"))
    assert row["regime"] is None and row["n_points"] == 700 and row["yStdFallRate"] == pytest.approx(want["yStdFallRate"])


def test_arrays_equal_numpy(spark, collection):
    rows = [(e, r, *(s[k].astype(float).tolist() for k in "xydm")) for (e, r), s in collection.items()]
    df = spark.createDataFrame(
        rows, "entity string, regime string, x array<double>, y array<double>, d array<double>, m array<double>"
    )
    check(array_features(df), collection)


def test_given_ratio_is_passed_through(spark):
    df = spark.createDataFrame(
        [("a", "A", [1.0, 2.0], [1.0, 2.0], [1.0, 1.0], [0.0, 0.0], 9.5, 3.0)],
        "entity string, regime string, x array<double>, y array<double>, d array<double>, m array<double>, "
        "ratioMax double, ratioMaxX double",
    )
    row = array_features(df).first()
    assert (row.ratioMax, row.ratioMaxX) == (9.5, 3.0)


def test_missing_values_are_counted_not_fatal(spark):
    nan = float("nan")
    df = spark.createDataFrame(
        [("a", "A", i, float(i), y, 1.0, 1.0) for i, y in enumerate([1.0, nan, 3.0, None])],
        "e string, r string, i int, x double, y double, d double, m double",
    )
    pts = as_points(df, F.col("e"), F.col("r"), [F.col("i")], F.col("x"), F.col("y"), F.col("d"), F.col("m"))
    assert series_features(pts).first()["n_bad"] == 2
    assert series_features(pts, hot_rows=1).first()["n_bad"] == 2


def test_empty_array_series(spark):
    df = spark.createDataFrame(
        [("a", "A", [], [], [], [])],
        "entity string, regime string, x array<double>, y array<double>, d array<double>, m array<double>",
    )
    row = array_features(df).first()
    assert row["n_points"] == 0 and all(row[f] is None for f in FEATURES)
