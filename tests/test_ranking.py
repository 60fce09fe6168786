import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series_rank.config import Params, named_weights
from series_rank.functions import stats
from series_rank.operators import factor, pool, rankers, ranking
from series_rank.operators.wide import direction_split


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("kind", ["distinct", "ties", "one_hot_value", "constant"])
def test_global_rank_equals_pandas(spark, kind, ascending):
    rng = np.random.default_rng(1)
    n = 3000
    values = {
        "distinct": rng.normal(size=n),
        "ties": rng.integers(0, 12, n).astype(float),
        "one_hot_value": np.where(rng.random(n) < 0.4, 0.25, rng.normal(size=n)),
        "constant": np.full(n, 2.0),
    }[kind]
    rows = [(i, None if i % 97 == 5 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "entity int, score double").repartition(5)
    got = ranking.global_rank(df, "score", "rank", ascending, rows_per_task=200).toPandas().set_index("entity").sort_index()
    want = pd.Series([r[1] for r in rows]).rank(ascending=ascending, method="min")
    assert got["rank"].isna().equals(want.isna())
    assert (got["rank"].dropna() == want.dropna()).all()


def test_hot_value_is_spread_over_tasks(spark):
    df = spark.range(4000).selectExpr("id as entity", "if(id % 3 = 0, 1.0D, id * 0.001D) as score")
    ranked = ranking.global_rank(df, "score", "rank", rows_per_task=100)
    assert ranked.where("score = 1.0").select("rank").distinct().count() == 1
    # 1,334 rows tie; no task has more than about twice as many rows as asked for.
    sizes = ranked.where("score = 1.0").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) <= 200


def test_topk_breaks_ties_by_entity(spark):
    df = spark.createDataFrame([("c", 1), ("a", 2), ("b", 1), ("d", 2)], "entity string, rank int")
    assert [r.entity for r in ranking.topk(df, "rank", 3).collect()] == ["b", "c", "a"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    regimes = ["A", "N", "R"]
    columns = Params(regimes=regimes).columns
    base = rng.normal(size=(120, 5)) @ rng.normal(size=(5, len(columns)))
    data = base + rng.normal(size=(120, len(columns))) * 0.7 + 5
    data[:4, 0] = data[:, 0].min()  # a repeated minimum, so several zeros after scaling
    pdf = pd.DataFrame(data, columns=columns)
    pdf.insert(0, "entity", range(120))
    return pdf, spark.createDataFrame(pdf), Params(regimes=regimes)


def variation_score(v, lower):
    v = (v - v.min()) / (v.max() - v.min())
    for c in v:
        v.loc[v[c] == 0, c] = v[c][v[c] != 0].min()
    v[lower] = 1 / v[lower]
    v = v / v.sum()
    cv = v.std() / v.mean()
    return v @ (cv / cv.sum())


def factors(v, cap):
    r = np.corrcoef(v.values, rowvar=False)
    lam, vec = np.linalg.eigh(r)
    lam, vec = lam[::-1], factor.canonical_sign(vec[:, ::-1])
    k = min(max(1, int((lam > 1).sum())), cap)
    z = ((v - v.mean()) / (v.std() + 1e-12)).values
    return lam, k, z @ np.linalg.pinv(r) @ (vec[:, :k] * np.sqrt(lam[:k]))


def test_rank_cv_equals_pandas(spark, table):
    pdf, df, params = table
    want = variation_score(pdf[params.columns].copy(), direction_split(params.columns)[0])
    got = rankers.rank_cv(df, params).toPandas().set_index("entity").sort_index()
    np.testing.assert_allclose(got["score_cv"], want, rtol=1e-9)
    assert (got["rank_cv"] == want.rank(ascending=False, method="min")).all()


def test_rank_factor_equals_numpy(spark, table):
    pdf, df, params = table
    lower, higher = direction_split(params.columns)
    got = rankers.rank_factor(df, params).toPandas().set_index("entity").sort_index()
    total = 0
    for columns, cap, name, ascending in ((lower, 8, "L", True), (higher, 3, "G", False)):
        lam, k, scores = factors(pdf[columns], cap)
        want = pd.Series(scores @ (lam[:k] / len(columns)))
        np.testing.assert_allclose(got[f"score_{name}"], want, rtol=1e-7, atol=1e-9)
        total = total + want.rank(ascending=ascending, method="min")
    assert (got["rank_sum"] == total).all()


def test_rank_cv_factor_equals_numpy(spark, table):
    pdf, df, params = table
    _, k, scores = factors(pdf[params.columns], 10)
    frame = pd.DataFrame(scores, columns=[f"f{j}" for j in range(k)])
    want = variation_score(frame, list(frame.columns[1:]))
    got = rankers.rank_cv_factor(df, params).toPandas().set_index("entity").sort_index()
    np.testing.assert_allclose(got["score_cv_factor"], want, rtol=1e-6)


def test_factor_scores_are_uncorrelated_with_unit_variance(spark, table):
    _, df, params = table
    model = factor.fit_factors(df, params.columns, 10)
    scores = df.select(*(c.alias(n) for n, c in model.scores().items())).toPandas()
    np.testing.assert_allclose(np.corrcoef(scores.values, rowvar=False), np.eye(model.kept), atol=1e-8)
    np.testing.assert_allclose(scores.std(ddof=1), 1, atol=1e-8)
    assert model.eigenvalues.sum() == pytest.approx(len(params.columns)) and model.shares.sum() <= 1


def test_weighted_score_equals_pandas_twice_normalised(spark, table):
    pdf, df, params = table
    lower, _ = direction_split(params.columns)
    z = (pdf[params.columns] - pdf[params.columns].mean()) / pdf[params.columns].std()
    z[lower] *= -1
    z = (z - z.mean()) / z.std()
    weights = pd.Series(params.weight_map)
    want = z @ (weights / weights.sum())
    got = pool.rank_zscore_weighted(df, params.weight_map, params.columns).toPandas().set_index("entity").sort_index()
    np.testing.assert_allclose(got["score_final"], want, rtol=1e-8, atol=1e-10)


def test_rank_is_unchanged_by_positive_affine_maps(spark, table):
    pdf, df, params = table
    moved = df.selectExpr("entity", *(f"{c} * {i + 2} + {i} as {c}" for i, c in enumerate(params.columns)))
    for run, rank in ((rankers.rank_cv, "rank_cv"), (lambda d, p: pool.rank_zscore_weighted(d, p.weight_map, p.columns), "rank_final")):
        a = run(df, params).toPandas().set_index("entity")[rank].sort_index()
        b = run(moved, params).toPandas().set_index("entity")[rank].sort_index()
        assert (a == b).all()


def test_constant_columns_raise_or_are_left_out(spark, table):
    pdf, df, params = table
    flat = df.selectExpr("entity", "1.0D as A_ratioMax", *(c for c in params.columns if c != "A_ratioMax"))
    with pytest.raises(ValueError, match="A_ratioMax"):
        rankers.rank_cv(flat, params)
    with pytest.warns(UserWarning, match="A_ratioMax"):
        loose = Params(regimes=params.regimes, on_constant="drop")
        assert rankers.rank_cv(flat, loose).where("score_cv is null").count() == 0


def test_weights_must_match_the_columns(spark, table):
    _, df, params = table
    with pytest.raises(ValueError):
        pool.rank_zscore_weighted(df, {"x": 1.0}, params.columns)
    with pytest.raises(ValueError):
        named_weights([1, 2], ["a"])


def test_pool_lists_methods_in_order(spark):
    a = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "entity string, rank_a int")
    b = spark.createDataFrame([("q", 1), ("s", 2), ("p", 3)], "entity string, rank_b int")
    feats = spark.createDataFrame([(e, 1.0) for e in "pqrs"], "entity string, v double")
    got = pool.candidate_pool(feats, [("a", a, "rank_a"), ("b", b, "rank_b")], 2)
    assert {r.entity: r.source_methods for r in got.collect()} == {"p": "a", "q": "a, b", "s": "b"}


def test_unknown_method_is_named():
    with pytest.raises(KeyError, match="nope"):
        rankers.method("nope")


def test_merged_zero_statistics(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 0, 1, 2, 4])], "entity int, v double")
    model = stats.fit_scaled(df, ["v"], ["v"])
    terms = 1 / np.array([0.25, 0.25, 0.25, 0.5, 1.0])
    assert model.stats["v"].mean == pytest.approx(terms.mean()) and model.stats["v"].std == pytest.approx(terms.std(ddof=1))


def test_rank_of_neighbouring_and_infinite_scores(spark):
    near = [1.0, 1.0000000000000002, 1.0000000000000004]
    scores = near * 10 + [float("inf")] * 10 + [float("-inf")] * 5
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(scores)], "entity string, s double")
    got = {r.entity: r["rank"] for r in ranking.global_rank(df, "s", "rank", rows_per_task=4).collect()}
    assert got == {str(i): 1 + sum(t > s for t in scores) for i, s in enumerate(scores)}
