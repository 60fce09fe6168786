import pytest
from pyspark.sql import functions as F

from checks.bindings import REGIMES, supplier_attributes, supplier_points
from series_rank import Bounds, Params, run
from series_rank.operators.points import series_features
from series_rank.operators.ranking import topk
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run") / "out")
    series = series_features(supplier_points(spark, MEDIUM))
    return root, run(spark, root, Params(regimes=REGIMES), series)


def test_counts(result):
    _, r = result
    assert r.features.count() == 81
    assert {x.stage: x["count"] for x in r.rejects.groupBy("stage").count().collect()} == {"validation": 5, "features": 14}


def test_rankings_of_the_supplier_binding(result):
    _, r = result
    best = {n: [x.entity for x in topk(df, rank, 5).collect()] for n, df, rank in (
        ("factor", r.rankings["factor"], "rank_sum"),
        ("cv", r.rankings["cv"], "rank_cv"),
        ("cv_factor", r.rankings["cv_factor"], "rank_cv_factor"),
    )}
    assert best == {"factor": [82, 99, 92, 95, 48], "cv": [22, 68, 50, 73, 89], "cv_factor": [8, 6, 48, 13, 87]}


def test_final(result):
    _, r = result
    rows = r.final.orderBy("rank_final").collect()
    assert len(rows) == 14
    assert [(x.entity, round(x.score_final, 6)) for x in rows[:2]] == [(48, 0.400267), (99, 0.267405)]
    assert rows[0].source_methods == "factor, cv-factor"
    summary = r.summary.where("entity = 48").first()
    assert (summary.rank_factor, summary.rank_cv_factor) == (23, 3)


def test_restart_gives_the_same_final(spark, result):
    root, r = result
    want = {x.entity: x.rank_final for x in r.final.collect()}
    again = run(spark, root, Params(regimes=REGIMES), stages=("final",))
    assert {x.entity: x.rank_final for x in again.final.collect()} == want


def test_restart_without_saved_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run(spark, str(tmp_path), Params(regimes=REGIMES), stages=("rank",))
    with pytest.raises(ValueError):
        run(spark, str(tmp_path), Params(regimes=REGIMES), stages=("nothing",))


def test_attribute_rejects_are_kept(spark, tmp_path):
    params = Params(regimes=REGIMES, bounds=[Bounds("attr_a", 500.0, 9000.0)], methods=("cv",))
    series = series_features(supplier_points(spark, MEDIUM))
    r = run(spark, str(tmp_path / "out"), params, series, supplier_attributes(spark, MEDIUM))
    stages = {x.stage: x["count"] for x in r.rejects.groupBy("stage").count().collect()}
    assert r.features.count() + stages["attributes"] + stages["range"] == 81
    assert r.features.where((F.col("attr_a") < 500) | (F.col("attr_a") > 9000) | F.col("attr_a").isNull()).count() == 0
