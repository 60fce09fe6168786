from pyspark.sql import functions as F

from checks import oracles
from series_rank.config import FEATURE_WEIGHTS, FEATURES, LOWER_BETTER, Bounds, feature_columns
from series_rank.operators import gate, wide

SCHEMA = "entity string, regime string, n_points long, n_bad long, n_fall long, " + ", ".join(f"{f} double" for f in FEATURES)


def row(entity, regime, n_points=20, n_bad=0, n_fall=9, value=1.0, **over):
    return (entity, regime, n_points, n_bad, n_fall, *(over.get(f, value) for f in FEATURES))


def test_first_failing_series_decides(spark):
    rows = [
        *(row("ok", r) for r in "ABC"),
        *(row("few", r) for r in "AB"),
        row("order", "C", n_bad=1), row("order", "A", n_fall=6), row("order", "B"),
        row("both", "A", n_bad=1, n_fall=2), row("both", "B"), row("both", "C"),
        *(row("extra", r) for r in "ABC"), row("extra", "Z", n_fall=1),
        row("empty", "A", n_points=0, n_fall=0), row("empty", "B"), row("empty", "C"),
        row("edge", "A", n_fall=7), row("edge", "B"), row("edge", "C"),
        row(None, "A"),
    ]
    found = {r.entity: r.reason for r in gate.validate(spark.createDataFrame(rows, SCHEMA), ["A", "B", "C"]).collect()}
    assert found == {
        "ok": None,
        "edge": None,
        "few": "fewer than 3 regimes available",
        "order": "insufficient fall region (regime=A)",
        "both": "non-numeric values in series (regime=A)",
        "extra": "insufficient fall region (regime=Z)",
        "empty": "empty series (regime=A)",
    }


def test_entity_table_and_rejects(spark):
    rows = [*(row("a", r) for r in "ABC"), row("b", "A"), row("b", "B", dMax=None), row("b", "C"), row("c", "A")]
    table = wide.entity_table(spark.createDataFrame(rows, SCHEMA), ["A", "B", "C"])
    assert [r.entity for r in wide.complete_features(table, ["A", "B", "C"]).collect()] == ["a"]
    rejects = {r.entity: (r.stage, r.reason) for r in wide.entity_rejects(table, ["A", "B", "C"]).collect()}
    assert rejects == {"b": ("features", "missing B_dMax"), "c": ("validation", "fewer than 3 regimes available")}


def test_last_duplicate_wins_and_unknown_regime_is_skipped(spark):
    df = spark.createDataFrame([row("a", "A", value=1.0), row("a", "A", value=2.0), row("a", "Q", value=3.0)], SCHEMA)
    df = df.withColumn("seq", F.col("yMax").cast("int"))
    got = wide.to_wide(df, ["A", "B"]).first()
    assert got.A_yMax == 2.0 and got.B_yMax is None and "Q_yMax" not in got


def test_direction_split_has_24_lower_and_9_higher():
    lower, higher = wide.direction_split(feature_columns(["p", "q", "r"]))
    assert (len(lower), len(higher)) == (24, 9)
    assert "p_yMeanRate" in higher and "p_ratioMax" in higher and "p_ratioMaxX" in lower


def test_range_limits_are_inclusive_and_optional(spark):
    df = spark.createDataFrame([(i, float(i), float(10 - i)) for i in range(6)], "entity int, attr_a double, attr_b double")
    bounds = [Bounds("attr_a", 1.0, 4.0), Bounds("attr_b", None, 8.0)]
    assert {r.entity for r in wide.range_filter(df, bounds).collect()} == {2, 3, 4}
    reasons = {r.entity: r.reason for r in df.select("entity", wide.range_reason(bounds).alias("reason")).collect()}
    assert reasons[0] == "attr_a < 1.0" and reasons[5] == "attr_a > 4.0" and reasons[1] == "attr_b > 8.0" and reasons[3] is None


def test_complete_cases_coerces_and_drops(spark):
    df = spark.createDataFrame([("a", "1.5", 1.0), ("b", "n/a", 1.0), ("c", "2", float("nan"))], "entity string, u string, v double")
    assert [(r.entity, r.u) for r in wide.complete_cases(df, ["u", "v"]).collect()] == [("a", 1.5)]


def test_the_regimes_set_how_many_series_an_entity_needs(spark):
    rows = [row("two", "A"), row("two", "B"), row("one", "A")]
    series = spark.createDataFrame(rows, SCHEMA)
    found = {r.entity: r.reason for r in gate.validate(series, ["A", "B"]).collect()}
    assert found == {"two": None, "one": "fewer than 2 regimes available"}
    assert {r.entity: r.gate for r in wide.entity_table(series, ["A", "B"]).collect()} == found
    assert {r.reason for r in gate.validate(series, ["A", "B"], min_series=1).collect()} == {None}


def test_statements_and_library_agree_on_fixed_values():
    assert oracles.FEATURES == FEATURES and sorted(oracles.LOWER_BETTER) == sorted(LOWER_BETTER)
    assert oracles.FEATURE_WEIGHTS == FEATURE_WEIGHTS
