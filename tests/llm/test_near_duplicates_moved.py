"""What the near-duplicate join moves: entries of buckets that repeat, one text of each candidate, each set once."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from series_rank.llm import jaccard


def texts(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return [" ".join(f"w{draw.randrange(5000)}" for _ in range(60)) for _ in range(n)]


def near(text: str) -> str:
    return text.rsplit(" ", 1)[0] + " other"


@pytest.fixture(scope="module")
def table(spark):
    own = texts(100, 1)
    rows = list(enumerate(own + [near(t) for t in own[:10]]))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_entries_of_buckets_that_repeat(table):
    bands, rows = jaccard.choose_bands()
    signed = jaccard.signatures(table, 5, bands, rows)
    reps = signed.select("key", F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("weight"), "n", "bands").persist()
    times = collections.Counter(b for r in reps.collect() for b in r.bands)
    entries, kept = jaccard.buckets(reps)
    got = collections.Counter(r.bucket for r in entries.collect())
    repeated = {b: n for b, n in times.items() if n > 1}
    assert repeated and repeated.items() <= got.items()
    assert sum(got.values()) <= sum(repeated.values()) + 2  # a chance place in the bitmap
    assert {r.bucket for r in kept.collect()} <= repeated.keys()
    reps.unpersist()


def test_sets_move_to_their_tasks_only(spark, table, monkeypatch):
    plans, kept = {}, jaccard.materialize

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(jaccard, "materialize", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.classes(table)
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == sorted(
            (d, d - 100 if d >= 100 else d, int(d < 10 or d >= 100)) for d in range(110)
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans["ngrams"].index("ArrowEvalPython") < plans["ngrams"].index("Exchange")  # the last step comes first
    assert "Join" not in plans["links"] and plans["links"].count("Exchange") == 1


@pytest.mark.parametrize("limits", [{}, {"task_members": 1}])
def test_repeated_rows_and_rows_without_an_id(spark, limits):
    a, b = texts(2, 2)
    rows = [(1, a), (1, a), (2, near(a)), (None, near(a)), (2, near(a)), (3, b), (None, b), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in jaccard.classes(docs, **limits).collect())
    assert got == sorted([(1, 1, 4), (1, 1, 4), (2, 1, 4), (0, 1, 4), (2, 1, 4), (3, 3, 1), (0, 3, 1), (4, 4, 0), (5, 5, 0)])
