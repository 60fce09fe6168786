"""Stage commits, store attempts and generations, and ingest as the first stage of a run."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks.bindings import (
    FILE_IN_FOLDER,
    LANDED_REGIMES,
    LAYOUT,
    REGIMES,
    landed_folder,
    landed_listing,
    landed_pages,
    landed_texts,
    supplier_points,
)
from series_rank import Params, run
from series_rank.operators.points import series_features
from series_rank.operators.wide import to_wide
from series_rank.plans import ingest, pipeline
from series_rank.plans.ingest import Landed
from series_rank.sources import stages as stages_module
from series_rank.sources import tables
from series_rank.sources.stages import Stages
from tests.conftest import MEDIUM, SMALL


def values(df):
    return sorted(r.v for r in df.select("v").collect())


def numbers(spark, *vs):
    return spark.createDataFrame([(v,) for v in vs], "v int")


# ---- stage tables ---------------------------------------------------------------------


def test_failure_between_write_and_switch_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stage")
    tables.write_stage(numbers(spark, 1, 2), path)
    with monkeypatch.context() as m:
        m.setattr(stages_module, "add_line", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            tables.write_stage(numbers(spark, 3), path)
    assert values(tables.read_stage(spark, path)) == [1, 2]
    tables.write_stage(numbers(spark, 4), path)
    assert values(tables.read_stage(spark, path)) == [4]


def test_a_stage_may_read_the_table_it_saves(spark, tmp_path):
    path = str(tmp_path / "stage")
    tables.write_stage(numbers(spark, 1, 2), path)
    doubled = tables.read_stage(spark, path).select((F.col("v") * 2).alias("v"))
    assert values(tables.write_stage(doubled, path)) == [2, 4]
    assert values(tables.read_stage(spark, path)) == [2, 4]


def test_tables_of_a_stage_switch_together(spark, tmp_path):
    saved = Stages(spark, str(tmp_path))
    saved.write("a", numbers(spark, 1))
    saved.write("b", numbers(spark, 2), {"n": F.count(F.lit(1)), "sum": F.sum("v")})
    assert not Stages(spark, str(tmp_path)).has("a")
    saved.commit("first", {"x": [1]})
    other = Stages(spark, str(tmp_path))
    assert values(other.read("a")) == [1] and other.of("b").counts["b"] == {"n": 1, "sum": 2}
    assert other.of("b").params == {"x": [1]}


def test_empty_and_partitioned_tables_keep_their_columns(spark, tmp_path):
    saved = Stages(spark, str(tmp_path))
    saved.write("t", numbers(spark, 1).where("v > 1").withColumn("kept", F.col("v") > 0), {"n": F.count(F.lit(1))}, ["kept"])
    saved.commit("first")
    again = Stages(spark, str(tmp_path)).read("t")
    assert again.columns == ["v", "kept"] and again.isEmpty() and saved.of("t").counts["t"] == {"n": 0}


def test_vacuum_empties_replaced_versions_only(spark, tmp_path):
    saved = Stages(spark, str(tmp_path))
    for v in (1, 2, 3):
        saved.write("a", numbers(spark, v))
        saved.commit("first")
    emptied = saved.vacuum()
    assert len(emptied) == 2 and all(spark.read.parquet(p).isEmpty() for p in emptied)
    assert values(Stages(spark, str(tmp_path)).read("a")) == [3]


def test_stale_tables_are_an_error(spark, tmp_path):
    root, params = str(tmp_path / "out"), Params(regimes=REGIMES, methods=("cv",))
    series = series_features(supplier_points(spark, MEDIUM))
    run(spark, root, params, series)
    with pytest.raises(ValueError, match="min_fall_points"):
        run(spark, root, replace(params, min_fall_points=3), stages=("filter",))
    with pytest.raises(ValueError, match="on_constant"):
        run(spark, root, replace(params, on_constant="drop"), stages=("final",))
    run(spark, root, replace(params, top_n=2), stages=("final",))  # only this stage depends on it
    run(spark, root, params, stages=("filter",))
    with pytest.raises(ValueError, match="tagged was saved anew"):
        run(spark, root, params, stages=("final",))
    assert run(spark, root, params, stages=("rank", "final")).final.count() == 5


# ---- the store ---------------------------------------------------------------------------

SERIES = "entity string, regime string, v int"


def rows(spark, *rs):
    return spark.createDataFrame(list(rs), SERIES)


def work(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "entity string")


def held(spark, root):
    return sorted(((r.entity, r.regime, r.v) for r in tables.saved_series(spark, root).collect()), key=repr)


def test_late_regimes_of_a_published_entity(spark, tmp_path):
    root = str(tmp_path / "s")
    tables.append_batch(rows(spark, ("a", "1", 1)), work(spark, "a"), root, "b")
    tables.append_batch(rows(spark, ("a", "1", 7), ("a", "2", 2), ("c", "1", 3)), work(spark, "a", "c", "d"), root, "b")
    for _ in range(2):  # nothing new
        tables.append_batch(rows(spark, ("a", "2", 8)), work(spark, "a", "d"), root, "b")
    assert held(spark, root) == [("a", "1", 1), ("a", "2", 2), ("c", "1", 3)]
    assert sorted((r.entity, r.n_series) for r in tables.ledger(spark, root).collect()) == [("a", 1), ("a", 1), ("c", 1), ("d", 0)]


def test_a_series_that_lands_again_wins(spark, tmp_path):
    root = str(tmp_path / "s")
    tables.append_batch(rows(spark, ("a", "1", 1), ("a", None, 5)), work(spark, "a"), root, "x~1")
    tables.append_batch(rows(spark, ("a", "1", 2), ("b", "1", 3)), work(spark, "a", "b"), root, "a-before-x")
    tables.append_batch(rows(spark, ("a", None, 6)).withColumn("seq", F.lit(0)), work(spark, "a"), root, "y")
    assert held(spark, root) == [("a", "1", 2), ("a", None, 6), ("b", "1", 3)]
    assert tables.saved_series(spark, root, latest=False).count() == 5
    # Without a choice made at reading, the pivot makes the same one by the attempt's number.
    every = tables.saved_series(spark, root, latest=False).withColumnRenamed("v", "f")
    wide = {r.entity: r["1_f"] for r in to_wide(every, ["1"], ["f"]).collect()}
    assert wide == {"a": 2, "b": 3}


def test_a_failed_fresh_start_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "s")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        tables.ingest(lambda todo: rows(spark, ("a", "1", 1)), work(spark, "a"), root, "resume", "b")

        def broken(todo):
            raise OSError("nothing landed")

        with pytest.raises(OSError):
            tables.ingest(broken, work(spark, "a"), root, "fresh", "c")
        with monkeypatch.context() as m:
            m.setattr(tables, "add_line", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError):
                tables.ingest(lambda todo: rows(spark, ("z", "1", 9)), work(spark, "z"), root, "fresh", "d")
        assert held(spark, root) == [("a", "1", 1)]
        tables.ingest(lambda todo: rows(spark, ("b", "1", 2)), work(spark, "b"), root, "fresh", "b")
        assert held(spark, root) == [("b", "1", 2)]
        assert [r.entity for r in tables.ledger(spark, root).collect()] == ["b"]
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_auto_mode_continues_and_then_reuses(spark, tmp_path):
    root, calls = str(tmp_path / "s"), []

    def rows_of(todo):
        calls.append(sorted(r.entity for r in todo.collect()))
        return todo.select("entity", F.lit("1").alias("regime"), F.lit(1).alias("v"))

    tables.ingest(rows_of, work(spark, "a", "b"), root, "auto", "1")
    tables.ingest(rows_of, work(spark, "a", "b", "c"), root, "auto", "2")
    assert tables.chosen_mode(work(spark, "a", "c"), root) == "reuse"
    assert len(held(spark, root)) == 3 == tables.ingest(rows_of, work(spark, "a", "c"), root, "auto", "3").count()
    assert calls == [["a", "b"], ["c"]]
    with pytest.raises(ValueError):
        tables.ingest(rows_of, work(spark, "a"), root, "sometimes")


def test_parts_are_published_one_by_one(spark, tmp_path):
    root, names = str(tmp_path / "s"), [f"e{i}" for i in range(40)]

    def rows_of(todo):
        if len(tables.ledger(spark, root).collect()) > 15:
            raise OSError("stopped")
        return todo.select("entity", F.lit("1").alias("regime"), F.lit(1).alias("v"))

    with pytest.raises(OSError):
        tables.ingest(rows_of, work(spark, *names), root, "resume", "b", parts=4)
    done = {r.entity for r in tables.ledger(spark, root).collect()}
    assert 15 < len(done) < 40 and {r[0] for r in held(spark, root)} == done
    assert tables.resume(work(spark, *names), tables.ledger(spark, root)).count() == 40 - len(done)


# ---- ingest as a stage ----------------------------------------------------------------------


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    texts = landed_texts(spark, SMALL)
    folder = landed_folder(spark, texts, str(tmp_path_factory.mktemp("landed") / "files"))
    return Landed(landed_listing(spark, SMALL), folder, landed_pages(spark, SMALL), occurrence=2, name_pattern=FILE_IN_FOLDER, layout=LAYOUT)


def test_work_list_has_every_listed_entity_once(spark, landed):
    found = {r.entity: r.desc for r in landed.work().collect()}
    want = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 29 <> 3").collect()
    assert found == {str(r.vec_id): f"label {r.label} & more" for r in want}


def test_files_of_done_entities_are_not_opened(spark, landed, tmp_path, monkeypatch):
    root, opened = str(tmp_path / "run"), []
    real = ingest.landed_files
    monkeypatch.setattr(ingest, "landed_files", lambda s, paths, pattern: (opened.append(len(paths)), real(s, paths, pattern))[1])
    first = replace(landed, listing=landed.listing.where("page = 0"), files_per_part=60)
    ingest.fill_store(spark, root, first, LANDED_REGIMES)
    n = len(opened)
    assert n > 1 and max(opened) < 120
    ingest.fill_store(spark, root, landed, LANDED_REGIMES)
    index = ingest.file_index(spark, landed.files, FILE_IN_FOLDER).join(landed.work(), "entity", "left_semi")
    assert sum(opened) == index.count() and sum(opened[:n]) < sum(opened)
    before = len(opened)
    saved = ingest.fill_store(spark, root, landed, LANDED_REGIMES)
    assert len(opened) == before  # complete: reused
    whole = ingest.fill_store(spark, str(tmp_path / "at once"), landed, LANDED_REGIMES)
    assert sorted(r.entity + r.regime for r in saved.collect()) == sorted(r.entity + r.regime for r in whole.collect())


def test_run_from_landed_files(spark, landed, tmp_path):
    root, params = str(tmp_path / "run"), Params(regimes=LANDED_REGIMES, methods=())
    with pytest.raises(ValueError, match="landed"):
        run(spark, root, params, stages=("ingest",))
    with pytest.raises(ValueError, match="series"):
        run(spark, root, params, stages=("analyse",))
    run(spark, root, params, stages=("ingest", "analyse", "filter"), landed=landed)
    assert Stages(spark, root).of("attributes").counts["attributes"]["incomplete"] > 0
    rejects = {(r.entity, r.stage) for r in Stages(spark, root).read("tagged").where("not kept").collect()}
    # The same again from the store alone, and the numbers observed when the rows were written.
    again = run(spark, root, params, stages=("analyse", "filter"))
    assert {(r.entity, r.stage) for r in again.rejects.collect()} == rejects
    metrics = pipeline.stage_metrics(spark, root).collect()
    assert metrics[0].rows_in == again.entities.count() and metrics[-1].kept == again.features.count()
    assert sum(m.dropped for m in metrics) == len(rejects)
