import pytest
from pyspark.sql import functions as F

from series_rank.functions import text
from series_rank.functions.arrays import array_features
from series_rank.sources import landing, tables
from series_rank.streaming.landing import ingest_stream

FILE = """Landed series
Key,xf-a-200000
Entity,a
Regime,200000
Ncrit,9
Mach,0
Max Cl/Cd,45.5
Max Cl/Cd alpha,"2.5"
Url,http://host/a,b

Alpha,Cl,Cd,Cdp,Cm,Top_Xtr,Bot_Xtr
-1.0,-0.1,0.02,0.01,-0.01,1.0,0.5
0.0,"0.25",0.03,0.01,-0.02,1.0,0.5

1.0,0.5,n/a,0.01,-0.03,1.0,0.5
2.0,0.6,0.04,0.01,-0.04,1.0,0.5,surplus
3.0,0.7,0.05
"""


def parse(spark, raw):
    df = spark.createDataFrame([("a", "200000", raw)], "entity string, regime string, raw string")
    return text.parse_series(df).collect()


def test_parse_with_every_kind_of_damage(spark):
    (row,) = parse(spark, FILE)
    assert (row.ratioMax, row.ratioMaxX) == (45.5, 2.5)
    assert row.x == [-1.0, 0.0, 1.0, 3.0] and row.y == [-0.1, 0.25, 0.5, 0.7]
    assert row.d == [0.02, 0.03, None, 0.05] and row.m == [-0.01, -0.02, -0.03, None] and row.top[-1] is None


def test_line_ends_and_missing_parts(spark):
    assert parse(spark, FILE.replace("\n", "\r\n")) == parse(spark, FILE)
    assert parse(spark, FILE.replace("Bot_Xtr", "Other")) == []
    assert parse(spark, "") == []
    (row,) = parse(spark, FILE.replace("Max Cl/Cd,", "Best,"))
    assert row.ratioMax is None and row.ratioMaxX == 2.5


def test_numbers(spark):
    cells = ["1.5", " -2 ", '"3"', "1e3", ".5", "5.", "inf", "1.0d", "0x1", "nan", "", "1,5", None, "1_0"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(text.to_number(F.col("c")).alias("v"))
    assert [r.v for r in df.collect()] == [1.5, -2.0, 3.0, 1000.0, 0.5, 5.0, float("inf")] + [None] * 7


def test_page_helpers(spark):
    html = (
        "<table><a href='/skip'>skip</a></table><table><tr><td><a class=x href='/d?item=ag1-il'> <b>ag1</b> - thin &amp; flat </a>"
        "<a href=''>none</a><a href='/e'> </a></td></tr></table><script>Max camber 9% at 9% chord</script>"
        "<p>Max thickness <b>12.5%</b>\n at 30% chord</p>"
    )
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    links = text.page_links(pages, "html", ["page_id"], "table", occurrence=2)
    work = landing.worklist(links, text.extract_key(F.col("href"))).collect()
    assert [(r.entity, r.desc) for r in work] == [("ag1-il", "thin & flat")]
    row = landing.attributes_of_pages(pages, "page_id", "html").first()
    assert (row.attr_a_value, row.attr_a_place, row.attr_b_value) == (12.5, 30.0, None)


@pytest.fixture
def rows(spark):
    schema = "entity string, regime string, v double"
    return spark.createDataFrame([("a", "A", 1.0), ("a", "B", 2.0), ("b", "A", 3.0), ("d", "A", 4.0)], schema)


@pytest.fixture
def work(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")


def test_store_modes(spark, rows, work, tmp_path):
    root, calls = str(tmp_path / "store"), []

    def rows_of(todo):
        calls.append(sorted(r.entity for r in todo.collect()))
        return rows.join(todo, "entity", "left_semi")

    with pytest.raises(FileNotFoundError):
        tables.ingest(rows_of, work, root, "reuse")
    tables.ingest(rows_of, work.where("entity = 'a'"), root, "resume", "b1")
    saved = tables.ingest(rows_of, work, root, "resume", "b2")
    assert calls == [["a"], ["b", "c"]] and saved.count() == 3
    # c has no series; the ledger still counts it as done
    assert tables.progress(work, tables.ledger(spark, root)).first().asDict() == {
        "total": 3, "skipped": 3, "remaining": 0, "saved_entities": 3, "complete": True,
    }
    assert tables.resume(work, tables.ledger(spark, root)).count() == 0
    assert tables.ingest(rows_of, work, root, "reuse").count() == 3
    assert tables.ingest(rows_of, work.where("entity = 'b'"), root, "fresh", "b9").count() == 1


def test_batch_is_seen_only_after_its_ledger_and_retry_replaces_it(spark, rows, work, tmp_path):
    root = str(tmp_path / "store")
    tables.append_batch(rows, work, root, "1")
    tables.append_batch(rows, work, root, "1")
    rows.write.parquet(f"{root}/series/batch=2")
    assert tables.saved_series(spark, root).count() == 4


def test_missing_stage_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_stage(spark, str(tmp_path / "nothing"))


def test_stream_takes_new_files_only(spark, tmp_path):
    folder, root = tmp_path / "landed", str(tmp_path / "store")
    folder.mkdir()
    (folder / "xf-a-200000.csv").write_text(FILE)
    (folder / "xf-b c-500000.csv").write_text(FILE.replace("45.5", "46.5"))
    (folder / "notes.txt").write_text("not a series")

    def take():
        ingest_stream(landing.landed_files(spark, str(folder), stream=True), root).awaitTermination()
        return {(r.entity, r.regime): r.ratioMax for r in tables.saved_series(spark, root).collect()}

    assert take() == {("a", "200000"): 45.5, ("b c", "500000"): 46.5}
    (folder / "xf-z-1000000.csv").write_text(FILE.replace("Cd,Cdp", "Cx,Cdp"))
    (folder / "xf-a-500000.csv").write_text(FILE)
    assert set(take()) == {("a", "200000"), ("b c", "500000"), ("a", "500000")}
    assert {r.entity for r in tables.ledger(spark, root).collect()} == {"a", "b c", "z"}
    assert array_features(tables.saved_series(spark, root)).where("n_bad > 0").count() == 3


def test_resuming_keeps_what_is_published(spark, tmp_path):
    root = str(tmp_path / "kept")
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")

    def rows_of(todo):
        return todo.select("entity", F.lit("A").alias("regime"))

    tables.ingest(rows_of, work.where("entity <> 'c'"), root, "resume", "007")
    spark.createDataFrame([("z", "A")], "entity string, regime string").write.parquet(f"{root}/series/batch=x1")
    for _ in range(2):  # the second time there is nothing left to do
        tables.ingest(rows_of, work, root, "resume", "007")
    assert sorted(r.entity for r in tables.saved_series(spark, root).collect()) == ["a", "b", "c"]
    assert tables.ledger(spark, root).count() == 3
