import uuid

from pyspark.sql import functions as F

from series_rank.functions.text import parse_series
from series_rank.sources import landing


def tasks_of(spark, action):
    """The number of tasks that an action starts, and its result."""
    group, tracker = uuid.uuid4().hex, spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    infos = [tracker.getStageInfo(s) for s in stages]
    return sum(i.numTasks for i in infos if i), found


def folder_of(tmp_path, n):
    for i in range(n):
        own = tmp_path / f"name=xf-e{i}-{i % 3}.csv"
        own.mkdir()
        (own / "part-0.txt").write_bytes(b"" if i == 5 else f"hé {i}\r\nlast".encode())
    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "xf-hidden-1.csv").write_text("x")
    (tmp_path / ".xf-hidden-2.csv").write_text("x")
    (tmp_path / "xf-top-7.csv").write_text("top")
    return str(tmp_path)


PATTERN = r"/(?:name=)?xf-([^/]+)-([0-9]+)\.csv(?:/[^/]+)?$"


def test_many_landed_files_take_few_tasks(spark, tmp_path):
    folder = folder_of(tmp_path, 400)
    n, index = tasks_of(spark, lambda: landing.file_index(spark, folder, PATTERN).collect())
    assert len(index) == 400 and n < 100
    paths = [r.path for r in index]
    n, files = tasks_of(spark, lambda: landing.landed_files(spark, paths, PATTERN).collect())
    assert len(files) == 400 and n < 100
    assert {(r.entity, r.regime) for r in files} == {(r.entity, r.regime) for r in index}


def test_mounted_folders_are_read_as_by_spark(spark, tmp_path, monkeypatch):
    folder = folder_of(tmp_path, 20)
    own = landing.file_index(spark, folder, PATTERN)
    index, paths = sorted(map(tuple, own.collect())), [r.path for r in own.collect()]
    files = sorted(map(tuple, landing.landed_files(spark, paths, PATTERN).collect()))
    with monkeypatch.context() as m:
        m.setattr(landing, "mounted", lambda *a: None)
        other = landing.file_index(spark, folder, PATTERN)
        assert other.schema.simpleString() == own.schema.simpleString()
        assert sorted(map(tuple, other.collect())) == index
        assert sorted(map(tuple, landing.landed_files(spark, paths, PATTERN).collect())) == files
    assert len(files) == 20 and ("top", "7", "top") in files


def test_a_landed_text_is_taken_apart_once(spark):
    names = "Alpha,Cl,Cd,Cdp,Cm,Top_Xtr,Bot_Xtr"
    head = "t\nKey,a\nMax Cl/Cd,\"1,5\"\nMax Cl/Cd,2\n\n\n\n\n\n\n"
    raws = [
        head + names + '\n1, 2 ,"3",nan,1d,inf,.5\n\n1,2\n1,2,3,4,5,6,7,8\n"1,0",2,3,4,5,6,7\n',
        head + names[:-8] + "\n1,2,3,4,5,6\n",
        "",
        None,
    ]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(raws)], "entity string, raw string")
    parsed = parse_series(df)
    (row,) = parsed.collect()
    assert (row.entity, row.ratioMax, row.x, row.y) == ("0", None, [1.0, 1.0, None], [2.0, 2.0, 2.0])
    assert (row.d, row.dp, row.m) == ([3.0, None, 3.0], [None, None, 4.0], [None, None, 5.0])
    assert (row.top, row.bottom) == ([float("inf"), None, 6.0], [0.5, None, 7.0])
    # Each split of a text costs as much as reading it.
    plan = spark.createDataFrame([], df.schema).unionByName(df).transform(parse_series)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(raw") == 1
