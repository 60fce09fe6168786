"""Parquet tables: scans, single stage tables, the incremental series store and its ledger.

The store has two tables under one root, both partitioned by attempt. Every
attempt to publish a batch has a number greater than all before it and writes
directories of its own, the series rows first and the ledger rows last; an attempt
without ledger rows is not read, and nothing published is ever replaced or removed.

A series is known by entity and regime. What a batch has published already is
left out when the batch is written again, so a retried batch leaves no duplicates
and still adds the series that were not there the first time. A series that other
batches have published before is published again under the new number, and the
largest number wins when the store is read: a file that lands again replaces its
series. Entities without any series are in the ledger only, which is how they
count as done.

Starting over writes a new generation beside the old one. The store switches to it
with one line when everything is saved, so a failed start leaves the old rows.
There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from series_rank.sources.stages import Stages, add_line, saved_lines

ATTEMPT = "~"
LEDGER_SCHEMA = (
    "entity string, n_series long, regimes array<struct<regime: string>>, generation long, seq long, batch string"
)
MODES = ("auto", "fresh", "resume", "reuse")


def scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet table; with a schema, no file is opened to find it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        scan(spark, path)
        return True
    except AnalysisException:
        return False


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Save a stage table as its new version and read it back. *df* may come from the version before."""
    stages = Stages(df.sparkSession, path)
    written = stages.write("table", df)
    stages.commit("table")
    return written


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return Stages(spark, path).read("table")


# ---- the store ----------------------------------------------------------------------


def _batch_name() -> Column:
    """The name of the batch in that of its attempt, which ends in a number and a random part."""
    return F.regexp_extract("batch", rf"^(.*){ATTEMPT}\d+{ATTEMPT}[0-9a-f]+$", 1)


def _all_attempts(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/ledger"):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return scan(spark, f"{root}/ledger", LEDGER_SCHEMA)


def generation(spark: SparkSession, root: str) -> int:
    """The generation that is read: the last one switched to, 0 in a new store."""
    return max((line["generation"] for line in saved_lines(spark, f"{root}/generations")), default=0)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(entity, n_series, regimes, generation, seq, batch) of every published attempt of the current generation."""
    return _all_attempts(spark, root).where(F.col("generation") == generation(spark, root))


def append_batch(rows: DataFrame, worked: DataFrame, root: str, batch: str, into: int | None = None) -> None:
    """Publish the series rows of the ``worked`` entities that this batch has not published yet.

    ``into`` is the generation written to, by default the current one. A column
    ``seq`` of the rows is left out: the store numbers the series itself.
    """
    spark = rows.sparkSession
    into = generation(spark, root) if into is None else into
    attempts = _all_attempts(spark, root)
    own = (F.col("generation") == into) & (_batch_name() == batch)
    before = attempts.where(own)
    found = attempts.agg(F.max("seq").alias("last"), F.count_if(own).alias("own")).first()
    last, retried = found["last"] or 0, found["own"] > 0
    worked = worked.select(F.col("entity").cast("string").alias("entity")).distinct()
    rows = rows.drop("seq")
    if retried:
        rows = _not_published(rows, before)
    elif worked.isEmpty():
        return
    attempt = f"{batch}{ATTEMPT}{last + 1}{ATTEMPT}{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/series/batch={attempt}")
    saved = scan(spark, f"{root}/series/batch={attempt}", rows.schema)
    # Series of entities that were not on the list are known to the ledger as well.
    done = worked.join(saved_counts(saved), "entity", "full_outer")
    if retried:
        known = before.select("entity").distinct().withColumn("known", F.lit(True))
        done = done.join(known, "entity", "left").where(F.col("known").isNull() | (F.col("n_series") > 0)).drop("known")
    done = done.select(
        "entity",
        F.coalesce("n_series", F.lit(0)).cast("long").alias("n_series"),
        F.coalesce("regimes", F.array().cast("array<struct<regime: string>>")).alias("regimes"),
        F.lit(into).cast("long").alias("generation"),
        F.lit(last + 1).cast("long").alias("seq"),
    )
    if retried and done.isEmpty():
        return
    done.write.parquet(f"{root}/ledger/batch={attempt}")


def _not_published(rows: DataFrame, before: DataFrame) -> DataFrame:
    """The rows whose series is not among those of the ledger rows."""
    keys = before.select(F.col("entity").alias("_e"), F.explode("regimes").alias("_r")).select("_e", F.col("_r.regime").alias("_r")).distinct()
    regime = F.col("regime").cast("string") if "regime" in rows.columns else F.lit(None).cast("string")
    return rows.join(keys, F.col("entity").cast("string").eqNullSafe(F.col("_e")) & regime.eqNullSafe(F.col("_r")), "left_anti")


def saved_counts(rows: DataFrame) -> DataFrame:
    """(entity, n_series, regimes); an entity has as many regimes as were asked for."""
    regime = F.col("regime").cast("string") if "regime" in rows.columns else F.lit(None).cast("string")
    return rows.groupBy(F.col("entity").cast("string").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_series"), F.collect_set(F.struct(regime.alias("regime"))).alias("regimes")
    )


def saved_series(spark: SparkSession, root: str, latest: bool = True) -> DataFrame:
    """Series rows of the published batches with ``seq``, the number of the attempt that published them.

    Of a series published more than once the last one counts, unless all are
    asked for. Whether there is any such series is told by the ledger alone.
    """
    if not exists(spark, f"{root}/series"):
        raise FileNotFoundError(f"no saved series under {root}")
    # Names are read as text: inferred as numbers, 007 would be 7.
    found = scan(spark, f"{root}/series").schema
    schema = T.StructType([T.StructField("batch", T.StringType()) if f.name == "batch" else f for f in found])
    attempts = ledger(spark, root)
    published = [r["batch"] for r in attempts.select("batch").distinct().collect()]  # one an attempt; prunes
    rows = scan(spark, f"{root}/series", schema).where(F.col("batch").isin(published))
    number = F.element_at(F.split("batch", ATTEMPT), -2).cast("long")
    rows = rows.withColumn("seq", number).drop("batch")
    if not latest or len(published) < 2 or "regime" not in rows.columns:
        return rows
    each = attempts.select(F.col("entity").alias("_e"), "seq", F.explode("regimes").alias("_r"))
    again = each.groupBy("_e", F.col("_r.regime").alias("_r")).agg(F.max("seq").alias("_last"), F.count_distinct("seq").alias("n"))
    again = again.where(F.col("n") > 1).drop("n")
    if again.isEmpty():
        return rows
    same = F.col("entity").cast("string").eqNullSafe(F.col("_e")) & F.col("regime").cast("string").eqNullSafe(F.col("_r"))
    kept = rows.join(again, same, "left").where(F.col("_last").isNull() | (F.col("seq") == F.col("_last")))
    return kept.drop("_e", "_r", "_last")


def resume(worklist: DataFrame, done: DataFrame) -> DataFrame:
    """Entries of the work list whose entity is not done yet."""
    keys = done.select("entity").where(F.col("entity").isNotNull()).distinct()
    return worklist.where(F.col("entity").isNotNull()).join(keys, "entity", "left_anti")


def with_markers(worklist: DataFrame, rows: DataFrame) -> DataFrame:
    """Every entry of the work list with its series rows; without any, one row with a NULL regime."""
    return worklist.join(rows, "entity", "left")


def without_markers(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("regime").isNotNull())


def progress(worklist: DataFrame, done: DataFrame) -> DataFrame:
    """One row: total, skipped, remaining, saved entities and whether the list is complete."""
    keys = done.select("entity").distinct().withColumn("hit", F.lit(True))
    flagged = worklist.select("entity").join(keys, "entity", "full_outer").withColumn(
        "saved", F.coalesce("hit", F.lit(False))
    )
    listed = worklist.select("entity").distinct().withColumn("listed", F.lit(True))
    both = flagged.join(listed, "entity", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    counts = both.agg(
        F.count_if("listed").alias("total"),
        F.count_if(F.col("listed") & F.col("saved")).alias("skipped"),
        F.countDistinct(F.when(F.col("saved"), F.col("entity"))).alias("saved_entities"),
    )
    return counts.select(
        "total",
        "skipped",
        (F.col("total") - F.col("skipped")).alias("remaining"),
        "saved_entities",
        (F.col("saved_entities") >= F.col("total")).alias("complete"),
    )


def chosen_mode(worklist: DataFrame, root: str) -> str:
    """What ``auto`` stands for: a store that has every entry of the work list is taken as it is, others are continued."""
    done = ledger(worklist.sparkSession, root)
    return "resume" if done.isEmpty() or not resume(worklist, done).isEmpty() else "reuse"


def ingest(
    rows_of: Callable[[DataFrame], DataFrame],
    worklist: DataFrame,
    root: str,
    mode: str = "resume",
    batch: str = "0",
    parts: int = 1,
) -> DataFrame:
    """Fill the store and return its series rows.

    ``rows_of`` maps the work list still to do to series rows. ``fresh`` starts
    over, ``resume`` adds what is missing, ``reuse`` takes the saved rows as they
    are, ``auto`` is one of the last two. The work is published in ``parts``, each
    when it is done, so an interruption loses one of them at most.
    """
    spark = worklist.sparkSession
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: {', '.join(MODES)}")
    if mode == "auto":
        mode = chosen_mode(worklist, root)
    if mode == "reuse":
        return saved_series(spark, root)
    into, todo = generation(spark, root), worklist
    if mode == "fresh":
        # Beyond any generation that an attempt has begun.
        begun = _all_attempts(spark, root).agg(F.max("generation")).first()[0]
        into = max(into, into if begun is None else begun) + 1
    else:
        todo = resume(worklist, ledger(spark, root))
    for part in range(parts):
        own = todo if parts == 1 else todo.where(F.pmod(F.xxhash64("entity"), F.lit(parts)) == part)
        append_batch(rows_of(own), own, root, batch if parts == 1 else f"{batch}.{part}", into)
    if mode == "fresh":
        add_line(spark, f"{root}/generations", {"generation": into})
    return saved_series(spark, root)
