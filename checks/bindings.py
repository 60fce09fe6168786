"""Bindings of the test tables to the vocabulary of the library."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from series_rank.config import Bounds
from series_rank.functions.text import SeriesFormat
from series_rank.operators.points import as_points
from series_rank.session import materialize
from series_rank.sources.landing import mounted

REGIMES = ["A", "N", "R"]
LANDED_REGIMES = ["200000", "500000", "1000000"]
BOUNDS = [Bounds("attr_a", 500.0, 9000.0), Bounds("attr_b", 2.0, 22.0)]
LAYOUT = SeriesFormat()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supplier_points(
    spark: SparkSession, sf_dir: str, entity: str = "l_suppkey", y: Column | None = None, d: Column | None = None
) -> DataFrame:
    """Shipments of a supplier (or part, or order) by return flag, in date order."""
    li = table(spark, sf_dir, "lineitem")
    return as_points(
        li,
        entity=F.col(entity),
        regime=F.col("l_returnflag"),
        order=[F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")],
        x=F.datediff("l_shipdate", F.lit("1995-07-01").cast("date")),
        y=F.col("l_extendedprice") - 20000 if y is None else y,
        d=F.col("l_extendedprice") / F.col("l_quantity") if d is None else d,
        m=F.col("l_tax") - 0.04,
    )


def supplier_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance (missing where negative) and nation of each supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("entity"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("attr_a"),
        F.col("s_nationkey").cast("double").alias("attr_b"),
    )


def landed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three series per embedding, as arrays of whole numbers: one row per (vector, regime).

    y is the vector in millionths, rotated by 21 places per regime; x counts from
    -16; d and m follow from place and value.
    """
    # Few but heavy rows: spread them, as a folder of landed files would be.
    spread = table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id")
    vectors = spread.select(
        F.col("vec_id"),
        F.expr("transform(embedding, v -> cast(floor(cast(v as double) * 1000000) as bigint))").alias("v"),
        F.expr("posexplode(array('200000', '500000', '1000000'))").alias("k", "regime"),
    )
    rotated = vectors.withColumn("y", F.expr("transform(v, (u, i) -> v[(i + 21 * k) % size(v)])"))
    series = rotated.select(
        F.col("vec_id"),
        F.col("vec_id").cast("string").alias("entity"),
        "regime",
        F.expr("transform(y, (u, i) -> cast(i - 16 as bigint))").alias("x"),
        "y",
        F.expr("transform(y, (u, i) -> 1000 + 10 * i + abs(u) % 97)").alias("d"),
        F.expr("transform(y, (u, i) -> y[(i + 7) % size(y)])").alias("m"),
    )
    return materialize(series, "landed-series")


def landed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every series above written out as a landed file, with damage of each kind.

    Some lines get an extra cell, some lose their last two, some cells read n/a,
    some are quoted, some of them with a comma inside; some files miss a header key or a required column; some
    files, and all files of some vectors, are absent.
    """
    s = landed_series(spark, sf_dir)
    row = """
        concat_ws(',', cast(x[i] as string),
          if(i % 9 = 4, concat('"', cast(u as string), '"'), cast(u as string)),
          if(vec_id % 5 = 2 and (vec_id * 7 + i) % 29 = 11, 'n/a', cast(d[i] as string)),
          cast(i as string), cast(m[i] as string),
          if((vec_id + i) % 17 = 3, null, if((vec_id + i) % 19 = 6, '"0,5"', '0.5')), if((vec_id + i) % 17 = 3, null, '1.'),
          if((vec_id + i) % 13 = 5, 'extra', null))
    """
    header = """
        concat_ws('\n', 'Landed series', concat('Key,', entity, '-', regime), concat('Entity,', entity),
          concat('Regime,', regime), 'Ncrit,9', 'Mach,"0,0"',
          if(vec_id % 11 = 4, 'Other,1', concat('Max Cl/Cd,', cast(array_max(y) as string))),
          concat('Max Cl/Cd alpha,', cast(vec_id % 16 as string)), 'Url,a,b', '',
          if(vec_id % 19 = 6, 'Alpha,Cl,Cd,Cdp,Cm,Top_Xtr', 'Alpha,Cl,Cd,Cdp,Cm,Top_Xtr,Bot_Xtr'))
    """
    present = "vec_id % 31 <> 9 and not (vec_id % 23 = 8 and regime = '1000000')"
    texts = s.where(present).select(
        "entity",
        "regime",
        F.expr(f"concat({header}, '\n', array_join(transform(y, (u, i) -> {row}), '\n'), '\n')").alias("raw"),
    )
    return materialize(texts, "landed-texts")


FILE_IN_FOLDER = r"/name=xf-([^/]+)-([0-9]+)\.csv/[^/]+$"
PAGE_BOUNDS = [Bounds("attr_a_value", 2.0, 20.0), Bounds("attr_b_value", 1.0, None)]


SHARDS = 256


def landed_folder(spark: SparkSession, texts: DataFrame, folder: str, mode: str = "error") -> str:
    """The texts as files, each in a folder of its name, and these dealt to folders that can be listed side by side.

    On file systems that the tasks cannot open, and to add to a folder, the files are those that Spark writes.
    """
    name = F.concat(F.lit("xf-"), "entity", F.lit("-"), "regime", F.lit(".csv"))
    named = texts.select("raw", name.alias("name"))
    top = mounted(spark, folder)
    if top is None or mode != "error":
        named.write.partitionBy("name").mode(mode).text(folder)
        return folder
    shards = SHARDS

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written, part = set(), TaskContext.get().partitionId()
        for batch in batches:
            for name, raw in zip(batch["name"].to_pylist(), batch["raw"].to_pylist()):
                own = f"{top}/shard={zlib.crc32(name.encode()) % shards}/name={quote(name, safe='')}"
                if own not in written:
                    os.makedirs(own, exist_ok=True)
                # A task that is run again writes its files anew.
                with open(f"{own}/part-{part:05d}.txt", "ab" if own in written else "wb") as f:
                    f.write((raw or b"") + b"\n")
                written.add(own)
        yield pa.RecordBatch.from_arrays([pa.array([len(written)])], ["files"])

    rows = named.where("name is not null").select("name", F.col("raw").cast("binary").alias("raw"))
    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return folder


def landed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, html): the vectors listed fifty a page in the second table, some twice and some not at all."""
    listed = table(spark, sf_dir, "embeddings").where("vec_id % 29 <> 3")
    row = F.concat(
        F.lit("<tr><td><a href='/d?item="), "vec_id", F.lit("'> "), "vec_id", F.lit(" - label <b>"), "label",
        F.lit("</b> &amp; more</a></td><td><a href=''>none</a></td></tr>"),
    )
    pages = F.when(F.col("vec_id") % 41 == 7, F.array((F.col("vec_id") / 50).cast("long"), F.lit(1_000_000).cast("long")))
    placed = listed.select(F.explode(F.coalesce(pages, F.array((F.col("vec_id") / 50).cast("long")))).alias("page"), "vec_id", row.alias("row"))
    grouped = placed.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("rows"))
    rows = F.array_join(F.transform("rows", lambda r: r["row"]), "")
    menu = "<html><table><tr><td><a href='/d?item=menu'>menu - none</a></td></tr></table><table>"
    return grouped.select("page", F.concat(F.lit(menu), rows, F.lit("</table></html>")).alias("html"))


def landed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, html): a page of measures for every vector; some lack one of them."""
    html = F.concat(
        F.lit("<p>Max thickness <b>"), (F.col("vec_id") % 23).cast("string"), F.lit(".5%</b> at 30% chord</p>"),
        F.when(F.col("vec_id") % 37 == 5, F.lit("")).otherwise(
            F.concat(F.lit("<p>Max camber "), (F.col("vec_id") % 13).cast("string"), F.lit("% at 40.5% chord</p>"))
        ),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entity"), html.alias("html"))


def landed_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The work list: every vector, described by its label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("entity"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("desc")
    )
