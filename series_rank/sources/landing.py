"""Landed series files and pages as tables.

Folders that every machine mounts (``file:``) are listed and read by the tasks
themselves: Spark's reader lists every path that it is given, in jobs of up to
10,000 tasks, and holds the whole listing in the driver, which takes longer than
reading files of a few kilobytes. Other file systems, streams and compressed
files go through Spark's reader.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from series_rank.functions.text import page_metrics, page_text, split_label

# Fixed value: entity and regime in the name of a landed series file.
FILE_NAME = r"xf-(.+)-([0-9]+)\.csv$"

FILES_PER_TASK = 256
LISTING_TASKS = 64
BATCH_BYTES = 4 << 20
# The extensions that Spark's reader decompresses.
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".zstd", ".xz")


def _named(path: Column, name_pattern: str) -> list[Column]:
    return [
        F.nullif(F.regexp_extract(path, name_pattern, n), F.lit("")).alias(c) for n, c in ((1, "entity"), (2, "regime"))
    ]


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path as the tasks can open it, None where it is not on a mounted file system."""
    scheme, colon, rest = path.partition(":")
    if colon and "/" not in scheme:
        return "/" + rest.lstrip("/") if scheme == "file" else None
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return os.path.abspath(path) if default.startswith("file:") else None


def landed_files(
    spark: SparkSession, folder: str | Sequence[str], name_pattern: str = FILE_NAME, stream: bool = False
) -> DataFrame:
    """(entity, regime, raw) of every file in a folder, or of the listed files; each file is one value."""
    if not stream and not isinstance(folder, str):
        paths = [mounted(spark, p) for p in folder]
        if paths and None not in paths and not any(p.endswith(COMPRESSED) for p in paths):
            files = _contents(spark, paths)
            named = _named(F.url_decode("path"), name_pattern)
            return files.select(*named, F.col("raw").cast("string").alias("raw")).where(F.col("entity").isNotNull())
    reader = spark.readStream if stream else spark.read
    files = reader.format("text").option("wholetext", "true").load(folder)
    named = _named(F.url_decode(F.col("_metadata.file_path")), name_pattern)
    return files.select(*named, F.col("value").alias("raw")).where(F.col("entity").isNotNull())


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, raw) of the mounted files that are not empty, opened once each by the tasks."""
    most = BATCH_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0
        for batch in batches:
            for path in batch["path"].to_pylist():
                with open(path, "rb") as f:
                    raw = f.read()
                if raw:
                    held.append((path, raw))
                    size += len(raw)
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["path", "raw"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], ["path", "raw"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.repartition(-(-len(paths) // FILES_PER_TASK)).mapInArrow(read, "path string, raw binary")


def file_index(spark: SparkSession, folder: str, name_pattern: str = FILE_NAME) -> DataFrame:
    """(entity, regime, path, size, modified) of the files below a folder, from its listing; no file is opened."""
    top = mounted(spark, folder)
    if top is not None and not any(c in folder for c in "*?[{"):
        listed = _listing(spark, top)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        listed = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    named = _named(F.url_decode("path"), name_pattern)
    return listed.select(*named, "path", "size", "modified").where(F.col("entity").isNotNull())


def _listing(spark: SparkSession, top: str) -> DataFrame:
    """(path, size, modified) below a mounted folder: what lies in it is dealt to tasks, which list the folders among it."""

    def visible(name: str) -> bool:  # as for Spark's reader
        return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["path"].to_pylist():
                paths = [folder]
                if os.path.isdir(folder):
                    paths = [e.path for e in os.scandir(folder) if visible(e.name)]
                for at in range(0, len(paths), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(paths[at : at + 10_000], pa.string())], ["path"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "size", "modified"]
        types = [pa.string(), pa.int64(), pa.timestamp("us", "UTC")]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows: list[tuple] = []
        for batch in batches:
            todo = batch["path"].to_pylist()
            while todo:
                path = todo.pop()
                if os.path.isdir(path):
                    todo += [e.path for e in os.scandir(path) if visible(e.name)]
                    continue
                found = os.stat(path)
                if found.st_size:
                    rows.append((f"file:{path}", found.st_size, found.st_mtime_ns // 1_000_000 * 1000))
                if len(rows) == 10_000:
                    yield table(rows)
                    rows = []
        if rows:
            yield table(rows)

    start = spark.createDataFrame([(top,)], "path string").coalesce(1)
    within = start.mapInArrow(look, "path string").repartition(LISTING_TASKS)
    return within.mapInArrow(walk, "path string, size long, modified timestamp")


def worklist(links: DataFrame, key: Column) -> DataFrame:
    """(entity, desc) from the links of a listing page."""
    _, desc = split_label(F.col("label"))
    return links.select(key.alias("entity"), desc.alias("desc")).where(F.col("entity").isNotNull())


def attributes_of_pages(pages: DataFrame, entity: str, html: str, **kwargs) -> DataFrame:
    text = pages.select(F.col(entity).alias("entity"), page_text(F.col(html)).alias("_text"))
    return text.select("entity", *(c.alias(n) for n, c in page_metrics(F.col("_text"), **kwargs).items()))


def enumerate_series(
    work: DataFrame, parsed: DataFrame, regimes: Sequence[str], attributes: DataFrame | None = None
) -> DataFrame:
    """Parsed series of the listed entities and regimes, with description and attributes.

    Regimes without a file give no row; entities without attributes keep NULLs.
    """
    rows = parsed.where(F.col("regime").isin(list(regimes))).join(work, "entity")
    return rows if attributes is None else rows.join(attributes, "entity", "left")
