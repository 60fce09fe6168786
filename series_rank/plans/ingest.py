"""From listing pages and landed files to the series and attributes of a run.

    listing pages -> work list -> less what the store has done -> names of landed
    files -> contents of those files -> parsed series -> store

Which files to read is settled on their names alone: the listing of the folder is
joined with the work list after the ledger has been taken out of it, so files of
entities that are done are never opened. Files are read in parts of a bounded
number, and each part is published before the next begins.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from series_rank.functions.arrays import array_features
from series_rank.functions.text import LINK_KEY, PAGE_METRICS, SeriesFormat, extract_key, page_links, parse_series
from series_rank.session import materialize
from series_rank.sources import tables
from series_rank.sources.landing import FILE_NAME, attributes_of_pages, enumerate_series, file_index, landed_files, worklist
from series_rank.sources.stages import Stages

FILES_PER_PART = 20_000  # whose names the driver holds at a time
STORE = "store"


@dataclass(frozen=True)
class Landed:
    """Where the series of a run come from.

    ``listing`` holds pages (columns ``page``, anything orderable, and ``html``)
    whose links name the entities; ``files`` is the folder of series files;
    ``pages`` holds a page of attributes an entity (``entity``, ``html``).
    """

    listing: DataFrame
    files: str
    pages: DataFrame | None = None
    container: str = "table"
    occurrence: int = 1
    key_pattern: str = LINK_KEY
    name_pattern: str = FILE_NAME
    layout: SeriesFormat = field(default_factory=SeriesFormat)
    metrics: Mapping[str, str] = field(default_factory=lambda: dict(PAGE_METRICS))
    files_per_part: int = FILES_PER_PART

    def work(self) -> DataFrame:
        """(entity, desc) of every listed entity, once, described where it is listed first."""
        links = page_links(self.listing, "html", ["page"], self.container, self.occurrence)
        key = extract_key(F.col("href"), self.key_pattern).alias("entity")
        first = links.groupBy(key).agg(F.min_by("label", F.struct("page", "place")).alias("label"))
        return worklist(first, F.col("entity"))


def parts_of(work: DataFrame, index: DataFrame, files_per_part: int) -> int:
    """In how many parts the files of the work list are read."""
    n = index.join(work, "entity", "left_semi").agg(F.count(F.lit(1))).first()[0]
    return max(1, -(-n // files_per_part))


def fill_store(
    spark: SparkSession, root: str, landed: Landed, regimes: Sequence[str], mode: str = "auto", batch: str | None = None
) -> DataFrame:
    """Bring the store under *root* up to date in the given mode and return its series rows."""
    store = f"{root}/{STORE}"
    # Saved once: every part asks for them again.
    work = materialize(landed.work(), "work")
    if mode == "auto":
        mode = tables.chosen_mode(work, store)
    if mode == "reuse":
        return tables.saved_series(spark, store)
    index = file_index(spark, landed.files, landed.name_pattern).where(F.col("regime").isin(list(regimes)))
    index = materialize(index.select("entity", "path"), "index")

    def rows_of(todo: DataFrame) -> DataFrame:
        named = index.join(todo, "entity", "left_semi").select("path")
        paths = [r["path"] for r in named.collect()]  # about files_per_part
        # A schema of its own where there is nothing to read.
        files = landed_files(spark, paths, landed.name_pattern) if paths else spark.createDataFrame([], "entity string, regime string, raw string")
        return enumerate_series(todo, parse_series(files, layout=landed.layout), regimes)

    todo = work if mode == "fresh" else tables.resume(work, tables.ledger(spark, store))
    parts = parts_of(todo, index, landed.files_per_part)
    return tables.ingest(rows_of, work, store, mode, batch or uuid.uuid4().hex, parts)


def saved_features(spark: SparkSession, root: str) -> DataFrame:
    """Features of the series that the store under *root* holds."""
    return array_features(tables.saved_series(spark, f"{root}/{STORE}"))


def ingest_landed(
    spark: SparkSession, stages: Stages, landed: Landed, regimes: Sequence[str], mode: str = "auto"
) -> tuple[DataFrame, DataFrame | None]:
    """(series with features, saved attributes) of what has landed; the second is a table of the stage ``ingest``."""
    series = array_features(fill_store(spark, stages.root, landed, regimes, mode))
    attributes = None
    if landed.pages is not None:
        found = attributes_of_pages(landed.pages, "entity", "html", patterns=landed.metrics)
        attributes = stages.write("attributes", found, {"rows": F.count(F.lit(1)), "incomplete": _incomplete(found)})
        stages.commit("ingest", {"regimes": list(regimes), "mode": mode})
    return series, attributes


def _incomplete(df: DataFrame) -> Column:
    return F.count_if(F.expr(" or ".join(f"`{c}` is null" for c in df.columns if c != "entity")))
