"""Incremental ingest of landed series files with Structured Streaming.

The stream's checkpoint remembers which files were taken; every micro-batch is
parsed and published to the series store under its own batch name, so of a batch
that is replayed after a failure only what is missing is published. A file that
lands again under another name or folder comes with a later batch, and its
series takes the place of the one before when the store is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from series_rank.functions.text import SeriesFormat, parse_series
from series_rank.sources.tables import append_batch


def ingest_stream(
    landed: DataFrame, root: str, layout: SeriesFormat | None = None, raw: str = "raw"
) -> StreamingQuery:
    """Take every file that has landed so far and stop. *landed* is a streaming (entity, regime, raw)."""

    def publish(batch: DataFrame, epoch: int) -> None:
        append_batch(parse_series(batch, raw, layout), batch.select("entity"), root, f"epoch-{epoch}")

    return (
        landed.where(F.col("entity").isNotNull())
        .writeStream.foreachBatch(publish)
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )
