"""Corpus-wide totals of 64-bit keys, asked for by chunks of documents.

Rows are dealt to chunks by a hash of their content, so a chunk is the same
whenever it is computed. A chunk adds its keys up and sends each distinct one
once, as sorted arrays cut by key range; the task of a range adds them over all
chunks and answers each with the totals in the order of its request. A key that
occurs everywhere thus costs one entry a chunk, and no task sees more than a range
of the keys. Chunks and ranges grow in number with the bytes of text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.llm.caches import only

CHUNK_BYTES = 1 << 20
RANGE_BYTES = 12 << 20  # of text; about as many keys as an eighth of this
PARTITION_CHUNKS = 32


@dataclass(frozen=True)
class Deal:
    chunks: int
    ranges: int

    @property
    def partitions(self) -> int:
        return max(8, -(-self.chunks // PARTITION_CHUNKS))


def deal(docs: DataFrame, text: str = "text") -> Deal:
    """Sizes from one narrow aggregation over the texts' lengths."""
    n = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    return Deal(max(1, -(-n // CHUNK_BYTES)), max(1, -(-n // RANGE_BYTES)))


def chunked(rows: DataFrame, keys: list[str], deal: Deal) -> DataFrame:
    """*rows* with their chunk; equal rows share one."""
    return rows.withColumn("_chunk", F.pmod(F.xxhash64(*keys), F.lit(deal.chunks))).repartition(deal.partitions, "_chunk")


def cut_by_range(keys: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the parts of sorted keys that have any."""
    width = (1 << 64) // ranges + 1
    edges = np.array([i * width for i in range(1, ranges)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
    return [(i, a, b) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def requests(rows: DataFrame, deal: Deal, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(range, chunk, keys, counts): *keys_of* gives a chunk's sorted distinct keys and their counts."""
    ranges = deal.ranges

    def ask(table: pa.Table) -> pa.Table:
        only("words")
        keys, counts = keys_of(table)
        chunk = table["_chunk"][0].as_py()
        parts = cut_by_range(keys, ranges)
        return pa.table({
            "range": pa.array([i for i, _, _ in parts], pa.int32()),
            "chunk": pa.array([chunk] * len(parts), pa.int64()),
            "keys": pa.array([keys[a:b].tobytes() for _, a, b in parts], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for _, a, b in parts], pa.binary()),
        })

    return rows.groupBy("_chunk").applyInArrow(_annotated(ask), "range int, chunk long, keys binary, counts binary")


def added(table: pa.Table, count_type: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Distinct keys and totals of a range, the place of each request's entries among them, and their ends."""
    blobs = table["keys"].to_pylist()
    keys = np.frombuffer(b"".join(blobs), np.uint64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), count_type).astype(np.int64)
    distinct, place = np.unique(keys, return_inverse=True)
    totals = np.bincount(place, counts, len(distinct)).astype(np.int64)
    return distinct, totals, place, np.cumsum([len(b) // 8 for b in blobs]).tolist()


def answers(asked: DataFrame, deal: Deal, count_type: str, answer_type: str) -> DataFrame:
    """(chunk, range, totals): totals beyond the answer's type are its greatest number."""

    def answer(table: pa.Table) -> pa.Table:
        _, totals, place, ends = added(table, count_type)
        each = np.minimum(totals, np.iinfo(answer_type).max).astype(answer_type)[place]
        return pa.table({
            "chunk": table["chunk"],
            "range": table["range"],
            "totals": pa.array([each[a:b].tobytes() for a, b in zip([0, *ends], ends)], pa.binary()),
        })

    # The ranges are numbered, so they need no hash to be dealt evenly.
    parts = asked.repartitionById(deal.ranges, F.col("range"))
    return parts.groupBy("range").applyInArrow(_annotated(answer), "chunk long, range int, totals binary")


def resolved(
    rows: DataFrame, replies: DataFrame, deal: Deal, use: Callable[[pa.Table, bytes], pa.Table], schema: str
) -> DataFrame:
    """*use* of every chunk's rows with its totals, joined in the order of its keys."""

    def meet(table: pa.Table, replied: pa.Table) -> pa.Table:
        if not table.num_rows:
            raise ValueError("an answer without its chunk")
        only("words")
        order = np.argsort(replied["range"].to_numpy()) if replied.num_rows else []
        totals = replied["totals"].to_pylist() if replied.num_rows else []
        return use(table, b"".join(totals[i] for i in order))

    meet.__annotations__ = {"table": pa.Table, "replied": pa.Table, "return": pa.Table}
    back = replies.withColumnRenamed("chunk", "_chunk").repartition(deal.partitions, "_chunk")
    return rows.groupBy("_chunk").cogroup(back.groupBy("_chunk")).applyInArrow(meet, schema)


def _annotated(f):
    f.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return f
