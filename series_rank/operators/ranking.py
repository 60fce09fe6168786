"""Global rank, top-k and reports."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000
PERCENTILE_ACCURACY = 100_000


def _splits(bounds: Sequence[float]) -> list[float]:
    """Ends of the ranges: every finite bound has one that holds nothing else.

    A value frequent enough to fill a bucket is itself a quantile, so all rows of
    its bucket tie. Neighbouring doubles share an end.
    """
    ends = {x for b in bounds for x in (b, math.nextafter(b, math.inf)) if math.isfinite(x)}
    return [-math.inf, *sorted(ends), math.inf] if ends else []


def _bucketed(df: DataFrame, score: str, splits: Sequence[float]) -> DataFrame:
    """Add ``_bucket``, the number of the range between two of *splits*."""
    if not splits:
        return df.withColumn("_bucket", F.lit(0))
    bucketizer = Bucketizer(splits=list(splits), inputCol=score, outputCol="_bucket")
    return bucketizer.transform(df).withColumn("_bucket", F.col("_bucket").cast("int"))


def _numbers(values: Iterable[int]) -> Column:
    """A literal array, as one constant however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _sizes(scored: DataFrame) -> dict[int, int]:
    return {r["_bucket"]: r["count"] for r in scored.groupBy("_bucket").count().collect()}


def _quantiles_inside(scored: DataFrame, score: str, large: dict[int, int], rows_per_task: int) -> set[float]:
    """Quantiles of the rows of the buckets that hold too many."""
    parts = max(-(-n // rows_per_task) for n in large.values())
    fractions = [i / parts for i in range(1, parts)]
    rows = scored.where(F.col("_bucket").isin(list(large))).groupBy("_bucket").agg(
        F.percentile_approx(score, fractions, PERCENTILE_ACCURACY).alias("q")
    )
    return {x for r in rows.collect() for x in r["q"]}


def global_rank(
    df: DataFrame,
    score: str,
    out: str,
    ascending: bool = False,
    key: str = "entity",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rank of every row over the whole table; ties share the smallest rank.

    Quantiles of the score cut the table into value ranges; a row's rank is the
    number of rows in better ranges plus its rank inside its own. Ranges that turn
    out too large are cut again by quantiles of their own rows. Every range is a
    partition of its own, and rows that tie over more than one are spread over as
    many as they need, so no task has more than about twice ``rows_per_task``,
    whatever the number of shuffle partitions is set to. The cut points
    are literals, so every pass and every recomputed task sees the same ranges.
    Rows without a score get no rank. The table is passed over up to four times, once
    more for ranges cut again; materialise the scores first when they are expensive.
    """
    df = df.withColumn(score, F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double")) + F.lit(0.0))
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.count(score).alias("scored")).first()
    present = df.where(F.col(score).isNotNull())
    buckets = -(-found.scored // rows_per_task)
    if buckets > 1:
        fractions = [i / buckets for i in range(1, buckets)]
        bounds = set(df.agg(F.percentile_approx(score, fractions, PERCENTILE_ACCURACY)).first()[0])
        while True:
            splits = _splits(sorted(bounds))
            single = [math.nextafter(a, math.inf) == b for a, b in zip(splits, splits[1:])]
            scored = _bucketed(present, score, splits)
            sizes = _sizes(scored) if splits else {}
            large = {b: n for b, n in sizes.items() if not single[b] and n > 2 * rows_per_task}
            more = _quantiles_inside(scored, score, large, rows_per_task) if large else set()
            if more <= bounds:
                break
            bounds |= more
        ranked = _ranked_by_range(scored, score, out, ascending, key, rows_per_task, sizes, single)
    else:
        order = Window.orderBy(F.col(score).asc() if ascending else F.col(score).desc())  # rows of one task
        ranked = present.withColumn(out, F.rank().over(order).cast("long"))
    if found.rows == found.scored:
        return ranked
    return ranked.unionByName(df.where(F.col(score).isNull()).withColumn(out, F.lit(None).cast("long")))


def _ranked_by_range(
    scored: DataFrame, score: str, out: str, ascending: bool, key: str, rows_per_task: int, sizes: dict[int, int], single: Sequence[bool]
) -> DataFrame:
    n = max(len(single), 1)
    offsets, better = [0] * n, 0
    for b in sorted(sizes, reverse=not ascending):
        offsets[b], better = better, better + sizes[b]
    # All rows of a single-valued range tie at its first rank, however they are spread.
    shares = [-(-sizes.get(b, 0) // rows_per_task) if b < len(single) and single[b] else 1 for b in range(n)]
    shares = [max(1, s) for s in shares]
    firsts = [sum_ - s for sum_, s in zip(itertools.accumulate(shares), shares)]
    bucket = F.col("_bucket") + 1
    spread = F.pmod(F.xxhash64(key), F.element_at(_numbers(shares), bucket))
    placed = scored.withColumn("_task", (F.element_at(_numbers(firsts), bucket) + spread).cast("int"))
    placed = placed.repartitionById(sum(shares), F.col("_task"))
    inside = Window.partitionBy("_task").orderBy(F.col(score).asc() if ascending else F.col(score).desc())
    rank = F.element_at(_numbers(offsets), bucket) + F.rank().over(inside)
    return placed.withColumn(out, rank.cast("long")).drop("_bucket", "_task")


def topk(df: DataFrame, rank: str, k: int, key: str = "entity") -> DataFrame:
    """The k best rows; ties at the cut go by key."""
    return df.where(F.col(rank).isNotNull()).orderBy(rank, key).limit(k)


def sorted_by_rank(df: DataFrame, rank: str, key: str = "entity") -> DataFrame:
    return df.orderBy(F.col(rank).asc_nulls_last(), key)


def topn_report(rankings: Sequence[tuple[str, DataFrame, str]], n: int) -> DataFrame:
    """(method, place, entity, rank) of the first n rows of every ranking."""
    parts = []
    for method, ranking, rank in rankings:
        top = topk(ranking, rank, n).select(
            F.lit(method).alias("method"), "entity", F.col(rank).cast("long").alias("rank")
        )
        parts.append(top)
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    place = F.row_number().over(Window.partitionBy("method").orderBy("rank", "entity"))  # n rows per method
    return report.select("method", place.cast("long").alias("place"), "entity", "rank")
