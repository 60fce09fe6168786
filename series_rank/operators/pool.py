"""Candidate pool of several rankings, its weighted re-scoring and the summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.functions.stats import column_stats, linear, normalised, usable_columns
from series_rank.operators.ranking import global_rank, topk
from series_rank.operators.wide import direction_split


def nominations(rankings: Sequence[tuple[str, DataFrame, str]], top_n: int) -> DataFrame:
    """(entity, source_methods) of the first ``top_n`` rows of each (label, ranking, rank column)."""
    parts = [
        topk(ranking, rank, top_n).select("entity", F.lit(i).alias("o"), F.lit(label).alias("method"))
        for i, (label, ranking, rank) in enumerate(rankings)
    ]
    named = reduce(DataFrame.unionByName, parts)
    # One entry per method at most, so the list is as short as the list of methods.
    listed = F.array_sort(F.collect_list(F.struct("o", "method")))
    return named.groupBy("entity").agg(F.array_join(F.transform(listed, lambda s: s["method"]), ", ").alias("source_methods"))


def candidate_pool(features: DataFrame, rankings: Sequence[tuple[str, DataFrame, str]], top_n: int) -> DataFrame:
    """Feature rows of the nominated entities with the methods that named them."""
    # At most top_n rows per method on the broadcast side.
    return features.join(F.broadcast(nominations(rankings, top_n)), "entity")


def check_weights(columns: Sequence[str], weights: Mapping[str, float]) -> dict[str, float]:
    if set(columns) != set(weights):
        raise ValueError(
            f"weights do not match the feature columns; missing: {sorted(set(columns) - set(weights))}, "
            f"unknown: {sorted(set(weights) - set(columns))}"
        )
    return {c: float(weights[c]) for c in columns}


def rank_zscore_weighted(
    pool: DataFrame,
    weights: Mapping[str, float],
    columns: Sequence[str],
    lower: Sequence[str] | None = None,
    score: str = "score_final",
    rank: str = "rank_final",
    on_constant: str = "error",
) -> DataFrame:
    """Weighted sum of z-scores over the rows given, lower-better columns negated."""
    weights = check_weights(columns, weights)
    stats = column_stats(pool, columns)
    kept = usable_columns(stats, on_constant)
    low = set(direction_split(columns)[0] if lower is None else lower)
    share = normalised({c: weights[c] for c in kept})
    signed = [(-share[c] if c in low else share[c]) / stats[c].std for c in kept]
    scored = pool.withColumn(score, linear(kept, [stats[c].mean for c in kept], signed))
    return global_rank(scored, score, rank, ascending=False)


def final_ranking(
    pool: DataFrame, weights: Mapping[str, float], columns: Sequence[str], on_constant: str = "error"
) -> DataFrame:
    ranked = rank_zscore_weighted(pool, weights, columns, on_constant=on_constant)
    return ranked.select("entity", "score_final", "rank_final", "source_methods")


def final_summary(final: DataFrame, rankings: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """The final ranking with the rank of each method; ``rankings`` are (summary column, table, rank column).

    The final table holds a shortlist, so it is the broadcast side of each join
    (only its keys travel) and the ranking tables are read in place.
    """
    summary = final
    keys = F.broadcast(final.select("entity"))
    for name, ranking, rank in rankings:
        ranks = ranking.select("entity", F.col(rank).alias(name)).join(keys, "entity", "left_semi")
        summary = summary.join(ranks, "entity", "left")
    return summary
