"""The whole run as stages over saved tables.

Every stage is a function of the tables before it. It saves its tables under one
root and switches to all of them at once, with the parameters it was run with
(see ``sources.stages``), so any suffix of the run can be repeated from what an
earlier run left behind; a table that does not fit the parameters any more is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from series_rank.config import Params
from series_rank.operators.models import factor_models, factor_table, scaled_models, scaled_table, score_rows
from series_rank.operators.pool import candidate_pool, final_ranking, final_summary
from series_rank.operators.ranking import sorted_by_rank
from series_rank.operators.rankers import Fits, method
from series_rank.operators.wide import entity_table, split_tagged, tag_entities
from series_rank.plans.ingest import Landed, ingest_landed, saved_features
from series_rank.sources.stages import Stages, rows_count

STAGES = ("analyse", "filter", "rank", "final")
ALL_STAGES = ("ingest", *STAGES)
REJECTING = ("validation", "features", "attributes", "range")


@dataclass
class Result:
    """Tables of the run; those no chosen stage wrote or read stay None."""

    entities: DataFrame | None = None
    features: DataFrame | None = None
    rejects: DataFrame | None = None
    rankings: dict[str, DataFrame] = field(default_factory=dict)
    final: DataFrame | None = None
    summary: DataFrame | None = None


def stage_params(params: Params) -> dict[str, dict]:
    """The parameters each stage depends on, those of the stages before it included."""
    own = {
        "analyse": {"regimes": list(params.regimes), "min_series": params.min_series, "min_fall_points": params.min_fall_points},
        "filter": {"bounds": [asdict(b) for b in params.bounds], "required_attributes": params.attribute_columns},
        "rank": {
            "max_factors_lower": params.max_factors_lower,
            "max_factors_higher": params.max_factors_higher,
            "max_factors_joint": params.max_factors_joint,
            "on_constant": params.on_constant,
        },
        "final": {"methods": list(params.methods), "top_n": params.top_n, "weights": params.weight_map},
    }
    out, before = {}, {}
    for stage in STAGES:
        before = before | own[stage]
        out[stage] = before
    return out


def _counts() -> dict[str, Column]:
    return {s: F.count_if(F.col("stage") == s) for s in REJECTING} | rows_count()


def run(
    spark: SparkSession,
    root: str,
    params: Params,
    series: DataFrame | None = None,
    attributes: DataFrame | None = None,
    stages: Sequence[str] | None = None,
    landed: Landed | None = None,
    mode: str = "auto",
) -> Result:
    """Run the chosen stages (by default all); the tables of the others are read from *root*.

    ``landed`` tells where series come from and is what the stage ``ingest``
    takes up, in the given ``mode``; the stages after it then use the series and
    attributes that the store and that stage hold. Without it, ``series`` has one
    row per series with counts and features (from the points or the arrays layout)
    and is needed by the stage ``analyse``; ``attributes`` has one row per entity
    and is used by ``filter``.
    """
    stages = (STAGES if landed is None else ALL_STAGES) if stages is None else stages
    unknown = set(stages) - set(ALL_STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    if "ingest" in stages and landed is None:
        raise ValueError("the stage ingest needs to know what has landed")
    last = max((STAGES.index(s) for s in stages if s in STAGES), default=-1)
    saved, needs, result = Stages(spark, root), stage_params(params), Result()

    def earlier(table: str, stage: str) -> DataFrame:
        saved.check(table, needs[stage])
        return saved.read(table)

    if "ingest" in stages:
        series, attributes = ingest_landed(spark, saved, landed, params.regimes, mode)
    elif attributes is None and "filter" in stages and saved.has("attributes"):
        attributes = saved.read("attributes")

    if "analyse" in stages:
        if series is None:
            try:
                series = saved_features(spark, root)
            except FileNotFoundError as error:
                raise ValueError("the stage analyse needs series") from error
        table = entity_table(series, params.regimes, params.min_series, params.min_fall_points)
        result.entities = saved.write("entities", table, rows_count())
        saved.commit("analyse", needs["analyse"])
    elif "filter" in stages:
        result.entities = earlier("entities", "analyse")

    if "filter" in stages:
        tagged = tag_entities(result.entities, params.regimes, attributes, params.attribute_columns, params.bounds)
        # Kept and rejected entities come from one pass and are told apart by folder.
        tagged = saved.write("tagged", tagged, _counts(), partition_by=["kept"])
        saved.commit("filter", needs["filter"], ["entities"])
        result.features, result.rejects = split_tagged(tagged)
    elif last > STAGES.index("filter"):
        result.features, result.rejects = split_tagged(earlier("tagged", "filter"))

    fits = Fits(result.features, params) if "rank" in stages else None
    for name in params.methods:
        if "rank" in stages:
            ranked = method(name).apply(result.features, params, fits)
            result.rankings[name] = saved.write(f"rank_{name}", ranked, rows_count())
        elif "final" in stages:
            result.rankings[name] = earlier(f"rank_{name}", "rank")
    if "rank" in stages:
        if fits.factors:
            saved.write("factor_models", factor_table(spark, fits.factors))
        if fits.scaled:
            saved.write("scaled_models", scaled_table(spark, fits.scaled))
        saved.commit("rank", needs["rank"], ["tagged"])

    if "final" in stages:
        rankings = result.rankings
        nominators = [(method(n).label, rankings[n], method(n).rank) for n in params.methods]
        ranks = [(method(n).summary_column, rankings[n], method(n).rank) for n in params.methods]
        pool = saved.write("pool", candidate_pool(result.features, nominators, params.top_n), rows_count())
        final = final_ranking(pool, params.weight_map, params.columns, params.on_constant)
        result.final = saved.write("final", sorted_by_rank(final, "rank_final"))
        result.summary = saved.write("summary", sorted_by_rank(final_summary(result.final, ranks), "rank_final"))
        saved.commit("final", needs["final"], ["tagged", *(f"rank_{n}" for n in params.methods)])
    return result


def report(final: DataFrame) -> DataFrame:
    """Columns of the final report, best first."""
    return sorted_by_rank(final.select("rank_final", "entity", "score_final", "source_methods"), "rank_final")


def saved_scores(spark: SparkSession, root: str, features: DataFrame) -> DataFrame:
    """Scores of any wide rows by the models that the run under *root* fitted."""
    saved = Stages(spark, root)
    factors = factor_models(saved.read("factor_models")) if saved.has("factor_models") else {}
    scaled = scaled_models(saved.read("scaled_models")) if saved.has("scaled_models") else {}
    return score_rows(features, factors, scaled)


def stage_metrics(spark: SparkSession, root: str) -> DataFrame:
    """(stage, rows_in, kept, dropped) of the gate, completeness, attribute and range steps.

    Read from the commit of the stage ``filter``: the numbers were observed while its rows were written.
    """
    counts = Stages(spark, root).of("tagged").counts["tagged"]
    rows, before = [], counts["rows"]
    for stage in REJECTING:
        rows.append((stage, before, before - counts[stage], counts[stage]))
        before -= counts[stage]
    return spark.createDataFrame(rows, "stage string, rows_in long, kept long, dropped long")
