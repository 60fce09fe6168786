"""Ranking methods over the wide feature table, and the registry of methods.

A method takes ``(features, params)`` and returns a table with ``entity``, its
scores and one rank column (1 = best). Methods pass over the table more than
once: give them a materialised one. They write the scores once and rank from
that narrow table. What the built-in methods need to know of the table (column
statistics, the correlation matrix) is found once a run and shared.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from series_rank.config import Params
from series_rank.functions.stats import ColumnStats, ScaledModel, fit_scaled
from series_rank.operators.factor import FactorModel, Moments, fit_factors, moments
from series_rank.operators.ranking import global_rank
from series_rank.operators.wide import complete_cases, direction_split
from series_rank.session import materialize


class Fits:
    """Complete cases of a table and their moments, found when first asked for."""

    def __init__(self, features: DataFrame, params: Params) -> None:
        self.columns = params.columns
        self.factors: dict[str, FactorModel] = {}  # what was fitted, by name
        self.scaled: dict[str, ScaledModel] = {}
        self.cases = complete_cases(features.select("entity", *self.columns), self.columns)

    @cached_property
    def moments(self) -> Moments:
        return moments(self.cases, self.columns)


def rank_factor(features: DataFrame, params: Params, fits: Fits | None = None) -> DataFrame:
    """Factor composites of both directions; the ranks of the two are added up."""
    fits = fits or Fits(features, params)
    lower, higher = direction_split(fits.columns)
    low = fit_factors(fits.cases, lower, params.max_factors_lower, params.on_constant, fits.moments)
    high = fit_factors(fits.cases, higher, params.max_factors_higher, params.on_constant, fits.moments)
    fits.factors |= {"lower": low, "higher": high}
    scored = materialize(
        fits.cases.select("entity", low.composite().alias("score_L"), high.composite().alias("score_G")), "factor-scores"
    )
    ranked = global_rank(scored, "score_L", "rank_L", ascending=True)
    ranked = global_rank(ranked, "score_G", "rank_G", ascending=False)
    return ranked.withColumn("rank_sum", F.col("rank_L") + F.col("rank_G"))


def rank_by_variation(
    df: DataFrame,
    columns: Sequence[str],
    lower: Sequence[str],
    score: str,
    rank: str,
    on_constant: str = "error",
    ranges: Mapping[str, ColumnStats] | None = None,
    keep: Callable[[ScaledModel], None] | None = None,
) -> DataFrame:
    """Column shares after scaling and inversion, weighted by coefficient of variation. *keep* is given the model."""
    model = fit_scaled(df, columns, lower, on_constant, ranges)
    if keep:
        keep(model)
    scored = materialize(df.select("entity", model.score().alias(score)), score)
    return global_rank(scored, score, rank, ascending=False)


def rank_cv(features: DataFrame, params: Params, fits: Fits | None = None) -> DataFrame:
    fits = fits or Fits(features, params)
    lower, _ = direction_split(fits.columns)
    # Of the moments only the statistics are needed here, so alone this method asks for no more.
    known = fits.moments.stats if "moments" in fits.__dict__ else None
    keep = partial(fits.scaled.__setitem__, "cv")
    return rank_by_variation(fits.cases, fits.columns, lower, "score_cv", "rank_cv", params.on_constant, known, keep)


def rank_cv_factor(features: DataFrame, params: Params, fits: Fits | None = None) -> DataFrame:
    """Variation weighting of joint factor scores: first factor higher-better, the others lower-better."""
    fits = fits or Fits(features, params)
    model = fit_factors(fits.cases, fits.columns, params.max_factors_joint, params.on_constant, fits.moments)
    fits.factors["joint"] = model
    scores = model.scores()
    # A few columns in place of many: the passes that follow read this narrower table.
    factors = materialize(fits.cases.select("entity", *(c.alias(n) for n, c in scores.items())), "joint-factors")
    names = list(scores)
    keep = partial(fits.scaled.__setitem__, "cv_factor")
    return rank_by_variation(factors, names, names[1:], "score_cv_factor", "rank_cv_factor", params.on_constant, keep=keep)


@dataclass(frozen=True)
class Method:
    """A ranking method: its label in reports, the function and its rank column."""

    label: str
    ranker: Callable[..., DataFrame]
    rank: str
    summary_column: str
    shares: bool = False  # takes the fits of the run as well

    def apply(self, features: DataFrame, params: Params, fits: Fits | None = None) -> DataFrame:
        return self.ranker(features, params, fits) if self.shares else self.ranker(features, params)


_METHODS: dict[str, Method] = {}


def register(
    name: str,
    ranker: Callable[[DataFrame, Params], DataFrame],
    rank: str,
    label: str | None = None,
    summary_column: str | None = None,
    shares: bool = False,
) -> None:
    """Make a method available by name in ``Params.methods``; one that ``shares`` is given the run's ``Fits`` as well."""
    _METHODS[name] = Method(label or name, ranker, rank, summary_column or rank, shares)


def method(name: str) -> Method:
    if name not in _METHODS:
        raise KeyError(f"unknown ranking method {name!r}; known: {', '.join(_METHODS)}")
    return _METHODS[name]


register("factor", rank_factor, "rank_sum", summary_column="rank_factor", shares=True)
register("cv", rank_cv, "rank_cv", shares=True)
register("cv_factor", rank_cv_factor, "rank_cv_factor", label="cv-factor", shares=True)
