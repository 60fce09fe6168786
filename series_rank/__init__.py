"""Series features and multi-criteria ranking as Spark DataFrame jobs."""

from series_rank.config import FEATURES, LOWER_BETTER, Bounds, Params
from series_rank.plans.ingest import Landed
from series_rank.plans.pipeline import run, saved_scores
from series_rank.session import get_session

__all__ = ["FEATURES", "LOWER_BETTER", "Bounds", "Landed", "Params", "get_session", "run", "saved_scores"]
