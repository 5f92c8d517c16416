"""Scores by provider; an extension, since the metric itself ends at single tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_missing(truth: DataFrame, predictions: DataFrame, *keys: str) -> DataFrame:
    """Every ground truth with its prediction, null where there is none."""
    return truth.join(predictions, list(keys), "left")


def leaderboard(scores: DataFrame, *by: str, score: str = "score") -> DataFrame:
    """Number, mean, least, greatest and median score; tables without a score are counted apart."""
    return scores.groupBy(*by).agg(
        F.count("*").alias("tables"),
        F.count_if(F.col(score).isNull()).alias("unscored"),
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.percentile_approx(score, 0.5, 10000).alias("median_score"),
    )
