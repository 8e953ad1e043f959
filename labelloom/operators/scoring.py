"""From model outputs to bounded scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOWEST = 1e-15


def probability(margin: str | Column) -> Column:
    """Logistic probability of a margin."""
    m = F.col(margin) if isinstance(margin, str) else margin
    return 1 / (1 + F.exp(-m))


def bounded_margin(margin: str | Column) -> Column:
    """``0.5 + atan(margin)/pi``: increasing, inside (0, 1), 0.5 on the decision boundary."""
    m = F.col(margin) if isinstance(margin, str) else margin
    return 0.5 + F.atan(m) / F.pi()


def clip_scores(df: DataFrame, score: str = "score") -> DataFrame:
    """Keep scores inside [1e-15, 1 - 1e-15]."""
    return df.withColumn(score, F.least(F.greatest(F.col(score), F.lit(LOWEST)), F.lit(1.0 - LOWEST)))
