"""Single-round selection: threshold, percentile, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SelectorConfig
from ..sources.ingest import numbered
from .quantiles import exact_quantiles


def select(df: DataFrame, config: SelectorConfig, score: str = "score", order: str = "sample_ord") -> DataFrame:
    """Rows over the threshold (strictly), at or over a percentile (linear), or the k best (ties by order; 0 gives none)."""
    if config.mode == "threshold":
        return df.where(F.col(score) > config.threshold)
    if config.mode == "percentile":
        cut = exact_quantiles(df, [score], [1 - config.percentile / 100])[score]
        return df.where(F.col(score) >= cut[0]) if cut else df.where(F.lit(False))
    if config.mode == "top_k":
        return df.orderBy(F.desc(score), order).limit(config.top_k)
    raise ValueError(f"unknown mode {config.mode}")


def select_indices(df: DataFrame, config: SelectorConfig, score: str = "score", order: str = "sample_ord") -> DataFrame:
    """order and place (from 1) of the selected rows: by their order where a threshold or percentile selects, the k best by
    rising score (ties by order)."""
    chosen = select(df, config, score, order)
    if config.mode == "top_k":  # at most k rows
        return chosen.select(order, F.row_number().over(Window.orderBy(score, order)).cast("long").alias("place"))
    return numbered(chosen.select(order), order, "place").withColumn("place", F.col("place") + 1)


def retention_rate(kept: Column) -> Column:
    return F.coalesce(F.avg(kept.cast("double")), F.lit(0.0))
