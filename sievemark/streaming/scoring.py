"""A fitted scorer on a stream: the score is a function of the row's components, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.scoring import ScorerModel


def score_stream(components: DataFrame, model: ScorerModel, threshold: float | None = None) -> DataFrame:
    out = model.transform(components)
    return out if threshold is None else out.where(out["score"] > threshold)
