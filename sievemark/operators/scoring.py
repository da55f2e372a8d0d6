"""Fit statistics of the components once, then score by a plain projection."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScorerConfig
from ..functions.entropy import scaled
from .quantiles import exact_quantiles


def component_stats(df: DataFrame, names: list[str]) -> dict[str, dict[str, float]]:
    """min, max, mean and population deviation of all components, in one aggregate."""
    row = df.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop)))).first()
    return {n: {k: row[f"{n}_{k}"] or 0.0 for k in ("min", "max", "mean", "std")} for n in names}


@dataclass(frozen=True)
class ScorerModel:
    config: ScorerConfig
    stats: dict[str, dict[str, float]]

    @staticmethod
    def fit(components: DataFrame, config: ScorerConfig = ScorerConfig()) -> ScorerModel:
        return ScorerModel(config, component_stats(components, list(config.weights())))

    def with_weights(self, **weights: float) -> ScorerModel:
        return replace(self, config=replace(self.config, **weights))

    def normalized(self, name: str) -> Column:
        return scaled(F.col(name), self.stats[name], self.config.normalization) if self.config.normalize else F.col(name)

    def score(self) -> Column:
        return sum((self.normalized(n) * w for n, w in self.config.weights().items()), F.lit(0.0))

    def transform(self, components: DataFrame) -> DataFrame:
        return components.withColumn("score", self.score())

    def detailed(self, components: DataFrame) -> DataFrame:
        columns = []
        for n, w in self.config.weights().items():
            columns += [F.col(n).alias(f"{n}_raw"), self.normalized(n).alias(f"{n}_normalized"), (self.normalized(n) * w).alias(f"{n}_weighted")]
        return components.select("sample_id", *columns, self.score().alias("total_score"))


def analyze(df: DataFrame, names: list[str]) -> DataFrame:
    """Long table component, mean, std, min, max, median."""
    row = df.agg(*(f(n).alias(f"{n}_{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)))).first()
    median = exact_quantiles(df, names, [0.5])
    rows = [(n, *(row[f"{n}_{k}"] for k in ("mean", "std", "min", "max")), *(median[n] or [None])) for n in names]
    return df.sparkSession.createDataFrame(rows, "component string, mean double, std double, min double, max double, median double")


def score_percentiles(df: DataFrame, score: str = "score", at: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    values = exact_quantiles(df, [score], [p / 100 for p in at])[score] or [None] * len(at)
    return df.sparkSession.createDataFrame(list(zip(at, values, strict=True)), "percentile int, value double")
