"""Self-information of a sample under the joint distribution of its discretised features, counted sparsely."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON
from ..functions.entropy import edge_count
from .quantiles import exact_quantiles
from .shuffles import skew_join


@dataclass(frozen=True)
class CellInformation:
    """Quantile edges of the features; edge_mode `reference` looks cells up by edges with repeats, `consistent` without."""

    names: tuple[str, ...]
    edges: dict[str, list[float]]
    bins: int = 32
    smoothing: float = 1e-10
    edge_mode: str = "consistent"

    @staticmethod
    def fit(features: DataFrame, names: tuple[str, ...], bins: int = 32, edge_mode: str = "consistent") -> CellInformation:
        edges = exact_quantiles(features, list(names), [i / bins for i in range(bins + 1)])
        return CellInformation(tuple(names), {n: edges[n] or [0.0] for n in names}, bins, edge_mode=edge_mode)

    def _bin(self, name: str, distinct: bool) -> Column:
        edges = sorted(set(self.edges[name])) if distinct else self.edges[name]
        return F.least(edge_count(F.col(name), edges[1:-1]), F.lit(self.bins - 1)).cast("long")

    def cell(self, distinct: bool) -> Column:
        cell = F.lit(0).cast("long")
        for n in self.names:
            cell = cell * self.bins + self._bin(n, distinct)
        return cell

    def counts(self, features: DataFrame) -> DataFrame:
        return features.select(self.cell(True).alias("cell")).groupBy("cell").agg(F.count("*").alias("cnt"))

    def transform(self, features: DataFrame) -> DataFrame:
        """features with mutual_info, in bits. features is read several times: settle it first where it is costly."""
        counts = self.counts(features)
        total = features.count()
        placed = features.withColumn("cell", self.cell(self.edge_mode == "consistent"))
        p = (F.coalesce("cnt", F.lit(0)) + self.smoothing) / (total + self.smoothing * self.bins ** len(self.names))
        known = F.when(F.col("cnt").isNull() & (self.edge_mode == "outside"), EPSILON).otherwise(p)
        return skew_join(placed, counts, ["cell"], "cnt", "left").withColumn("mutual_info", -F.log2(known + EPSILON)).drop("cell", "cnt")
