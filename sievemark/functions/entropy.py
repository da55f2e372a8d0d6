"""Entropies, normalisations and discretisations as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EPSILON


def entropy_from_counts(count: Column, total: Column) -> Column:
    """Aggregate over the rows of a group, one for each category: entropy of count / total, mass added to each."""
    a = count / total + EPSILON
    z = F.lit(1.0) + F.count("*") * EPSILON
    return -F.sum(a * F.log2(a)) / z + F.log2(z)


def probabilities(rows: DataFrame, value: str, n_categories: int | None = None) -> DataFrame:
    """value, p: each value's share of the rows. With n_categories value is a whole number and all of 0..n_categories-1
    are given, absent ones with 0 and numbers beyond not at all (shares are of all rows still)."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    shares = counts.select("value", (F.col("n") / F.sum("n").over(_all())).alias("p"))
    if n_categories is None:
        return shares
    every = rows.sparkSession.range(n_categories).select(F.col("id").alias("value"))
    return every.join(shares, "value", "left").select("value", F.coalesce("p", F.lit(0.0)).alias("p"))


def _all():
    """Over the rows of a small table (one for each category)."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def conditional_entropy(joint: Column, marginal: Column) -> Column:
    """Aggregate over cells: -sum p(x, y) log2 p(y | x), the conditional held within (eps, 1)."""
    return -F.sum(joint * F.log2(F.least(F.greatest(joint / marginal, F.lit(EPSILON)), F.lit(1.0))))


def smoothed_conditional_entropy(cells: DataFrame, joint: str, marginal: str, context: str) -> DataFrame:
    """One row h. cells: joint shares p(x, y), one row for each cell, with the share p(x) of their context. A tiny mass goes on
    every joint and every marginal share and both are brought back to a sum of 1 before the entropy is taken."""
    once = F.row_number().over(_by(context)) == 1
    marked = cells.withColumn("_m", F.when(once, F.col(marginal) + EPSILON))
    sums = marked.agg(F.sum(F.col(joint) + EPSILON).alias("j"), F.sum("_m").alias("m")).first()
    if sums is None or not sums["j"]:
        return cells.sparkSession.createDataFrame([(0.0,)], "h double")
    return cells.agg(conditional_entropy((F.col(joint) + EPSILON) / sums["j"], (F.col(marginal) + EPSILON) / sums["m"]).alias("h"))


def _by(context: str):
    from pyspark.sql import Window

    return Window.partitionBy(context).orderBy(F.lit(0))


# --- counts within a row ---------------------------------------------------------------------------
def with_runs(df: DataFrame, items: str, out: str) -> DataFrame:
    """df with the distinct items of a sorted array column, each with how often and from where it stands there: an array of
    (item, n, at). Each step is a projection of its own, so that no array is computed for each of its elements."""
    a, size = F.col(items), F.size(items)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    heads = df.withColumn("_heads", F.filter(places, lambda i: (i == 0) | (F.get(a, i) != F.get(a, i - 1))))
    run = lambda s, k: F.struct(F.get(a, s).alias("item"), (F.coalesce(F.get("_heads", k + 1), size) - s).alias("n"), s.alias("at"))
    return heads.withColumn(out, F.transform("_heads", run)).drop("_heads")


def entropy_of_runs(counted: str, total: str, kinds: int | None = None) -> Column:
    """Entropy of the counts in runs as shares of total, a tiny mass added to each (to `kinds` of them, absent ones too)."""
    a = lambda x: x["n"] / F.col(total) + EPSILON
    held = F.aggregate(counted, F.lit(0.0), lambda s, x: s + a(x) * F.log2(a(x)))
    if kinds is None:
        z = F.lit(1.0) + F.size(counted) * EPSILON
    else:
        z = F.lit(1.0 + kinds * EPSILON)
        held = held + (F.lit(kinds) - F.size(counted)) * (EPSILON * math.log2(EPSILON))
    return F.when(F.size(counted) == 0, 0.0).otherwise(-held / z + F.log2(z))


def sum_by_context(counted: str, context: Callable[[Column], Column], part: Callable[[Column], Column], whole: Callable[[Column, Column, Column], Column]) -> Column:
    """Over runs in order, those of a context side by side: the sum of whole(n, kinds, sum of part(n)) over the contexts."""
    def state(c, n, k, s, done):
        return F.struct(c.alias("c"), n.alias("n"), k.alias("k"), s.alias("s"), done.alias("done"))

    def closed(a):
        return a["done"] + F.when(a["k"] > 0, whole(a["n"], a["k"], a["s"])).otherwise(0.0)

    def step(a, x):
        same = F.coalesce(context(x["item"]) == a["c"], F.lit(False))
        n, s = x["n"].cast("double"), part(x["n"].cast("double"))
        return F.when(same, state(a["c"], a["n"] + n, a["k"] + 1, a["s"] + s, a["done"])).otherwise(state(context(x["item"]), n, F.lit(1.0), s, closed(a)))

    zero = state(F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.aggregate(counted, zero, step, closed)


# --- normalisation and bins --------------------------------------------------------------------------
METHODS = ("minmax", "zscore", "softmax")


def normalize_scores(df: DataFrame, column: str, method: str = "minmax", out: str | None = None) -> DataFrame:
    """df with the column's normalised value: minmax to 0..1 (0.5 where all are alike), zscore by the population deviation
    (0 where there is none), softmax. The statistics are one aggregate; nulls stay null; unknown methods raise."""
    value = F.col(column).cast("double")
    if method not in METHODS:
        raise ValueError(f"unknown normalisation {method}: one of {', '.join(METHODS)}")
    low, high, mean, std = df.agg(F.min(value), F.max(value), F.avg(value), F.stddev_pop(value)).first()
    if low is None:
        made = F.lit(None).cast("double")
    elif method == "minmax":
        made = F.lit(0.5) if high - low < 1e-10 else (value - low) / (high - low)
    elif method == "zscore":
        made = F.lit(0.0) if std < 1e-10 else (value - mean) / std
    else:
        total = df.agg(F.sum(F.exp(value - high))).first()[0]
        made = F.exp(value - high) / total
    return df.withColumn(out or column, F.when(value.isNotNull(), made))


def scaled(value: Column, stats: dict[str, float], method: str) -> Column:
    """A component's normalised value by fitted statistics."""
    if method == "minmax":
        spread = stats["max"] - stats["min"]
        return F.lit(0.5) if spread < 1e-10 else (value - stats["min"]) / spread
    if method == "zscore":
        if stats["std"] < 1e-10:
            return F.lit(0.5)
        return (F.least(F.greatest((value - stats["mean"]) / stats["std"], F.lit(-3.0)), F.lit(3.0)) + 3) / 6
    raise ValueError(f"unknown normalisation {method}")


def edge_count(value: Column, edges: list[float]) -> Column:
    """How many of the ascending edges lie at or below the value: a binary search written out, so the value is looked at
    about log2(edges) times."""
    if not edges:
        return F.lit(0)

    def search(a: int, b: int) -> Column:  # edges[:a] are at or below the value, edges[b:] above
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(value >= edges[m], search(m + 1, b)).otherwise(search(a, m))

    return search(0, len(edges))


def binned(value: Column, edges: list[float]) -> Column:
    """Bin by quantile edges (distinct, ascending): how many inner edges lie at or below the value."""
    return edge_count(value, sorted(set(edges))[1:-1])


def uniform_bin(value: Column, low: float, high: float, bins: int) -> Column:
    if high - low < 1e-10:
        return F.lit(0)
    return F.least(F.greatest(F.floor((value - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def discretize(df: DataFrame, column: str, bins: int = 64, method: str = "uniform", out: str = "bin") -> DataFrame:
    """df with the bin of a column's value: equal widths between its least and greatest, or exact quantiles (repeated edges
    are one, so there may be fewer bins). Nulls stay null; unknown methods raise."""
    from ..operators.quantiles import exact_quantiles

    value = F.col(column).cast("double")
    if method == "uniform":
        low, high = df.agg(F.min(value), F.max(value)).first()
        made = F.lit(0) if low is None else uniform_bin(value, low, high, bins)
    elif method == "quantile":
        edges = exact_quantiles(df, [column], [i / bins for i in range(bins + 1)])[column]
        made = binned(value, edges or [0.0])
    else:
        raise ValueError(f"unknown discretisation {method}: uniform or quantile")
    return df.withColumn(out, F.when(value.isNotNull(), made.cast("int")))
