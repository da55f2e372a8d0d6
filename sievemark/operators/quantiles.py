"""Exact quantiles of whole tables without sorting them or holding their values in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which Spark's exact percentile (one buffer of distinct values) is asked.
FEW = 1_000_000


def exact_quantiles(df: DataFrame, columns: list[str], at: list[float], few: int = FEW, buckets: int = 1024) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of each column (nulls and NaN left out; an empty column gives []).

    Larger tables are narrowed down: each pass counts, for every rank still sought, the values in `buckets` equal parts of the
    interval that holds it, until an interval holds one value. A pass is one aggregate whose result has at most
    columns x ranks x buckets rows, and a few passes settle any double. df is read once for each pass."""
    values = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    sizes = values.agg(*(f(c) for c in columns for f in (F.count, F.min, F.max))).first()
    n = {c: sizes[3 * i] for i, c in enumerate(columns)}
    if max(n.values(), default=0) <= few:
        points = F.array(*(F.lit(float(p)) for p in at))
        row = values.agg(*(F.percentile(c, points).alias(c) for c in columns)).first()
        return {c: list(row[c] or []) for c in columns}
    found: dict[tuple[str, int], float] = {}
    sought: dict[tuple[str, int], tuple[float, float, int]] = {}  # (column, rank) -> interval and values below it
    for i, c in enumerate(columns):
        if n[c]:
            for p in at:
                for rank in (math.floor(p * (n[c] - 1)), math.ceil(p * (n[c] - 1))):
                    sought[c, rank] = (sizes[3 * i + 1], sizes[3 * i + 2], 0)
    while sought:
        for key, (low, high, _) in list(sought.items()):
            if low == high:
                found[key] = low
                del sought[key]
        intervals = sorted({(c, low, high) for (c, _), (low, high, _) in sought.items()})
        if not intervals:
            break
        marks = []
        for k, (c, low, high) in enumerate(intervals):
            width = (high - low) / buckets
            place = F.least(F.floor((F.col(c) - low) / width), F.lit(buckets - 1)) if width > 0 else (F.col(c) > low).cast("int")
            if math.isinf(width):
                place = F.least(F.floor((F.col(c) / 2 - low / 2) / (high / 2 - low / 2) * buckets), F.lit(buckets - 1))
            marks.append(F.when(F.col(c).between(low, high), F.struct(F.lit(k).alias("k"), place.cast("int").alias("b"), F.col(c).alias("v"))))
        rows = values.select(F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m")).groupBy("m.k", "m.b").agg(F.count("*").alias("n"), F.min("m.v").alias("low"), F.max("m.v").alias("high")).collect()
        held: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["k"], r["low"])):
            held.setdefault(r["k"], []).append(r)
        number = {x: k for k, x in enumerate(intervals)}
        for (c, rank), (low, high, below) in list(sought.items()):
            for r in held[number[c, low, high]]:
                if rank < below + r["n"]:
                    sought[c, rank] = (r["low"], r["high"], below)
                    break
                below += r["n"]
    out = {}
    for c in columns:
        out[c] = []
        for p in at if n[c] else []:
            place = p * (n[c] - 1)
            low, high = found[c, math.floor(place)], found[c, math.ceil(place)]
            part = place - math.floor(place)
            out[c].append(low if part == 0 else (1 - part) * low + part * high)
    return out
