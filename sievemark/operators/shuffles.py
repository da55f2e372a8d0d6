"""Plans that hold where a few keys have most of the rows, and where a table is read more than once."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df computed once, for several readers: a reliable checkpoint where the cluster names a folder for them in
    spark.checkpoint.dir (or the context has one), else kept on disk by Spark until the session's cache is cleared."""
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    if context._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    return df.persist(StorageLevel.DISK_ONLY)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined (inner or left) to right, which has one row for each key and in `weight` the number of left's rows with it.

    Keys that hold over a quarter of a mean partition's rows meet their row of right as a broadcast; there are fewer than four
    times as many as shuffle partitions, by counting. The others are joined by a shuffle. Both tables are read more than
    once and must be the same each time. total: the sum of `weight`, where it is known."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = (right.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    heavy = right.where(F.col(weight) * (4 * parts) > total)
    hot = left.join(F.broadcast(heavy), keys, "inner")
    rest = left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return hot.unionByName(rest.join(right.where(F.col(weight) * (4 * parts) <= total), keys, how))
