"""Shared helpers: the cluster's shared folder, written intermediates, text columns and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shuffles import skew_join

#: Words are maximal runs of anything but blanks and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, the context's checkpoint folder, or, in a local
    session only (one machine), one of our own. Elsewhere an unset folder raises: executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sievemark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor costs nothing that was done."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sievemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._sievemark_path = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete what written() wrote; only for tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_sievemark_path", None)
        if path:
            spark = df.sparkSession
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which gives freed memory back to the system at the end of a task: Python workers live on from task to task, and
    what their allocators hold back would count against the next stage's executors."""
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A uniform double in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11) / F.lit(float(1 << 53))


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b); component is its smallest node.

    Alternates large-star and small-star rewiring until nothing changes; every round is a few aggregates whose
    result is written out, so no component is ever gathered in a task, and paths shrink to stars in few rounds. The node at
    the heart of a large star meets its edges as a broadcast row (skew_join), so it is no task of its own.
    An empty edge table gives an empty result. Self loops are ignored. Components that haven't settled in max_rounds raise.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = (stars.count(),)
    for _ in range(max_rounds):
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")).select("u", F.least("u", "m").alias("m"), "edges")
        least = written(least, "least")
        large = skew_join(both, least, ["u"], "edges", total=2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # every edge leads down now: a node's edges are few unless many small nodes share it
        lower = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")), "lower")
        small = skew_join(large, lower, ["u"], "edges").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(stars, least, large, lower)
        stars = after
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components haven't settled in {max_rounds} rounds")
    nodes = stars.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)
