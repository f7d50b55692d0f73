"""Global order without a global task: chunks of a range partitioning, numbered in order.

A window without a partition puts all rows in one task. Here rows are range-partitioned by the key; each partition is a
chunk that one task orders, and what chunks need of each other (counts, last and first rows) is one row for each chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import checkpoint

CHUNK, TIE = "_chunk", "_tie"


def chunked(df: DataFrame, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """``df`` with ``_chunk`` and ``_tie``: all rows of a chunk precede those of later chunks by ``keys``, then ``_tie``.

    Rows with equal keys are dealt by a hash of all their columns and by the task that has them, so a key that many rows
    share fills many chunks and not one. Written once to the shared folder, so that every reader sees the same chunks.
    """
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    rows = df.withColumn(TIE, F.xxhash64(*df.columns)).withColumn("_task", F.spark_partition_id())
    return checkpoint(rows.repartitionByRange(*order, TIE, "_task").drop("_task").withColumn(CHUNK, F.spark_partition_id()))


def _ordered(keys: Sequence[str], descending: bool):
    return Window.partitionBy(CHUNK).orderBy(*(F.col(k).desc() if descending else F.col(k).asc() for k in keys), TIE)


def ranked(df: DataFrame, keys: Sequence[str], descending: bool = False, rank: str = "rank") -> DataFrame:
    """``df`` with the row's number (from 1, a long) in the order of ``keys``; ties are numbered in any order."""
    rows = chunked(df, keys, descending)
    sizes = rows.groupBy(CHUNK).agg(F.count("*").alias("_n"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(CHUNK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = rows.withColumn("_own", F.row_number().over(_ordered(keys, descending)))
    return own.join(starts, CHUNK).withColumn(rank, (F.col("_start") + F.col("_own")).cast("long")).select(*df.columns, rank)


def neighbours(df: DataFrame, keys: Sequence[str], value: str, previous: str = "prev", following: str = "next") -> DataFrame:
    """``df`` with ``value`` of the row before and of the row after in the order of ``keys``; null at the ends."""
    rows = chunked(df, keys)
    inside = _ordered(keys, False)
    place = F.struct(*keys, TIE)
    edges = rows.groupBy(CHUNK).agg(F.max_by(value, place).alias("_last"), F.min_by(value, place).alias("_first"))
    along = Window.orderBy(CHUNK)
    edges = edges.select(CHUNK, F.lag("_last").over(along).alias("_before"), F.lead("_first").over(along).alias("_after"))
    own = rows.withColumns({"_p": F.lag(value).over(inside), "_n": F.lead(value).over(inside), "_rn": F.row_number().over(inside), "_left": F.count("*").over(Window.partitionBy(CHUNK))})
    out = own.join(edges, CHUNK)
    p = F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_p"))
    n = F.when(F.col("_rn") == F.col("_left"), F.col("_after")).otherwise(F.col("_n"))
    return out.select(*df.columns, p.alias(previous), n.alias(following))


def nearest(probes: DataFrame, table: DataFrame, key: str, probe: str) -> DataFrame:
    """``probes`` with lower, floor, ceiling and higher: the largest ``key`` of ``table`` under (or at) each ``probe``, the smallest at (or over) it.

    An as-of join of both directions without comparing all pairs: both sides are chunked by value together, running
    maxima and minima do the rest, and chunks hand on one row each. Null probes and keys find and are found by nothing.
    """
    keys = table.where(F.col(key).isNotNull()).select(F.col(key).alias("_x")).distinct()
    both = keys.withColumn("_k", F.col("_x")).unionByName(probes.where(F.col(probe).isNotNull()).select(F.col(probe).alias("_x")).distinct().withColumn("_k", F.lit(None).cast(probes.schema[probe].dataType)))
    both = both.groupBy("_x").agg(F.max("_k").alias("_k"), F.max(F.col("_k").isNull()).alias("_asked"))
    rows = chunked(both, ["_x"])
    up = Window.partitionBy(CHUNK).orderBy("_x")
    frames = {
        "lower": F.max("_k").over(up.rowsBetween(Window.unboundedPreceding, -1)), "floor": F.max("_k").over(up.rowsBetween(Window.unboundedPreceding, 0)),
        "ceiling": F.min("_k").over(up.rowsBetween(0, Window.unboundedFollowing)), "higher": F.min("_k").over(up.rowsBetween(1, Window.unboundedFollowing)),
    }
    along = Window.orderBy(CHUNK)
    edges = rows.groupBy(CHUNK).agg(F.max("_k").alias("_max"), F.min("_k").alias("_min"))
    edges = edges.select(CHUNK, F.max("_max").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"), F.min("_min").over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_above"))
    found = rows.withColumns(frames).where("_asked").join(edges, CHUNK)
    found = found.select(F.col("_x"), *(F.coalesce(c, "_below").alias(c) for c in ("lower", "floor")), *(F.coalesce(c, "_above").alias(c) for c in ("ceiling", "higher")))
    return probes.join(found, probes[probe] == found["_x"], "left").drop("_x")
