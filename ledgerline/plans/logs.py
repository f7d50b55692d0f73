"""The driver's tables as logs, keyed tables and multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import ranked
from ..operators.scan import Scan, scan_log

RECENCY = ("ts", "event_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as changes: the key is the user, an error event deletes it, later events supersede earlier ones."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("k"), "event_id", "ts", "event_type", (F.col("event_type") == "error").alias("deleted"))


def event_scan(spark: SparkSession, sf_dir: str) -> Scan:
    return scan_log(event_log(spark, sf_dir), ["k"], RECENCY, "deleted")


def order_scan(spark: SparkSession, sf_dir: str) -> Scan:
    """orders as a table whose keys are order numbers as text; each key has one version."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderkey", "o_orderstatus", "o_orderpriority", F.lit(False).alias("deleted"))
    return Scan(o, ("k",), ("o_orderkey",), "deleted", resolved=True)


def tile(rank: Column, n: int, tiles: int) -> Column:
    """The tile (from 0) of a rank (from 1) among ``n`` rows in ``tiles`` parts as equal as can be, larger ones first."""
    size, more = divmod(n, tiles)
    edge = more * (size + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (size + 1))).otherwise(more + F.floor((rank - 1 - edge) / max(1, size))).cast("long")


def levelled(log: DataFrame, levels: int = 4) -> DataFrame:
    """The log with ``lvl``: its newest part is level 0."""
    return ranked(log, RECENCY, descending=True, rank="_r").withColumn("lvl", tile(F.col("_r"), log.count(), levels)).drop("_r")
