"""Newest-wins resolution: of each key's versions, the newest; where that is a tombstone, nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import DELETED


def newest(df: DataFrame, keys: Sequence[str], recency: Sequence[str | Column], method: str = "window") -> DataFrame:
    """One row for each key, all columns: the one with the largest ``recency``, compared column by column.

    ``window`` numbers each key's rows; Spark keeps one row for each key and map task before the exchange
    (WindowGroupLimit), so superseded versions are not shuffled. ``aggregate`` takes max_by over a struct, with partial
    aggregation. Key predicates put above either reach the scan. Recency must be a total order, else ties are open.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in recency]
    if method == "window":
        w = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    if method == "aggregate":
        rest = [c for c in df.columns if c not in keys]
        if not rest:
            return df.select(*keys).distinct()
        by = order[0] if len(order) == 1 else F.struct(*order)
        found = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_v"))
        return found.select(*keys, *(F.col("_v")[c].alias(c) for c in rest)).select(*df.columns)
    raise ValueError(f"unknown method {method!r}")


def live(resolved: DataFrame, deleted: str = DELETED) -> DataFrame:
    """Without tombstones. This belongs above ``newest``: below it, older versions of deleted keys would come back."""
    return resolved.where(~F.col(deleted)).drop(deleted)
