"""Sharding by jump consistent hashing.

``jump_hash`` maps a 64-bit key and a number of shards to a shard without a ring table; when a shard is appended, a
key either stays or goes to the new shard, which about 1 / (shards + 1) of the keys do (Lamping and Veach, 2014).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, table

#: The generator's multiplier, from the published algorithm.
MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard (0 to shards - 1) of each unsigned 64-bit key; all keys step at once until the last has landed."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = np.array(keys, dtype=np.uint64)
    landed = np.zeros(len(key), dtype=np.int32)
    at, b = np.arange(len(key)), np.zeros(len(key), dtype=np.int64)
    while len(at):
        landed[at] = b
        key = key * MULTIPLIER + np.uint64(1)
        jump = ((b + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        on = jump < shards
        at, b, key = at[on], jump[on], key[on]
    return landed


def assign(df: DataFrame, key: Sequence[str], shards: int, carry: Sequence[str] = ()) -> DataFrame:
    """``carry`` columns of ``df`` plus shard, grown_shard (with one shard more) and slot (gapless from 0 in each shard).

    The stable key is xxhash64 of the ``key`` columns; nulls are a key value like any other. Equal keys share a shard,
    and every repeated row has a slot of its own. Empty input gives no rows. Other columns are left behind, so their
    names do not matter. Slots: each partition counts its rows by shard, the counts are summed up in partition order,
    and each row adds its partition's start, so no shard is ever gathered in one task. Partition numbers must not
    change between the two readings, hence the checkpoint of these narrow rows.
    """
    columns = [F.col(c) for c in carry]
    named = df.select(*columns, F.xxhash64(*key).alias("__key"))
    fields = [f for f in named.schema.fields if f.name != "__key"]
    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("__part", T.IntegerType()), T.StructField("__local", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            now, then = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            order = np.argsort(now, kind="stable")
            counts = np.bincount(now, minlength=shards)
            slot = np.empty(len(now), dtype=np.int64)
            slot[order] = np.arange(len(now)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(seen, counts)
            seen += counts
            own = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(now), pa.array(then), pa.array(np.full(len(now), part, dtype=np.int32)), pa.array(slot)], names=schema.names)

    placed = checkpoint(named.mapInArrow(local, schema))
    counts = placed.groupBy("__part", "shard").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", "shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(starts, ["__part", "shard"]).select(*columns, "shard", "grown_shard", (F.col("__start") + F.col("__local")).alias("slot"))


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 15 under the law ``key``: doc_id and the number of shards decide.

    A null text has no bytes: size 1, crc32 0. A null doc_id is a key of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign(docs, ["doc_id"], 16, ["doc_id", "size", "text_crc32"]).withColumn("law", F.lit("key"))


QUERIES = {"op1_jump_sharding": op1_jump_sharding}
ORACLE_SQL: dict[str, str] = {}
