"""What the operators share: tables, the shared folder, reliable checkpoints, free names, labelled samples."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode, where that is unset, a temporary one is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not re.match(r"local(\[|$)", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
            named = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder and read from there: lineage is cut, nothing depends on an executor's disk.

    Spark deletes the files with the DataFrame where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a path of ``scratch``, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions_for(n_bytes: int, per_partition: int = 64 << 20, least: int = 8) -> int:
    """Partitions so that each gets about ``per_partition`` bytes."""
    return max(least, -(-int(n_bytes or 0) // per_partition))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(df: DataFrame, name: str) -> DataFrame:
    """``df`` without columns of that name in any case."""
    if all(c.lower() != name.lower() for c in df.columns):
        return df
    return df.select(*(quoted(c) for c in df.columns if c.lower() != name.lower()))


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def teaching(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``__label`` (double) and ``text`` of at most ``sample_rows`` labelled documents: the sample that a model is fitted on.

    A key teaches one text, of several that of the smallest hash, so a key that many rows share weighs no more than
    others; keys are taken by the smallest hash. A key with two labels teaches both. Rows without key or label don't
    teach. The sample's keys are what is broadcast.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__label")).dropna().distinct()
    of = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(hashed).alias("__hash"))
    sample = of.join(known, "__key").orderBy(F.xxhash64("__key"), "__label").limit(sample_rows)
    rows = docs.select(F.col(key).alias("__key"), hashed.alias("__hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.join(F.broadcast(sample), ["__key", "__hash"]).dropDuplicates(["__key", "__label"]).select("__label", "text")
