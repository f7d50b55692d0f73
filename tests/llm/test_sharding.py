import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import sharding

from .helpers import ODD, SCHEMA, table


def slow_jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_loop():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [slow_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_hash(keys, 0)


def test_growth_moves_only_into_the_new_shard():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 5, 16):
        old, new = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        moved = old != new
        assert (new[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.02


def test_query(spark, tmp_path):
    docs = table(spark, ODD * 20).unionByName(spark.createDataFrame([(None, "q", None, None, 1), (3, "x", None, None, 1), (3, "x", None, None, 1)], SCHEMA))
    docs = docs.withColumns({"shard": F.lit("clash"), "slot": F.lit(1)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op1_jump_sharding(spark, str(tmp_path)).collect()
    want = {(r.doc_id, r.text) for r in docs.collect()}
    assert len(got) == docs.count() and {r.law for r in got} == {"key"}
    sizes = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in want}
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == sizes
    by_key, by_shard = {}, {}
    for r in got:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 16)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_one_key_for_most_rows_and_none(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 < 2, F.lit(7)).otherwise(F.col("id")).alias("doc_id"))
    got = sharding.assign(docs, ["doc_id"], 4, ["doc_id"]).toPandas()
    assert len(got) == 3000
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    assert sharding.assign(docs.limit(0), ["doc_id"], 4, ["doc_id"]).count() == 0
