"""Containers, global order, Bloom filters, codecs, the cache."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.functions import codec, membership
from ledgerline.operators.container import Ordered, Sequence
from ledgerline.operators.order import nearest, neighbours, ranked
from ledgerline.sources.cache import SegmentedCache


def ints(spark, values):
    return Ordered.of(spark, [(v,) for v in values], "k long", "k")


def test_multiset(spark):
    t = ints(spark, [5, 6, 7, 3, 4, 1, 2, 1])
    assert t.count() == 8 and [r.k for r in t] == [1, 1, 2, 3, 4, 5, 6, 7]
    for k in (5, 6, 7, 8, 5):
        t = t.remove_key(k)
    assert [r.k for r in t.items()] == [1, 1, 2, 3, 4]
    t = t.remove_key(1)
    assert [r.k for r in t.items()] == [1, 2, 3, 4] and [r.k for r in t.backward()] == [4, 3, 2, 1]
    assert t.first().k == 1 and t.last().k == 4 and t.search(3).k == 3 and t.search(9) is None
    assert t.clear().is_empty() and t.clear().first() is None
    assert [r.k for r in t.insert(t.df).items()] == [1, 1, 2, 2, 3, 3, 4, 4]
    assert [r.k for r in t.insert(t.df).insert_or_replace(t.df.where("k > 2")).items()] == [1, 1, 2, 2, 3, 4]
    seen = []
    t.for_each(lambda r: seen.append(r.k) or r.k < 2)
    assert seen == [1, 2]


def test_floor_and_ceiling(spark):
    held = [1, 2, 3, 7, 10, 20, 30, 31]
    t = ints(spark, held)
    probes = [0, 1, 2, 4, 8, 10, 15, 30, 31, 32, 100]
    got = {r.p: (r.lower, r.floor, r.ceiling, r.higher) for r in t.nearest(spark.createDataFrame([(p,) for p in [*probes, None]], "p long"), "p").collect()}
    for p in probes:
        want = (max((k for k in held if k < p), default=None), max((k for k in held if k <= p), default=None), min((k for k in held if k >= p), default=None), min((k for k in held if k > p), default=None))
        assert got[p] == want
    assert got[None] == (None, None, None, None)
    for op, i in (("LT", 0), ("LE", 1), ("GE", 2), ("GT", 3)):
        assert (found := t.find(op, 8)) is not None and found.k == got[8][i]
    assert t.find("LT", 1) is None and t.find("EQ", 7).k == 7 and t.find("GE", None).k == 1 and t.find("LE", None).k == 31
    with pytest.raises(ValueError):
        t.find("EQ", None)


def test_global_order_across_chunks(spark):
    rng = random.Random(1)
    values = [rng.randrange(10_000) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k long, i long").repartition(7)
    order = sorted((v, i) for i, v in enumerate(values))
    assert [(r.k, r.i) for r in sorted(ranked(df, ["k", "i"]).collect(), key=lambda r: r.rank)] == order
    assert [(r.k, r.i) for r in sorted(ranked(df, ["k", "i"], descending=True).collect(), key=lambda r: r.rank)] == order[::-1]
    near = {r.i: (r.prev, r.next) for r in neighbours(df, ["k", "i"], "i").collect()}
    ids = [i for _, i in order]
    assert near == {i: (ids[n - 1] if n else None, ids[n + 1] if n + 1 < len(ids) else None) for n, i in enumerate(ids)}
    probes = spark.createDataFrame([(p,) for p in range(-5, 10_010, 37)], "p long")
    keys = np.unique(values)
    for r in nearest(probes, df, "k", "p").collect():
        at = int(np.searchsorted(keys, r.p, "right"))
        assert r.floor == (int(keys[at - 1]) if at else None)
        at = int(np.searchsorted(keys, r.p, "left"))
        assert r.ceiling == (int(keys[at]) if at < len(keys) else None)
    empty = df.limit(0)
    assert ranked(empty, ["k"]).count() == 0 and neighbours(empty, ["k"], "i").count() == 0
    assert all(r.floor is None for r in nearest(probes, empty, "k", "p").collect())


def test_sequence(spark):
    s = Sequence(spark.createDataFrame([("1", 0), ("2", 1)], "v string, position long"))
    three = spark.createDataFrame([("3", 0), ("4", 1)], "v string, position long")
    word = lambda x: "".join(r.v for r in x.items())
    assert word(s.add_tail(three)) == "1234" and word(s.add(three)) == "3412"
    assert word(s.splice(three).move(F.col("v") == "2")) == "2341"
    assert word(s.splice_tail(three).move_tail(F.col("v") == "1")) == "2341"
    assert word(s.remove(F.col("v") == "1")) == "2" and s.contains(F.col("v") == "1") and not s.contains(F.col("v") == "9")
    assert s.first().v == "1" and s.last().v == "2" and not s.is_empty()
    assert {r.v: (r.prev, r.next) for r in s.neighbours("v").collect()} == {"1": (None, "2"), "2": ("1", None)}
    seen = []
    s.for_each(lambda r: seen.append(r.v) or False)
    assert seen == ["1"]


def test_bloom(spark):
    bloom = membership.BloomFilter.for_items(20_000)
    rng = np.random.default_rng(5)
    there, absent = rng.integers(-(1 << 62), 1 << 62, 20_000), rng.integers(-(1 << 62), 1 << 62, 100_000)
    bloom.insert(there)
    assert bloom.exists(there).all()
    assert bloom.exists(absent).mean() <= 1.2 * membership.false_positive_rate()
    data = bloom.encode()
    assert (membership.BloomFilter.decode(data).bits == bloom.bits).all()
    with pytest.raises(ValueError):
        membership.BloomFilter.decode(data[:-1] + bytes([data[-1] ^ 1]))
    assert membership.BloomFilter.for_items(0) is None and membership.BloomFilter.for_items(2_000_000_000) is None
    keys = spark.range(1000)
    built = membership.build(keys, "id")
    found = spark.range(20_000).withColumn("m", membership.may_contain(spark.range(1), built, "id"))
    assert found.where("id < 1000 and not m").isEmpty()
    assert found.where("id >= 1000 and m").count() < 19_000 * 0.03
    assert spark.range(5).where(membership.may_contain(keys, None, "id")).count() == 5


def test_codecs(spark):
    values = [0, 1, -1, 63, 64, -64, 127, 128, 300, 2**31, -(2**31), 2**62, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    out = df.select("v", codec.from_zigzag(codec.from_varint(codec.varint(codec.zigzag(F.col("v"))))).alias("z"), codec.from_fixed(codec.fixed(F.col("v"), 8)).alias("f"), F.octet_length(codec.varint(codec.zigzag(F.col("v")))).alias("n"))
    for r in out.collect():
        assert r.z == r.v and r.f == r.v
        assert r.n == max(1, -(-((r.v << 1) ^ (r.v >> 63)).bit_length() // 7)) if r.v >= 0 else r.n >= 1
    assert [bytes(r[0]) for r in spark.createDataFrame([(300,)], "v long").select(codec.varint(F.col("v"))).collect()] == [b"\xac\x02"]
    texts = ["", "a", "é" * 100, "x" * 1000]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select("t", codec.from_sized(codec.sized(F.col("t"))).cast("string").alias("b"))
    assert all(r.t == r.b for r in back.collect())
    assert spark.range(1).select(codec.from_sized(F.unhex(F.lit("0541"))).alias("x"), codec.from_varint(F.unhex(F.lit("80"))).alias("y"), codec.checked_uint32(F.lit(1 << 32)).alias("u")).first().asDict() == {"x": None, "y": None, "u": None}
    with pytest.raises(Exception, match="longer"):
        spark.range(1).select(codec.sized(F.repeat(F.lit("x"), codec.LIMIT + 1))).collect()


def test_cache_keeps_what_is_read():
    gone = []
    c = SegmentedCache(100, gone.append)
    load = lambda k: lambda: (k, 10)
    for k in range(5):
        c.read(k, load(k))
    for k in range(100, 200):
        c.write(k, k, 10)
    assert all(k in c for k in range(5)) and c.size <= 100
    assert c.read(0, load(0)) == 0 and c.hit_ratio == 1 / 6
    c.write(0, "new", 20)
    assert c.read(0, load(0)) == "new"
    c.write("huge", 1, 1000)
    assert "huge" not in c
    c.capacity = 0
    assert len(c) == 0 and c.size == 0 and gone
    assert SegmentedCache(-5).capacity == 0 and SegmentedCache(10).hit_ratio == 0


def test_cache_loads_once():
    c, calls, start = SegmentedCache(100), [], threading.Barrier(8)

    def load():
        calls.append(1)
        return "x", 1

    def work():
        start.wait()
        assert c.read("k", load) == "x"

    threads = [threading.Thread(target=work) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(calls) == 1
    with pytest.raises(RuntimeError):
        c.read("bad", lambda: (_ for _ in ()).throw(RuntimeError()))
    assert c.read("bad", lambda: ("ok", 1)) == "ok"


def test_ties_fill_many_chunks(spark):
    from ledgerline.operators.order import chunked

    df = spark.createDataFrame([(7, i) for i in range(2000)] + [(i, i) for i in range(20)], "k long, i long").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in chunked(df, ["k"]).groupBy("_chunk").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 1200
    got = sorted((r.rank, r.k) for r in ranked(df, ["k"]).collect())
    assert [n for n, _ in got] == list(range(1, 2021)) and [k for _, k in got] == sorted(k for _, k in got)
    near = neighbours(df, ["k"], "i").collect()
    assert sum(r.prev is None for r in near) == 1 and sum(r.next is None for r in near) == 1
    assert {r.prev for r in near} | {None} == {r.prev for r in near} and len({(r.k, r.i, r.prev) for r in near}) == 2020


def test_removal_from_a_key_with_most_rows(spark):
    t = Ordered(spark.createDataFrame([(1, str(i % 5)) for i in range(1000)] + [(2, "x"), (None, "n")], "k long, v string").repartition(4), ("k",))
    left = t.remove(spark.createDataFrame([(1,)] * 990 + [(3,), (2,), (2,)], "k long"))
    assert {r.k: r["count"] for r in left.df.groupBy("k").count().collect()} == {1: 10, None: 1}
    left = t.remove_items(spark.createDataFrame([(1, "3")] * 3 + [(1, "no"), (None, "n")], "k long, v string"))
    assert left.df.where("v = '3'").count() == 197 and left.count() == 1002 - 4
    rest, at = ints(spark, [1, 2, 2, 5]).remove_at(ints(spark, [2]).first())
    assert [r.k for r in rest.items()] == [1, 2, 5] and at.k == 2
    rest, at = rest.remove_at(rest.last())
    assert [r.k for r in rest.items()] == [1, 2] and at is None


@pytest.mark.parametrize("task_rows", [20, 10**6])
def test_removal_against_counters(spark, monkeypatch, task_rows):
    from collections import Counter

    from ledgerline.operators import container

    monkeypatch.setattr(container, "ROWS", task_rows)
    rng = random.Random(7)
    pick = lambda n: [(rng.choice([None, 1, 1, 1, *range(40)]), rng.choice(["a", "b", None])) for _ in range(n)]
    held, asked = pick(1500), pick(700)
    t = Ordered(spark.createDataFrame(held, "k long, v string").repartition(5), ("k",))
    rows = spark.createDataFrame(asked, "k int, v string").repartition(3)
    left, items = t.remove(rows), t.remove_items(rows.select("v", "k"))
    assert left.df.dtypes == items.df.dtypes == t.df.dtypes
    assert Counter(r.k for r in left.df.collect()) == Counter(k for k, _ in held) - Counter(k for k, _ in asked)
    assert not Counter(map(tuple, left.df.collect())) - Counter(held)
    assert Counter(map(tuple, items.df.collect())) == Counter(held) - Counter(asked)
    assert sorted(map(str, left.df.collect())) == sorted(map(str, left.df.collect()))
    assert t.remove(rows.limit(0)).count() == 1500 and t.clear().remove(rows).count() == 0


def test_removal_takes_more_tasks_for_more_rows(spark, monkeypatch):
    from ledgerline.operators import container

    monkeypatch.setattr(container, "ROWS", 200, raising=False)
    most = []
    for n in (4000, 16000):
        t = Ordered(spark.range(n).withColumnRenamed("id", "k"), ("k",))
        left = t.remove(t.df.where("k % 2 = 0")).df
        sizes = [r["count"] for r in left.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == n // 2
        most.append(max(sizes))
    assert max(most) < 200


def test_codec_primitives(spark):
    out = spark.createDataFrame([(True, bytearray(b"abcdef"))], "b boolean, d binary")
    got = out.select(codec.boolean(F.col("b")).alias("b"), codec.from_boolean(codec.boolean(~F.col("b"))).alias("n"), codec.from_boolean(F.unhex(F.lit("02"))).alias("bad"), codec.section(F.col("d"), 2, 3).alias("s"), codec.section(F.col("d"), 4, 3).alias("torn")).first()
    assert bytes(got.b) == b"\x01" and got.n is False and got.bad is None and bytes(got.s) == b"cde" and got.torn is None
    with pytest.raises(Exception, match="bad varint"):
        spark.range(1).select(codec.strictly(codec.from_varint(F.unhex(F.lit("80"))), F.unhex(F.lit("80")), "varint")).collect()
    with pytest.raises(Exception, match="bad uint32"):
        spark.range(1).select(codec.strictly(codec.checked_uint32(F.lit(1 << 32)), F.lit(1), "uint32")).collect()
