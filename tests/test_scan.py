"""Scans against a model of dict and sorted."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.compare import Op, compare_ints, compare_strings, tuple_predicate
from ledgerline.operators.resolve import newest
from ledgerline.operators.scan import scan_log


@pytest.fixture(scope="module")
def ops():
    rng = random.Random(7)
    return [(str(rng.randrange(300)), i, rng.random() < 0.4, rng.randrange(1000)) for i in range(3000)]


@pytest.fixture(scope="module")
def model(ops):
    state = {}
    for k, _, deleted, v in ops:
        state[k] = None if deleted else v
    return {k: v for k, v in state.items() if v is not None}


@pytest.fixture(scope="module")
def scan(spark, ops):
    return scan_log(spark.createDataFrame(ops, "k string, seq long, deleted boolean, v long").cache(), ["k"], ["seq"], "deleted")


def test_methods_agree(scan):
    by_window = newest(scan.log, ["k"], ["seq"])
    by_aggregate = newest(scan.log, ["k"], ["seq"], "aggregate")
    assert by_window.columns == by_aggregate.columns
    assert sorted(by_window.collect()) == sorted(by_aggregate.collect())
    with pytest.raises(ValueError):
        newest(scan.log, ["k"], ["seq"], "other")


def test_items_and_counts(scan, model):
    assert [(r.k, r.v) for r in scan.items()] == sorted(model.items())
    assert scan.count() == len(model)
    assert not scan.is_empty()


@pytest.mark.parametrize("op", ["GE", "GT", "LE", "LT"])
@pytest.mark.parametrize("bound", [None, "0", "150", "15", "299", "9999", ""])
def test_find(scan, model, op, bound):
    keep = {"GE": lambda k: k >= bound, "GT": lambda k: k > bound, "LE": lambda k: k <= bound, "LT": lambda k: k < bound}[op]
    want = sorted((k for k in model if bound is None or keep(k)), reverse=op in ("LE", "LT"))
    assert [r.k for r in scan.find(op, bound).items()] == want


@pytest.mark.parametrize(("op", "a", "b"), [("GE", "111", "222"), ("GT", "111", "222"), ("LE", "222", "111"), ("LT", "222", "111"), ("GE", "222", "111"), ("LE", "111", "222"), ("GE", "123", "123"), ("GE", "9", None)])
def test_range(scan, model, op, a, b):
    up = op in ("GE", "GT")
    inside = [k for k in model if (k >= a if up else k <= a) and (op in ("GE", "LE") or k != a) and (b is None or (k <= b if up else k >= b))]
    assert [r.k for r in scan.range(op, a, b).items()] == sorted(inside, reverse=not up)


def test_search(scan, model, ops):
    gone = next(k for k, *_ in ops if k not in model)
    there = next(iter(model))
    assert scan.search(there).v == model[there]
    assert scan.search(gone) is None and scan.search("x") is None
    with pytest.raises(ValueError):
        scan.find("EQ")
    with pytest.raises(ValueError):
        scan.find("NE", "1")


def test_filters_see_only_live_newest_rows(scan, model):
    found = scan.filter(F.col("v") % 2 == 0).filter(lambda b: b["v"] > 100)
    assert [r.k for r in found.items()] == sorted(k for k, v in model.items() if v % 2 == 0 and v > 100)
    assert [r.k for r in found.limit(3).items()] == sorted(k for k, v in model.items() if v % 2 == 0 and v > 100)[:3]
    assert found.limit(0).count() == found.count()


def test_ranks_and_tombstones(scan, model):
    rows = sorted(scan.find("LE", "5").ranked().collect(), key=lambda r: r.rank)
    assert [r.k for r in rows] == sorted((k for k in model if k <= "5"), reverse=True)
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert scan.with_tombstones().count() == len({r.k for r in scan.log.collect()})


def test_early_stop(scan, model):
    seen = []
    scan.for_each(lambda r: seen.append(r.k) or len(seen) < 5)
    assert seen == sorted(model)[:5]


def test_key_predicates_reach_the_files(spark, scan, tmp_path):
    path = str(tmp_path / "log")
    scan.log.write.parquet(path)
    stored = scan_log(spark.read.parquet(path), ["k"], ["seq"], "deleted")
    plan = stored.find("GE", "2").rows()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,2)" in plan
    plan = stored.filter(F.col("v") > 3).rows()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,3)" not in plan.split("PushedFilters")[1].split("]")[0]


def test_composite_keys(spark):
    rows = [(a, b) for a in range(4) for b in "xyz"]
    df = spark.createDataFrame(rows, "a long, b string")
    for op, keep in ((Op.EQ, lambda r: r == (2, "y")), (Op.GE, lambda r: r >= (2, "y")), (Op.GT, lambda r: r > (2, "y")), (Op.LE, lambda r: r <= (2, "y")), (Op.LT, lambda r: r < (2, "y"))):
        assert {tuple(r) for r in df.where(tuple_predicate(["a", "b"], op, (2, "y"))).collect()} == {r for r in rows if keep(r)}
    with pytest.raises(ValueError):
        tuple_predicate(["a", "b"], Op.EQ, (1,))


def test_comparisons(spark):
    ints = spark.createDataFrame([(1, 2, -1), (2, 1, 1), (5, 5, 0), (-(1 << 63), 1, -1), ((1 << 63) - 1, -2, 1)], "a long, b long, want int")
    assert ints.where(compare_ints(F.col("a"), F.col("b")) != F.col("want")).isEmpty()
    texts = spark.createDataFrame([("", "0", -1), ("100", "9", -1), ("a", "a", 0), ("é", "z", 1), ("ab", "a", 1)], "a string, b string, want int")
    assert texts.where(compare_strings(F.col("a"), F.col("b")) != F.col("want")).isEmpty()
