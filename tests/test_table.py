"""Stored tables: writes, versions, compaction, cursors, streams."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.compaction import Policy, apart, plan
from ledgerline.sources.cursor import LiveCursor, keyset_page
from ledgerline.sources.manifest import Manifest, Part, Run, commit
from ledgerline.sources.store import ObjectNotFound, ObjectStore
from ledgerline.sources.table import LedgerTable, frame_cache
from ledgerline.spec import TableSpec
from ledgerline.streaming.ingest import ingest

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
SPEC = TableSpec("t", SCHEMA, ("k",))
MANUAL = Policy(auto=False)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def contents(table):
    return {r.k: r.v for r in table.scan().rows().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return LedgerTable.create(spark, str(tmp_path / "t"), SPEC, MANUAL)


def test_upsert_delete_reopen(spark, table):
    table.upsert(rows(spark, [("a", 1), ("b", 2), ("c", 3)]))
    table.delete(spark.createDataFrame([("b",), ("zz",)], "k string"))
    table.upsert(rows(spark, [("a", 9)]))
    assert contents(table) == {"a": 9, "c": 3}
    assert table.search("a").v == 9 and table.search("b") is None and table.search("q") is None
    assert (table.count_physical(), table.count_deleted(), table.count_live()) == (6, 2, 2)
    again = LedgerTable.open(spark, table.store.base)
    assert contents(again) == {"a": 9, "c": 3}
    assert contents(LedgerTable.open(spark, table.store.base, version=2)) == {"a": 1, "b": 2, "c": 3}
    assert [r.k for r in table.find_range("LE", "c", "b").items()] == ["c"]
    assert {r.k for r in table.search_many(spark.createDataFrame([("a",), ("b",)], "k string")).collect()} == {"a"}
    with pytest.raises(FileExistsError):
        LedgerTable.create(spark, table.store.base, SPEC)
    with pytest.raises(FileNotFoundError):
        LedgerTable.open(spark, table.store.base + "x")


def test_empty_table(spark, table):
    assert contents(table) == {} and table.search("a") is None and table.count_physical() == 0
    table.upsert(rows(spark, []))
    assert table.count_physical() == 0 and table.stats().count() == 0
    table.flush()
    table.compact_all()
    assert table.verify().isEmpty()


def test_null_keys_are_refused(spark, table):
    with pytest.raises(Exception, match="null in key column k"):
        table.upsert(rows(spark, [(None, 1)]))
    with pytest.raises(ValueError):
        TableSpec("t", SCHEMA, ("x",))
    with pytest.raises(ValueError):
        TableSpec("t", SCHEMA, ())


def test_batches_resolve_by_order(spark, table):
    log = spark.createDataFrame([("a", 1, False, 1), ("a", 2, False, 2), ("b", 1, False, 1), ("b", 0, True, 2), ("c", 0, True, 1), ("c", 5, False, 2)], "k string, v long, gone boolean, o long")
    table.apply(log, "gone", ["o"])
    assert contents(table) == {"a": 2, "c": 5} and table.count_deleted() == 1


def test_random_operations_survive_every_compaction(spark, table):
    rng, model = random.Random(3), {}
    for step in range(6):
        log = [(str(rng.randrange(60)), rng.randrange(100), rng.random() < 0.4, i) for i in range(80)]
        for k, v, gone, _ in log:
            model[k] = None if gone else v
        table.apply(spark.createDataFrame(log, "k string, v long, gone boolean, o long"), "gone", ["o"])
        if step == 2:
            table.compact(0, 1)
        if step == 4:
            table.compact(0, 0)
    want = {k: v for k, v in model.items() if v is not None}
    assert contents(table) == want
    table.compact(0, 1)
    assert contents(table) == want
    assert table.verify().isEmpty()
    table.compact_all()
    assert contents(table) == want and table.count_physical() == len(want) and table.count_deleted() == 0
    gone = table.vacuum()
    assert gone and contents(LedgerTable.open(spark, table.store.base)) == want
    assert len(table.versions()) == 1


def test_tombstones_stay_above_older_runs(spark, tmp_path):
    table = LedgerTable.create(spark, str(tmp_path / "deep"), SPEC, Policy(auto=False, base_bytes=1))
    table.upsert(rows(spark, [("a", 1), ("b", 1)]))
    table.compact(0, 3)
    table.delete(spark.createDataFrame([("a",)], "k string"))
    table.upsert(rows(spark, [("c", 1)]))
    table.compact(0, 1)
    assert table.count_deleted() == 1 and contents(table) == {"b": 1, "c": 1}
    table.compact_all()
    assert table.count_deleted() == 0 and contents(table) == {"b": 1, "c": 1}


def test_small_runs_move_up(spark, table):
    table.upsert(rows(spark, [("a", 1)]))
    table.compact(0, 3)
    assert [len(level) for level in table.manifest.levels] == [0, 1] and contents(table) == {"a": 1}


def test_plans():
    run = Run("r", (Part("r/p", 1, 0, 100, ("a",), ("b",)),), 1)
    one = Manifest(SPEC).with_level(0, (run,))
    assert plan(one, 0, 1, MANUAL).move
    assert plan(one, 1, 2, MANUAL) is None
    two = one.with_level(2, (run,))
    assert not plan(two, 0, 1, MANUAL).drop_tombstones and plan(two, 0, 2, MANUAL).drop_tombstones
    assert [Policy().threshold(n) >> 20 for n in range(6)] == [8, 8, 8, 32, 128, 512]
    with pytest.raises(ValueError):
        plan(one, 2, 1, MANUAL)


def test_automatic_compaction_can_be_held(spark, tmp_path):
    table = LedgerTable.create(spark, str(tmp_path / "auto"), SPEC, Policy(base_bytes=1))
    with table.compaction_held(), table.compaction_held():
        for i in range(2):
            table.upsert(rows(spark, [(str(i), i)]))
        assert len(table.manifest.level(0)) == 2
    table.upsert(rows(spark, [("x", 1)]))
    assert not table.manifest.level(0) and contents(table) == {"0": 0, "1": 1, "x": 1}
    with pytest.raises(RuntimeError):
        table.release_compaction()


def test_racing_writers(spark, table):
    other = LedgerTable.open(spark, table.store.base, policy=MANUAL)
    table.upsert(rows(spark, [("a", 1)]))
    with pytest.raises(FileExistsError):
        other.upsert(rows(spark, [("b", 1)]))
    other.refresh().upsert(rows(spark, [("b", 1)]))
    assert contents(table.refresh()) == {"a": 1, "b": 1}


def test_live_cursor_sees_rows_ahead(spark, table):
    table.upsert(rows(spark, [("0", 0)]))
    cursor = LiveCursor(table, "GE", page=1)
    writer = LedgerTable.open(spark, table.store.base, policy=MANUAL)
    assert [r.k for r in cursor.next_page()] == ["0"]
    writer.upsert(rows(spark, [("01", 1), ("10", 2), ("/", 3)]))
    assert [r.k for r in cursor] == ["01", "10"]
    writer.refresh().upsert(rows(spark, [("100", 1), ("1000", 1)]))
    assert [r.k for r in cursor] == ["100", "1000"]
    back = LiveCursor(table, "LT", "10", filters=(F.col("v") != 1,), limit=1, page=5)
    assert [r.k for r in back] == ["0"]
    assert [r.k for r in LiveCursor(table, "EQ", "10")] == ["10"]


def test_live_cursor_leaves_pages_where_they_lie(spark, table, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    got, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: got.append(rows := collect(df)) or rows)
    table.upsert(rows(spark, [(f"{i:04d}", i) for i in range(2000)]))
    cursor = LiveCursor(table, "GE", page=600)
    writer = LedgerTable.open(spark, table.store.base, policy=MANUAL)
    pages = [cursor.next_df()]
    writer.upsert(rows(spark, [("0001x", -1), ("0600", -2), ("1999x", -3)]))
    pages.append(cursor.next_df())
    writer.delete(spark.createDataFrame([("0600",), ("1500",)], "k string"))
    cursor.page = 0
    pages += cursor.pages()
    assert cursor.next_df() is None and max(map(len, got)) < 100
    got = [[(r.k, r.v) for r in collect(p)] for p in pages]
    assert got == [[(f"{i:04d}", i) for i in range(600)], [("0600", -2), *((f"{i:04d}", i) for i in range(601, 1200))], [*((f"{i:04d}", i) for i in range(1200, 2000) if i != 1500), ("1999x", -3)]]
    for args in ({"op": "LE", "start": "0010", "end": "0002", "page": 4}, {"op": "LT", "start": "0010", "filters": (F.col("v") % 2 == 0,), "limit": 3, "page": 2}, {"op": "EQ", "start": "0007"}, {"op": "GT", "start": "1999x"}):
        assert [r for p in LiveCursor(table, **args).pages() for r in collect(p)] == list(LiveCursor(table, **args))


def test_keyset_pages_cover_all(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(40)], "a long, b long")
    got, last = [], None
    while page := keyset_page(df, ["a", "b"], last, 9).collect():
        got += [tuple(r) for r in page]
        last = got[-1]
    assert got == sorted((i % 7, i) for i in range(40))


def test_stream(spark, table, tmp_path):
    source = str(tmp_path / "source")
    log = spark.createDataFrame([("a", 1, False, 1), ("b", 1, False, 2)], "k string, v long, gone boolean, o long")
    log.write.parquet(source)

    def run():
        stream = spark.readStream.schema(log.schema).parquet(source)
        ingest(stream, table, "gone", ["o"], str(tmp_path / "state")).awaitTermination()
        return contents(table.refresh())

    assert run() == {"a": 1, "b": 1}
    spark.createDataFrame([("a", 0, True, 3), ("c", 7, False, 4)], log.schema).write.mode("append").parquet(source)
    assert run() == {"b": 1, "c": 7}
    before = table.manifest.version
    assert run() == {"b": 1, "c": 7} and table.manifest.version == before


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path))
    store.write("d/a", bytes(range(256)))
    store.write("d/b", b"x")
    assert store.list("d") == [("a", 256), ("b", 1)] and store.list("none") == []
    assert store.list("d", lambda name, size: False) == [("a", 256)]
    assert store.read("d/a", 250, 100) == bytes(range(250, 256)) and store.read("d/a", 10, 2) == b"\x0a\x0b" and store.read("d/a", 999) == b""
    with pytest.raises(FileExistsError):
        store.write("d/b", b"y")
    store.write("d/b", b"y", overwrite=True)
    assert store.read("d/b") == b"y" and store.delete("d/b") and not store.delete("d/b")
    with pytest.raises(ObjectNotFound):
        store.read("d/b")


def test_manifest_round_trip_and_format(spark, tmp_path):
    m = Manifest(SPEC, notes={"x": 1}).with_level(2, (Run("r", (Part("r/p", 1, 0, 5, ("a", 1), ("b", 2)),), 1),))
    assert Manifest.from_bytes(m.to_bytes()) == m
    with pytest.raises(ValueError):
        Manifest.from_bytes(m.to_bytes().replace(b'"format_version": 2', b'"format_version": 99'))
    assert commit(ObjectStore(spark, str(tmp_path)), m).version == 1


def test_only_overlapping_files_are_merged(spark, table):
    part = lambda name, low, high, deleted=0: Part(name, 5, deleted, 100, (low,), (high,))
    files = [part("1", "a", "c"), part("2", "c", "d"), part("3", "e", "f"), part("4", "g", "h"), part("5", "h", "k"), part("6", "j", "l"), part("7", "m", "n", 2)]
    names = lambda x: [p.path for p in x]
    stay, groups = apart(SPEC, files, False)
    assert names(stay) == ["3", "7"] and [names(g) for g in groups] == [["1", "2"], ["4", "5", "6"]]
    stay, groups = apart(SPEC, files, True)
    assert names(stay) == ["3"] and [names(g) for g in groups] == [["1", "2"], ["4", "5", "6", "7"]]
    for n in range(4):
        table.upsert(rows(spark, [(f"{i:04d}", i) for i in range(250 * n, 250 * n + 250)]))
    written = set(table.run_paths())
    table.compact(0, 1)
    before = table.manifest.level(1)[0].parts
    assert len(before) == 4 and set(table.run_paths()) == written
    low, high = before[1].low[0], before[1].high[0]
    table.upsert(rows(spark, [(low, -1), (high, -2)]))
    table.upsert(rows(spark, [("9999", -3)]))
    table.upsert(rows(spark, [("5000", -4)]))
    table.delete(spark.createDataFrame([("5000",)], "k string"))
    table.delete(spark.createDataFrame([("0000",)], "k string"))
    table.compact(0, 1)
    after = table.manifest.level(1)[0]
    assert {before[2].path, before[3].path} <= {p.path for p in after.parts}
    assert not {before[0].path, before[1].path} & {p.path for p in after.parts}
    want = {f"{i:04d}": i for i in range(1, 1000)} | {low: -1, high: -2, "9999": -3}
    want.pop("0000", None)
    assert contents(table) == want and table.verify().isEmpty()
    table.vacuum()
    assert contents(LedgerTable.open(spark, table.store.base)) == want
    assert table.search(low).v == -1 and table.search("0000") is None and table.search("9999").v == -3


def test_zones_keep_files_apart(spark, tmp_path):
    table = LedgerTable.create(spark, str(tmp_path / "z"), SPEC, MANUAL)
    for lo in ("a", "m", "x"):
        table.upsert(rows(spark, [(f"{lo}{i}", i) for i in range(5)]).coalesce(1))
    table.upsert(rows(spark, [("a1", 100)]))
    table.upsert(rows(spark, [("x1", 100)]))
    middle = {p.path for r in table.manifest.level(0) for p in r.parts if p.low[0].startswith("m")}
    table.compact(0, 1)
    run = table.manifest.level(1)[0]
    assert middle <= {p.path for p in run.parts} and table.verify().isEmpty()
    assert contents(table) == {f"{lo}{i}": i for lo in "amx" for i in range(5)} | {"a1": 100, "x1": 100}
    table.vacuum()
    assert table.count_live() == 15 and LedgerTable.open(spark, table.store.base).search("m3").v == 3


def test_keys_of_many_types_have_ranges(spark, tmp_path):
    import datetime
    import decimal

    schema = T.StructType([T.StructField("d", T.DecimalType(10, 2)), T.StructField("t", T.TimestampType()), T.StructField("f", T.DoubleType()), T.StructField("b", T.BinaryType()), T.StructField("day", T.DateType()), T.StructField("v", T.LongType())])
    table = LedgerTable.create(spark, str(tmp_path / "typed"), TableSpec("typed", schema, ("d", "t", "f", "b", "day")), MANUAL)
    moment = datetime.datetime(2024, 1, 2, 3, 4, 5)
    made = [(decimal.Decimal(n), moment, x, b"\x00\xff", datetime.date(2024, 1, 2), i) for i, (n, x) in enumerate([(9, 1.0), (10, float("nan")), (-3, 0.5), (100, -1.0)])]
    table.upsert(spark.createDataFrame(made, schema))
    table.upsert(spark.createDataFrame(made[:2], schema))
    table.compact(0, 1)
    assert table.count_live() == 4 and table.verify().isEmpty()
    assert LedgerTable.open(spark, table.store.base).search(made[0][:5]).v == 0


def test_small_writes_are_merged_automatically(spark, tmp_path):
    table = LedgerTable.create(spark, str(tmp_path / "small"), SPEC, Policy(most_batches=2))
    for i in range(7):
        table.upsert(rows(spark, [(str(i), i)]))
        assert len(table.manifest.level(0)) <= 2
    assert contents(table) == {str(i): i for i in range(7)}


def test_vacuum_spares_what_a_writer_has_not_committed(spark, table, monkeypatch):
    from ledgerline.sources import table as module

    table.upsert(rows(spark, [("a", 1)]))
    other = LedgerTable.open(spark, table.store.base, policy=MANUAL)
    real, gone = module.commit, []

    def late(store, manifest):
        gone.extend(other.vacuum())
        return real(store, manifest)

    monkeypatch.setattr(module, "commit", late)
    table.upsert(rows(spark, [("b", 2)]))
    monkeypatch.setattr(module, "commit", real)
    assert not gone and contents(table) == {"a": 1, "b": 2}
    table.store.write("_intents/dead", b"")
    table.store.write("runs/dead/x.parquet", b"x")
    assert table.vacuum() == [] and table.vacuum(dead_after=-1) == ["dead"] and contents(table.refresh()) == {"a": 1, "b": 2}


def test_writers_at_once(spark, table):
    """Many threads write the same version: one wins each time, the others try again, and nothing is lost."""
    import threading

    won = []

    def work(n):
        store = ObjectStore(spark, table.store.base)
        for i in range(10):
            try:
                store.write(f"race/{i}", str(n).encode())
                won.append((i, n))
            except FileExistsError:
                pass

    threads = [threading.Thread(target=work, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(i for i, _ in won) == list(range(10))
    assert all(table.store.read(f"race/{i}") == str(n).encode() for i, n in won)
    assert [name for name, _ in table.store.list("race")] == sorted(map(str, range(10)))

    def writer(n):
        own = LedgerTable.open(spark, table.store.base, policy=MANUAL)
        while True:
            try:
                own.refresh().upsert(rows(spark, [(f"w{n}", n)]))
                return
            except FileExistsError:
                continue

    threads = [threading.Thread(target=writer, args=(n,)) for n in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert contents(table.refresh()) == {f"w{n}": n for n in range(3)}
    assert table.vacuum() == [] and table.store.list("_intents") == []


def test_other_file_systems_rename_exclusively(spark, tmp_path):
    """A store that is not a local disk goes through Hadoop's rename."""
    (tmp_path / "v").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tests.link./at", f"file://{tmp_path}/v")
    store = ObjectStore(spark, "viewfs://tests/at")
    store.write("d/a", b"1")
    with pytest.raises(FileExistsError):
        store.write("d/a", b"2")
    store.write("d/a", b"3", overwrite=True)
    assert store.read("d/a") == b"3" and store.list("d") == [("a", 1)]
    entered = []

    class Lock:
        def __init__(self, path):
            self.path = path

        def __enter__(self):
            entered.append(self.path)

        def __exit__(self, *e):
            return False

    ObjectStore(spark, str(tmp_path), Lock).write("x", b"")
    assert entered == [f"{tmp_path}/x"]


def test_failed_writes_stick_and_closed_tables_refuse(spark, table):
    table.upsert(rows(spark, [("a", 1)]))
    with pytest.raises(Exception, match="null in key"):
        table.upsert(rows(spark, [(None, 1)]))
    with pytest.raises(RuntimeError, match="earlier write failed"):
        table.upsert(rows(spark, [("b", 1)]))
    with pytest.raises(Exception, match="null in key"):
        table.close()
    again = LedgerTable.open(spark, table.store.base, policy=MANUAL)
    again.close()
    with pytest.raises(ValueError):
        again.upsert(rows(spark, [("b", 1)]))
    assert contents(again) == {"a": 1} and table.store.list("_intents") == []


def test_scans_through_a_cache(spark, table):
    table.upsert(rows(spark, [("a", 1)]))
    cached = LedgerTable.open(spark, table.store.base, policy=MANUAL, cache=frame_cache(1 << 20))
    assert contents(cached) == contents(cached) == {"a": 1} and cached.cache.hit_ratio == 0.5
    cached.upsert(rows(spark, [("b", 2)]))
    assert contents(cached) == {"a": 1, "b": 2} and cached.cache.reads == 3
    cached.cache.capacity = 0
    assert len(cached.cache) == 0
