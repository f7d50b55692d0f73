"""Keyed, versioned tables: an append-only log of upserts and tombstones, kept as key-sorted Parquet runs."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import replace
from functools import reduce
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.compare import Op
from ..operators.compaction import Plan, Policy, apart, plan, popped
from ..operators.resolve import newest
from ..operators.scan import Scan, bound_of
from ..spec import DELETED, LEVEL, SEQ, TableSpec
from .cache import SegmentedCache
from .manifest import FOLDER, Manifest, Part, Run, commit, load, versions
from .store import ObjectNotFound, ObjectStore

RUNS, INTENTS, ZONE = "runs", "_intents", "zone"
#: Seconds after which a writer that announced a run and never committed it is taken for dead.
DEAD_AFTER = 7 * 24 * 3600


def _path() -> Column:
    """Where a row's file is below the runs."""
    return F.substring_index("_metadata.file_path", f"/{RUNS}/", -1)


class LedgerTable:
    """A table at a path. Each write becomes a run in level 0; readers see one manifest version and never half a write.

    Of a key's versions the newest write is visible, by arrival and not by any time in the rows; a tombstone hides the
    key. Writers that race are told so by FileExistsError and may try again.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, policy: Policy | None = None, cache: SegmentedCache | None = None):
        self.spark, self.store, self.manifest, self.policy = spark, ObjectStore(spark, path), manifest, policy or Policy()
        self.cache, self.error, self._held, self._closed = cache, None, 0, False

    # -- making and opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: TableSpec, policy: Policy | None = None) -> LedgerTable:
        """A new, empty table; FileExistsError if there is one."""
        return cls(spark, path, commit(ObjectStore(spark, path), Manifest(spec)), policy)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, policy: Policy | None = None, cache: SegmentedCache | None = None) -> LedgerTable:
        """The table as of its newest version, or of ``version``; with a cache (``frame_cache``) its scans keep what they read."""
        return cls(spark, path, load(ObjectStore(spark, path), version), policy, cache)

    def close(self) -> None:
        """Ends writing through this handle; raises what a write failed with, if one did."""
        self._closed = True
        if self.error is not None:
            raise self.error

    @property
    def spec(self) -> TableSpec:
        return self.manifest.spec

    @property
    def name(self) -> str:
        return self.spec.name

    def refresh(self) -> LedgerTable:
        """Moves to the newest version."""
        self.manifest = load(self.store)
        return self

    def versions(self) -> list[int]:
        return versions(self.store)

    # -- writing

    def upsert(self, df: DataFrame, order: list[str] | None = None) -> None:
        """Writes rows. Of rows with one key in a batch, that with the largest ``order`` counts; without ``order``, any one."""
        self._write(self.spec.checked(df).withColumn(DELETED, F.lit(False)) if order is None else self._ordered(df, order, F.lit(False)))

    def delete(self, keys: DataFrame) -> None:
        """Hides keys, whether there or not."""
        values = [F.lit(None).cast(self.spec.schema[c].dataType).alias(c) for c in self.spec.values]
        rows = keys.select(*self.spec.keys, *values)
        self._write(self.spec.checked(rows).withColumn(DELETED, F.lit(True)))

    def apply(self, log: DataFrame, deleted: str, order: list[str]) -> None:
        """Writes a mixed batch: rows with true in ``deleted`` hide their key, others are upserts; ``order`` says which of a key's is last."""
        self._write(self._ordered(log, order, F.col(deleted)))

    def _ordered(self, df: DataFrame, order: list[str], deleted: Column) -> DataFrame:
        kept = newest(df, self.spec.keys, order).withColumn(DELETED, F.coalesce(deleted.cast("boolean"), F.lit(False)))
        return self.spec.checked(kept, DELETED)

    def _write(self, rows: DataFrame) -> None:
        if self._closed:
            raise ValueError("the table is closed")
        if self.error is not None:
            raise RuntimeError("an earlier write failed") from self.error
        seq = self.manifest.next_seq
        batch = rows.dropDuplicates(list(self.spec.keys)).withColumn(SEQ, F.lit(seq).cast("long"))

        def with_batch(run: Run | None) -> Manifest:
            state = replace(self.manifest, next_seq=seq + 1)
            return state if run is None else state.with_level(0, (run, *state.level(0)))

        try:
            self._committed(batch, seq, with_batch)
        except FileExistsError:
            raise
        except Exception as e:
            self.error = e
            raise
        if self.policy.auto and not self._held:
            self.compact_if_needed()

    def _committed(self, rows: DataFrame, max_seq: int, state, zones: dict[str, int] | None = None) -> None:
        """Writes a run and commits ``state(run)``. The run is announced first, so that no vacuum takes it for waste, and goes if the commit fails."""
        run_id = f"{max_seq:012d}-{uuid.uuid4().hex[:12]}"
        self.store.write(f"{INTENTS}/{run_id}", b"")
        try:
            try:
                new = state(self._run(rows, run_id, zones))
            except BaseException:
                self.store.delete(f"{RUNS}/{run_id}")
                raise
            try:
                self.manifest = commit(self.store, new)
            except FileExistsError:  # after any other failure the commit may still have come through
                self.store.delete(f"{RUNS}/{run_id}")
                raise
        finally:
            self.store.delete(f"{INTENTS}/{run_id}")

    def _run(self, rows: DataFrame, run_id: str, zones: dict[str, int] | None = None) -> Run | None:
        """Writes rows range-partitioned and sorted by key, so that files have disjoint key ranges and footers prune.

        With ``zones`` (of the files that rows come from) no file has rows of two zones. What the manifest has to know
        of the files is read back from their key columns, one row for each file.
        """
        keys, columns = list(self.spec.keys), self.spec.log_schema.fieldNames()
        order = [ZONE, *keys] if zones else keys
        out = rows.select(*columns, *([ZONE] if zones else [])).repartitionByRange(*order).sortWithinPartitions(*order)
        writer = out.write.option("compression", "zstd")
        if zones:
            writer = writer.partitionBy(ZONE)
        if self.spec.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(self.store.path(f"{RUNS}/{run_id}"))
        key = F.struct(*keys)
        written = self.spark.read.schema(self._run_schema()).parquet(self.store.path(f"{RUNS}/{run_id}"))
        files = written.groupBy(_path().alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("n"), F.sum(F.col(DELETED).cast("long")).alias("deleted"), F.min(key).alias("low"), F.max(key).alias("high"), F.max(SEQ).alias("top"))
        found = files.select("path", "bytes", "n", "deleted", "top", F.struct(*self.spec.comparable(F.col("low"))).alias("low"), F.struct(*self.spec.comparable(F.col("high"))).alias("high")).collect()
        if not found:
            self.store.delete(f"{RUNS}/{run_id}")
            return None
        parts = [Part(r.path, r.n, r.deleted, r.bytes, tuple(r.low), tuple(r.high)) for r in found]
        return Run(run_id, self._in_order(parts), max(r.top for r in found))

    def _in_order(self, parts: list[Part]) -> tuple[Part, ...]:
        return tuple(sorted(parts, key=lambda p: self.spec.ordered(p.low)))

    # -- reading

    def _run_schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in self.spec.log_schema.fields])

    def _read(self, parts: list[Part]) -> DataFrame:
        return self.spark.read.schema(self._run_schema()).parquet(*(self.store.path(f"{RUNS}/{p.path}") for p in parts))

    def log(self, first: int = 0, last: int | None = None, key: tuple | None = None) -> DataFrame:
        """All versions in levels ``first`` to ``last``, with their level; with ``key``, of the files that may hold it."""
        levels: dict[int, list[Part]] = {}
        at = self.spec.placed(key) if key is not None else None
        for level, run in self.manifest.runs(first, last):
            levels.setdefault(level, []).extend(p for p in run.parts if at is None or p.low <= at <= p.high)
        levels = {n: parts for n, parts in levels.items() if parts}
        if not levels:
            return self.spark.createDataFrame([], T.StructType([*self._run_schema().fields, T.StructField(LEVEL, T.IntegerType())]))
        return reduce(DataFrame.unionByName, (self._read(parts).withColumn(LEVEL, F.lit(n)) for n, parts in levels.items()))

    def scan(self, first: int = 0, last: int | None = None) -> Scan:
        """A scan of this version of the table, or of some of its levels; kept for the next one if the table has a cache."""
        if self.cache is None:
            log = self.log(first, last)
        else:
            size = sum(r.bytes for _, r in self.manifest.runs(first, last))
            log = self.cache.read((self.store.base, self.manifest.version, first, last), lambda: (self.log(first, last).persist(), size))
        return Scan(log, self.spec.keys, (SEQ,), DELETED, hidden=(SEQ, LEVEL))

    def find(self, op: Op | str, key=None) -> Scan:
        return self.scan().find(op, key)

    def find_range(self, op: Op | str, start=None, end=None) -> Scan:
        return self.scan().range(op, start, end)

    def search(self, key) -> Row | None:
        """The live row of a key: levels from the newest on until one has the key.

        The manifest's key ranges leave one file a run at most, and its statistics and Bloom filter exclude most of those.
        """
        bound = bound_of(key, len(self.spec.keys))
        for level in range(len(self.manifest.levels)):
            if self.manifest.level(level):
                log = self.log(level, level, bound)
                found = Scan(log, self.spec.keys, (SEQ,), DELETED, hidden=(SEQ, LEVEL)).with_tombstones().find(Op.EQ, key).df().take(1)
                if found:
                    row = found[0].asDict()
                    return None if row.pop(DELETED) else Row(**row)
        return None

    def search_many(self, keys: DataFrame) -> DataFrame:
        """Live rows of all ``keys``, by one semi-join below resolution."""
        scan = self.scan()
        wanted = keys.select(*self.spec.keys).distinct()
        return replace(scan, log=scan.log.join(wanted, list(self.spec.keys), "left_semi")).rows()

    def items(self) -> list[Row]:
        return self.scan().items()

    def show(self, n: int = 20) -> None:
        self.scan().show(n)

    # -- counting

    def count_physical(self) -> int:
        """Entries of all runs, tombstones and superseded versions included; the manifest knows it."""
        return sum(r.rows for _, r in self.manifest.runs())

    def count_deleted(self) -> int:
        """Tombstones of all runs."""
        return sum(r.deleted for _, r in self.manifest.runs())

    def count_live(self) -> int:
        return self.scan().rows().count()

    def memory_usage(self) -> int:
        """Bytes of level 0, which no compaction has touched."""
        return sum(r.bytes for r in self.manifest.level(0))

    def stats(self) -> DataFrame:
        """level, runs, entries, tombstones, bytes."""
        rows = [(n, len(runs), sum(r.rows for r in runs), sum(r.deleted for r in runs), sum(r.bytes for r in runs)) for n, runs in enumerate(self.manifest.levels) if runs]
        return self.spark.createDataFrame(rows, "level int, runs int, entries long, tombstones long, bytes long")

    def run_paths(self) -> list[str]:
        return [self.store.path(f"{RUNS}/{p.path}") for _, r in self.manifest.runs() for p in r.parts]

    # -- compacting

    def flush(self) -> None:
        """Merges the batches of level 0 into level 1, and these into level 2."""
        self.compact(0, 1)
        self.compact(1, 2)

    def compact(self, first: int, last: int) -> None:
        """Merges levels ``first`` to ``last`` into one run in ``last``, which a later step may move up.

        Only files whose key ranges overlap are rewritten (``apart``); others pass into the new run as they are, so a
        merge costs what overlaps and not what the levels hold.
        """
        todo = plan(self.manifest, first, last, self.policy)
        if todo is not None:
            self._merge(todo)

    def _merge(self, todo: Plan) -> None:
        runs = [r for _, r in self.manifest.runs(todo.first, todo.last)]
        stay, groups = apart(self.spec, [p for r in runs for p in r.parts], todo.drop_tombstones)
        top = max(r.max_seq for r in runs)

        def with_run(new: Run | None) -> Manifest:
            state = self.manifest
            for n in range(todo.first, todo.last + 1):
                state = state.with_level(n, ())
            parts = self._in_order([*stay, *(new.parts if new else ())])
            if parts:
                state = state.with_level(todo.last, (Run(new.run_id if new else runs[0].run_id, parts, top),))
            return popped(state, todo.last, self.policy)

        if not groups:
            self.manifest = commit(self.store, with_run(None))
            return
        rows = self._read([p for g in groups for p in g])
        zones = {p.path: n for n, g in enumerate(groups) for p in g} if len(groups) > 1 else None
        if zones:
            of = self.spark.createDataFrame(list(zones.items()), f"_file string, {ZONE} int")
            rows = rows.withColumn("_file", _path()).join(F.broadcast(of), "_file").drop("_file")  # a row for each file that the manifest names
        rows = newest(rows, self.spec.keys, (SEQ,))
        self._committed(rows.where(~F.col(DELETED)) if todo.drop_tombstones else rows, top, with_run, zones)

    def compact_all(self) -> None:
        """One run of live rows only."""
        self.compact(0, max(1, len(self.manifest.levels) - 1))

    def compact_if_needed(self) -> None:
        """Merges levels into the next while one holds more than it may."""
        while (n := self.policy.too_large(self.manifest)) is not None and n + 1 < self.policy.most_levels:
            before = self.manifest.version
            self.compact(n, n + 1)
            if self.manifest.version == before or self.policy.too_large(self.manifest) == n:
                break

    def hold_compaction(self) -> None:
        """No automatic compaction until released as often as held."""
        self._held += 1

    def release_compaction(self) -> None:
        if not self._held:
            raise RuntimeError("compaction is not held")
        self._held -= 1

    @contextmanager
    def compaction_held(self):
        self.hold_compaction()
        try:
            yield self
        finally:
            self.release_compaction()

    def vacuum(self, keep_versions: int = 1, dead_after: float = DEAD_AFTER) -> list[str]:
        """Drops all but the newest ``keep_versions`` manifests, and the files that none of those names; returns the runs that are gone.

        Runs that a writer has announced and not committed yet are spared, unless the announcement is older than
        ``dead_after`` seconds. Runs are listed before announcements and these before manifests, so that a run which is
        committed meanwhile is seen in one or the other.
        """
        if keep_versions < 1:
            raise ValueError("one version must stay")
        runs = self.store.folders(RUNS)
        spared = set()
        for run_id, _ in self.store.list(INTENTS):
            try:
                old = self.store.age(f"{INTENTS}/{run_id}") > dead_after
            except Exception:
                if self.store.exists(f"{INTENTS}/{run_id}"):
                    raise
                old = False  # committed or given up just now: spared for this time
            if old:
                self.store.delete(f"{INTENTS}/{run_id}")
            else:
                spared.add(run_id)
        known = self.versions()
        kept = known[-keep_versions:]
        used: dict[str, set[str]] = {}
        for v in kept:
            for _, run in load(self.store, v).runs():
                for p in run.parts:
                    used.setdefault(p.path.split("/", 1)[0], set()).add(p.path)
        for v in known[:-keep_versions]:
            self.store.delete(f"{FOLDER}/{v:012d}.json")
        gone = [r for r in runs if r not in used and r not in spared]
        for r in gone:
            self.store.delete(f"{RUNS}/{r}")
        for r in set(runs) & set(used) - spared:
            for folder in (r, *(f"{r}/{z}" for z in self.store.folders(f"{RUNS}/{r}"))):
                for name, _ in self.store.list(f"{RUNS}/{folder}"):
                    if name.endswith(".parquet") and f"{folder}/{name}" not in used[r]:
                        self.store.delete(f"{RUNS}/{folder}/{name}")
        return gone

    def verify(self) -> DataFrame:
        """Faults of the stored runs: run, fault. Files must be what the manifest says of them, files of a run must not overlap in keys, and keys must be unique in it."""
        faults, twice = [], []
        for _, run in self.manifest.runs():
            for p in run.parts:
                if not self.store.exists(f"{RUNS}/{p.path}"):
                    raise ObjectNotFound(self.store.path(f"{RUNS}/{p.path}"))
            faults += [(run.run_id, "files overlap") for a, b in pairwise(run.parts) if self.spec.ordered(a.high) >= self.spec.ordered(b.low)]
            rows = self._read(list(run.parts))
            key = F.struct(*self.spec.keys)
            files = rows.groupBy(_path().alias("name")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
            files = files.select("name", "n", F.struct(*self.spec.comparable(F.col("low"))).alias("low"), F.struct(*self.spec.comparable(F.col("high"))).alias("high"))
            there = {r.name: (r.n, tuple(r.low), tuple(r.high)) for r in files.collect()}
            faults += [(run.run_id, "file differs") for p in run.parts if there.get(p.path) != (p.rows, p.low, p.high)]
            twice.append(rows.groupBy(*self.spec.keys).count().where("count > 1").select(F.lit(run.run_id).alias("run"), F.lit("key twice").alias("fault")).distinct())
        return reduce(DataFrame.unionByName, twice, self.spark.createDataFrame(faults, "run string, fault string"))


def frame_cache(capacity: int) -> SegmentedCache:
    """A cache of read levels for tables, up to about ``capacity`` bytes of their files; what goes is unpersisted."""
    return SegmentedCache(capacity, lambda df: df.unpersist())
