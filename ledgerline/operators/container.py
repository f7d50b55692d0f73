"""Ordered containers: multisets of rows kept by key, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.compare import Op, tuple_predicate
from ..sources.store import checkpoint
from .order import nearest, neighbours, ranked
from .scan import bound_of

#: Rows that a removal gives a task, about, where the session's number of partitions would give it more.
ROWS = 500_000


@dataclass(frozen=True)
class Ordered:
    """Rows with an order by ``keys``; equal keys may repeat. Operations return new containers and leave this one as it is."""

    df: DataFrame
    keys: tuple[str, ...]

    @classmethod
    def of(cls, spark: SparkSession, rows: list, schema: str, *keys: str) -> Ordered:
        return cls(spark.createDataFrame(rows, schema), keys)

    def insert(self, rows: DataFrame) -> Ordered:
        """Adds rows, duplicates too."""
        return replace(self, df=self.df.unionByName(rows.select(*self.df.columns)))

    def insert_or_replace(self, rows: DataFrame) -> Ordered:
        """Adds rows in place of all that have their keys; of rows with one key, any one is added."""
        new = rows.select(*self.df.columns).dropDuplicates(list(self.keys))
        return replace(self, df=self.df.join(new, list(self.keys), "left_anti").select(*self.df.columns).unionByName(new))

    def search(self, key) -> Row | None:
        """Any one row with the key, or None."""
        found = self.df.where(tuple_predicate(self.keys, Op.EQ, bound_of(key, len(self.keys)))).take(1)
        return found[0] if found else None

    def remove(self, keys: DataFrame) -> Ordered:
        """Takes away one row for each row of ``keys``, as long as there are any; missing keys do nothing.

        Copies of a key are counted where they lie, part by part, and each part is told how many of its own go. So the
        copies of a key never come together, however many there are. A task has about ``ROWS`` rows, however many there are.
        """
        return self._without(keys, list(self.keys))

    def remove_items(self, rows: DataFrame) -> Ordered:
        """Takes away one row for each of ``rows`` that equals it in all columns: what a cursor stands on, say. Missing rows do nothing."""
        return self._without(rows, self.df.columns)

    def _without(self, rows: DataFrame, columns: list[str]) -> Ordered:
        key = F.struct(*columns).alias("_key")  # as structs, nulls equal each other
        own = F.struct(*self.df.columns).alias("_row")
        asked = rows.select(F.lit(None).cast(self.df.select(own).schema["_row"].dataType).alias("_row"), key, F.lit(True).alias("_asked"))
        both = self.df.select(own, key, F.lit(False).alias("_asked")).union(asked)
        both = checkpoint(both.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
        tasks = -(-both.count() // ROWS)
        few = tasks <= int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def dealt(df: DataFrame, *by: str) -> DataFrame:
            return df if few else df.repartition(tasks, *by)

        place = Window.partitionBy("_key").orderBy(F.desc("_asked"), "_part").rowsBetween(Window.unboundedPreceding, -1)  # what is asked for comes first
        here = dealt(both.select("_key", "_part", "_asked"), "_key", "_part").groupBy("_key", "_part", "_asked").agg(F.count("*").alias("_n"))
        wanted = F.sum(F.when(F.col("_asked"), F.col("_n")).otherwise(-F.col("_n"))).over(place)
        quota = dealt(here, "_key").withColumn("_go", F.least("_n", F.coalesce(wanted, F.lit(0)))).where("not _asked and _go > 0")
        quota = dealt(checkpoint(quota.select("_key", "_part", "_go")), "_key", "_part")
        numbered = F.row_number().over(Window.partitionBy("_key", "_part").orderBy("_id"))
        left = dealt(both.where("not _asked"), "_key", "_part").withColumn("_own", numbered).join(quota, ["_key", "_part"], "left")
        return replace(self, df=left.where(F.col("_own") > F.coalesce("_go", F.lit(0))).select("_row.*"))

    def remove_key(self, *key) -> Ordered:
        schema = ", ".join(f"`{k}` {self.df.schema[k].dataType.simpleString()}" for k in self.keys)
        return self.remove(self.df.sparkSession.createDataFrame([key], schema))

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def clear(self) -> Ordered:
        return replace(self, df=self.df.limit(0))

    def sorted(self, descending: bool = False) -> DataFrame:
        return self.df.orderBy(*(F.col(k).desc() if descending else F.col(k).asc() for k in self.keys))

    def items(self) -> list[Row]:
        return self.sorted().collect()

    def first(self) -> Row | None:
        return next(iter(self.sorted().take(1)), None)

    def last(self) -> Row | None:
        return next(iter(self.sorted(True).take(1)), None)

    def remove_at(self, row: Row) -> tuple[Ordered, Row | None]:
        """(the container without ``row``, the row that a cursor standing on it goes on to)."""
        spark = self.df.sparkSession
        rest = self.remove_items(spark.createDataFrame([row], self.df.schema))
        return rest, rest.find(Op.GE, tuple(row[k] for k in self.keys))

    def find(self, op: Op | str, key) -> Row | None:
        """The row nearest to the bound that is ``op`` it: equal, ceiling (GE), higher (GT), floor (LE) or lower (LT). None bounds nothing."""
        op, bound = Op.of(op), bound_of(key, len(self.keys))
        if bound is None and op is Op.EQ:
            raise ValueError("EQ needs a key")
        rows = self.df if bound is None else self.df.where(tuple_predicate(self.keys, op, bound))
        return next(iter(replace(self, df=rows).sorted(op.descending).take(1)), None)

    def for_each(self, visit: Callable[[Row], bool | None]) -> None:
        """Visits rows in order until ``visit`` returns False."""
        for row in self:
            if visit(row) is False:
                return

    def __iter__(self) -> Iterator[Row]:
        return self.sorted().toLocalIterator()

    def backward(self) -> Iterator[Row]:
        return self.sorted(True).toLocalIterator()

    def ranked(self, descending: bool = False) -> DataFrame:
        return ranked(self.df, self.keys, descending)

    def neighbours(self, value: str | None = None) -> DataFrame:
        """All rows with ``prev`` and ``next``, a value of the rows beside them."""
        return neighbours(self.df, self.keys, value or self.keys[0])

    def nearest(self, probes: DataFrame, probe: str) -> DataFrame:
        """``probes`` with lower, floor, ceiling and higher keys; for containers with one key column."""
        if len(self.keys) != 1:
            raise ValueError("nearest needs one key column")
        return nearest(probes, self.df, self.keys[0], probe)

    def show(self, n: int = 20) -> None:
        self.sorted().show(n, truncate=False)


@dataclass(frozen=True)
class Sequence:
    """A list of rows by position, a long column; the front is the smallest. Rows know no neighbours, so all changes are columns."""

    df: DataFrame
    position: str = "position"

    def _ends(self) -> tuple[int, int]:
        low, high = self.df.agg(F.coalesce(F.min(self.position), F.lit(0)), F.coalesce(F.max(self.position), F.lit(-1))).first()
        return low, high

    def _join(self, other: DataFrame, front: bool) -> Sequence:
        low, high = self._ends()
        o_low, o_high = Sequence(other, self.position)._ends()
        shift = low - 1 - o_high if front else high + 1 - o_low
        moved = other.withColumn(self.position, F.col(self.position) + F.lit(shift))
        return replace(self, df=self.df.unionByName(moved.select(*self.df.columns)))

    def add(self, rows: DataFrame) -> Sequence:
        """Rows (with positions among themselves) in front."""
        return self._join(rows, True)

    def add_tail(self, rows: DataFrame) -> Sequence:
        return self._join(rows, False)

    splice, splice_tail = add, add_tail

    def _moved(self, condition, front: bool) -> Sequence:
        picked = replace(self, df=self.df.where(condition))
        return self.remove(condition)._join(picked.df, front)

    def move(self, condition) -> Sequence:
        """Rows for which ``condition`` holds, to the front."""
        return self._moved(condition, True)

    def move_tail(self, condition) -> Sequence:
        return self._moved(condition, False)

    def remove(self, condition) -> Sequence:
        return replace(self, df=self.df.where(~F.coalesce(condition, F.lit(False))))

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def contains(self, condition) -> bool:
        return not self.df.where(condition).isEmpty()

    def first(self) -> Row | None:
        return next(iter(self.df.orderBy(self.position).take(1)), None)

    def last(self) -> Row | None:
        return next(iter(self.df.orderBy(F.desc(self.position)).take(1)), None)

    def items(self) -> list[Row]:
        return self.df.orderBy(self.position).collect()

    def neighbours(self, value: str) -> DataFrame:
        return neighbours(self.df, [self.position], value)

    def for_each(self, visit: Callable[[Row], bool | None]) -> None:
        for row in self.df.orderBy(self.position).toLocalIterator():
            if visit(row) is False:
                return
