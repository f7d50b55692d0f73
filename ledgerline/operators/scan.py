"""Ordered scans over versioned rows, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.compare import Op, tuple_predicate
from ..spec import DELETED
from .order import ranked
from .resolve import newest


def bound_of(value, n: int) -> tuple | None:
    """A bound as a tuple of key values; None is no bound."""
    if value is None:
        return None
    return tuple(value) if isinstance(value, (tuple, list)) else (value,)[:n]


@dataclass(frozen=True)
class Scan:
    """A query over the versions in ``log``: bounds, then resolution, then tombstones, then filters, then order and limit.

    Key bounds are put below resolution, where they reach the files (they keep or drop all versions of a key alike).
    Everything else stays above it. Methods return new scans; nothing runs before ``df`` does.
    """

    log: DataFrame
    keys: tuple[str, ...]
    recency: tuple[str, ...]
    deleted: str = DELETED
    op: Op = Op.GE
    low: tuple | None = None
    far: tuple | None = None
    filters: tuple[Column | Callable, ...] = ()
    most: int = 0
    tombstones: bool = False
    hidden: tuple[str, ...] = ()
    resolved: bool = False

    def find(self, op: Op | str, key=None) -> Scan:
        """Keys that are ``op`` the bound; LE and LT descend. Without a bound, all keys; EQ needs one."""
        return self.range(op, key, None)

    def range(self, op: Op | str, start=None, end=None) -> Scan:
        """Keys from ``start`` (included by GE and LE) to ``end`` (always included), in the operator's direction; none if they are reversed."""
        op, start, end = Op.of(op), bound_of(start, len(self.keys)), bound_of(end, len(self.keys))
        if op is Op.EQ:
            if start is None:
                raise ValueError("EQ needs a key")
            end = None
        return replace(self, op=op, low=start, far=end)

    def search(self, key) -> Row | None:
        """The live row of a key, or None."""
        found = self.find(Op.EQ, key).df().take(1)
        return found[0] if found else None

    def filter(self, condition: Column | Callable[[pd.DataFrame], pd.Series]) -> Scan:
        """Keeps rows for which ``condition`` is true; filters add up. A function gets pandas batches and returns booleans."""
        return replace(self, filters=(*self.filters, condition))

    def limit(self, n: int) -> Scan:
        """At most ``n`` rows, counted after all filters; 0 or less means all."""
        return replace(self, most=max(0, n))

    def with_tombstones(self) -> Scan:
        """Keeps tombstones as rows, as a merge needs them."""
        return replace(self, tombstones=True)

    def _bounded(self) -> DataFrame:
        df = self.log
        if self.low is not None:
            df = df.where(tuple_predicate(self.keys, self.op, self.low))
        if self.far is not None:
            df = df.where(tuple_predicate(self.keys, Op.GE if self.op.descending else Op.LE, self.far))
        return df

    def rows(self) -> DataFrame:
        """The scan's rows without order or limit."""
        df = self._bounded()
        if not self.resolved:
            df = newest(df, self.keys, self.recency)
        if not self.tombstones:
            df = df.where(~F.col(self.deleted)).drop(self.deleted)
        for condition in self.filters:
            df = df.where(condition) if isinstance(condition, Column) else _by_function(df, condition)
        return df.drop(*self.hidden)

    def df(self) -> DataFrame:
        """The scan's rows in order."""
        order = [F.col(k).desc() if self.op.descending else F.col(k).asc() for k in self.keys]
        df = self.rows().orderBy(*order)
        return df.limit(self.most) if self.most else df

    def ranked(self, rank: str = "rank") -> DataFrame:
        """The scan's rows with their number in its order; with a limit, a top-k first, whose rows alone are numbered."""
        if self.most:
            return ranked(self.df(), self.keys, self.op.descending, rank)
        return ranked(self.rows(), self.keys, self.op.descending, rank)

    def count(self) -> int:
        return (self.df() if self.most else self.rows()).count()

    def is_empty(self) -> bool:
        return self.rows().isEmpty()

    def items(self) -> list[Row]:
        """All rows in order, in the driver: for results known to be small."""
        return self.df().collect()

    def iterate(self) -> Iterator[Row]:
        """Rows in order, partition by partition: a snapshot cursor."""
        return self.df().toLocalIterator()

    def for_each(self, visit: Callable[[Row], bool | None]) -> None:
        """Visits rows in order until ``visit`` returns False."""
        for row in self.iterate():
            if visit(row) is False:
                return

    def show(self, n: int = 20) -> None:
        self.df().show(n, truncate=False)


def _by_function(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield batch[keep(batch).astype(bool)]

    return df.mapInPandas(run, df.schema)


def scan_log(log: DataFrame, keys: Sequence[str], recency: Sequence[str], deleted: str = DELETED, hidden: Sequence[str] = ()) -> Scan:
    """A scan over any log of versions: key columns, columns that order versions, the column that marks tombstones."""
    return Scan(log, tuple(keys), tuple(recency), deleted, hidden=tuple(hidden))
