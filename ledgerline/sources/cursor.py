"""Cursors over a table that pages can outlive: live ones see later writes ahead of them."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.compare import Op
from ..operators.scan import Scan
from .table import LedgerTable


class LiveCursor:
    """A forward cursor that reads pages, each from the table's newest version, strictly beyond the last key returned.

    Rows written ahead of the cursor after it was opened are seen, rows behind it are not. With pages of one row this
    holds for every single row; larger pages see writes from the next page on. A page of 0 rows is all that is ahead.

    ``next_page`` and iteration bring a page's rows to the driver, and no others. ``next_df`` and ``pages`` leave them
    where they lie: of a page, the driver gets the number of rows and the last key, however long it is.
    """

    def __init__(self, table: LedgerTable, op: Op | str = Op.GE, start=None, end=None, filters: tuple[Column, ...] = (), limit: int = 0, page: int = 1000):
        self.table, self.op, self.end, self.filters, self.left, self.page = table, Op.of(op), end, filters, limit if limit > 0 else None, page
        self._next = (self.op, start)
        self._done = False

    def _ahead(self, end=None) -> Scan:
        """What lies beyond the last key, as the table's handle has it; up to ``end`` where that is nearer than the cursor's."""
        scan = self.table.find_range(*self._next, self.end if end is None else end)
        for f in self.filters:
            scan = scan.filter(f)
        return scan

    def _most(self) -> int:
        """The rows of the next page at most; 0 for all."""
        return min((n for n in (self.page, self.left or 0) if n > 0), default=0)

    def _move(self, n: int, last: tuple) -> None:
        self._next = ({Op.GE: Op.GT, Op.LE: Op.LT}.get(self.op, self.op), last)
        if self.left is not None:
            self.left -= n

    def page_df(self) -> DataFrame:
        """The next page as a DataFrame, without moving."""
        self.table.refresh()
        return self._ahead().limit(self._most()).df()

    def next_page(self) -> list[Row]:
        """The next page's rows; an empty list is the end, for now: rows may still be written ahead."""
        if self.left == 0:
            return []
        page = self.page_df()
        # merged in a task: the driver would get a page's rows from each task
        rows = (page.coalesce(1) if self._most() else page).collect()
        if rows:
            self._move(len(rows), tuple(rows[-1][k] for k in self.table.spec.keys))
        if self.op is Op.EQ:
            self.left = 0
        return rows

    def next_df(self) -> DataFrame | None:
        """The next page's rows in order, as a DataFrame of the version that they were found in; None is the end, for now."""
        if self.left == 0:
            return None
        self.table.refresh()
        most, key = self._most(), F.struct(*self.table.spec.keys)
        rows = self._ahead().limit(most).df() if most else self._ahead().rows()
        n, last = rows.agg(F.count("*"), F.min(key) if self.op.descending else F.max(key)).first()
        page = None
        if n:
            # a page is the range up to its last key: its reader needs no top-k
            page = self._ahead(None if self.op is Op.EQ else tuple(last)).df()
            self._move(n, tuple(last))
        if self.op is Op.EQ:
            self.left = 0
        return page

    def pages(self) -> Iterator[DataFrame]:
        """Pages as DataFrames, until nothing is ahead."""
        while (page := self.next_df()) is not None:
            yield page

    def __iter__(self) -> Iterator[Row]:
        while rows := self.next_page():
            yield from rows


def keyset_page(df: DataFrame, keys: list[str], last: tuple | None, n: int) -> DataFrame:
    """The ``n`` rows after ``last`` in key order: paging without offsets, which would read all earlier pages again."""
    from ..functions.compare import tuple_predicate

    rows = df if last is None else df.where(tuple_predicate(keys, Op.GT, last))
    return rows.orderBy(*(F.col(k) for k in keys)).limit(n)
