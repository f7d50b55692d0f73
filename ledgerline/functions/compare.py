"""Comparison operators and three-way comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from enum import IntEnum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Op(IntEnum):
    """How a scan's keys relate to its bound. EQ finds one key; GE and GT ascend from it; LE and LT descend from it."""

    EQ, GE, GT, LE, LT = range(5)

    @classmethod
    def of(cls, op: Op | str | int) -> Op:
        try:
            return cls[op.upper()] if isinstance(op, str) else cls(op)
        except (KeyError, ValueError):
            raise ValueError(f"unknown operator {op!r}") from None

    @property
    def descending(self) -> bool:
        return self in (Op.LE, Op.LT)

    @property
    def strict(self) -> bool:
        return self in (Op.GT, Op.LT)


def tuple_predicate(keys: Sequence[str], op: Op, bound: Sequence) -> Column:
    """``keys`` op ``bound``, compared column by column; single columns stay plain comparisons, which Parquet can use."""
    if len(keys) != len(bound):
        raise ValueError(f"the bound has {len(bound)} values for {len(keys)} key columns")
    pairs = [(F.col(k), F.lit(b)) for k, b in zip(keys, bound, strict=True)]
    if op is Op.EQ:
        return reduce(lambda x, y: x & y, (k == b for k, b in pairs))
    less = op.descending
    out = None
    for k, b in reversed(pairs):
        beyond = k < b if less else k > b
        last = beyond if op.strict else (k <= b if less else k >= b)
        out = last if out is None else beyond | ((k == b) & out)
    first_key, first_bound = pairs[0]
    return out if len(pairs) == 1 else out & (first_key <= first_bound if less else first_key >= first_bound)


def compare_ints(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as ``a`` is less than, equal to or greater than ``b``; no difference is taken, so nothing overflows."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(0)).cast("int")


def compare_strings(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by unsigned bytes, a prefix before what it begins."""
    return compare_ints(a, b)


def entry_size(*columns: str, overhead: int = 0) -> Column:
    """Bytes of an entry: its UTF-8 or binary columns and ``overhead``."""
    return reduce(lambda x, y: x + y, (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(overhead)).cast("long")


def entry_text(*columns: str) -> Column:
    """An entry as JSON."""
    return F.to_json(F.struct(*columns))
