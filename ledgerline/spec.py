"""What a keyed, versioned table is: its columns, its key, and which column says what."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETED, SEQ, LEVEL = "_deleted", "_seq", "_level"
FORMAT_VERSION = 2


@dataclass(frozen=True)
class TableSpec:
    """A table's name, its columns, and the columns of its key in order of comparison.

    Rows are ordered by the key columns, nulls not being allowed there; strings compare by bytes. For another order,
    make a sort-key column that has it and put that first in ``keys``.
    """

    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    bloom: bool = True
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = self.schema.fieldNames()
        if not self.keys:
            raise ValueError("a table needs a key column")
        if missing := [k for k in self.keys if k not in names]:
            raise ValueError(f"key columns {missing} are not in the schema")
        if clash := {DELETED, SEQ, LEVEL} & set(names):
            raise ValueError(f"{sorted(clash)} are reserved names")

    @property
    def values(self) -> list[str]:
        return [c for c in self.schema.fieldNames() if c not in self.keys]

    @property
    def log_schema(self) -> T.StructType:
        """The columns of a stored run: the table's own, the tombstone flag and the sequence number."""
        return T.StructType([*self.schema.fields, T.StructField(DELETED, T.BooleanType(), False), T.StructField(SEQ, T.LongType(), False)])

    def checked(self, df: DataFrame, *more: str) -> DataFrame:
        """The table's columns of ``df``, cast to its types, and ``more``; a null in a key column is an error when the row is read."""
        out = []
        for f in self.schema.fields:
            c = F.col(f.name).cast(f.dataType)
            if f.name in self.keys:
                c = F.when(F.col(f.name).isNull(), F.raise_error(F.lit(f"null in key column {f.name}")).cast(f.dataType)).otherwise(c)
            out.append(c.alias(f.name))
        return df.select(*out, *more)

    def comparable(self, key: Column) -> list[Column]:
        """The values of a key (a struct) as JSON can hold them, in an order that the driver can compare like Spark does."""
        out = []
        for name in self.keys:
            kind, c = self.schema[name].dataType, key[name]
            if isinstance(kind, T.TimestampType):
                c = F.unix_micros(c)
            elif isinstance(kind, T.BinaryType):
                c = F.hex(c)
            elif isinstance(kind, (T.FloatType, T.DoubleType)):
                c = F.when(F.isnan(c), F.lit(float("inf"))).otherwise(c).cast("double")
            elif isinstance(kind, T.BooleanType):
                c = c.cast("int")
            elif not isinstance(kind, (T.StringType, T.IntegralType)):
                c = c.cast("string")
            out.append(c.alias(name))
        return out

    def ordered(self, values: tuple) -> tuple:
        """``comparable`` values as they compare."""
        return tuple(Decimal(v) if isinstance(self.schema[k].dataType, T.DecimalType) else v for k, v in zip(self.keys, values, strict=True))

    def placed(self, key: tuple) -> tuple | None:
        """A Python key among ``comparable`` values; None where that takes Spark to say."""
        for k, v in zip(self.keys, key, strict=False):
            kind = self.schema[k].dataType
            if not (isinstance(kind, T.StringType) and isinstance(v, str) or isinstance(kind, T.IntegralType) and type(v) is int):
                return None
        return tuple(key) if len(key) == len(self.keys) else None

    def to_json(self) -> dict:
        return {"name": self.name, "schema": json.loads(self.schema.json()), "keys": list(self.keys), "bloom": self.bloom, "options": self.options}

    @classmethod
    def from_json(cls, d: dict) -> TableSpec:
        return cls(d["name"], T.StructType.fromJson(d["schema"]), tuple(d["keys"]), d.get("bloom", True), d.get("options", {}))
