"""Column types of the SQL dialect: names, comparability and checked conversion of literals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import DataTypeNotConvertible, TooLarge, TypeNotConvertible, ValueOverflow

INTS = {"SMALLINT": 16, "INT": 32, "BIGINT": 64}


@dataclass(frozen=True)
class SqlType:
    """SMALLINT, INT, BIGINT, VARCHAR(n), BINARY(n), or another Spark type that passes through."""

    name: str
    length: int | None = None

    @property
    def family(self) -> str:
        return "int" if self.name in INTS else "string" if self.name == "VARCHAR" else "binary" if self.name == "BINARY" else "number" if self.name in ("DOUBLE", "FLOAT", "DECIMAL") else self.name

    def spark(self) -> T.DataType:
        return {"SMALLINT": T.ShortType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "VARCHAR": T.StringType(), "BINARY": T.BinaryType(), "DOUBLE": T.DoubleType()}[self.name]

    def __str__(self) -> str:
        return self.name if self.length is None else f"{self.name}({self.length})"


def from_spark(t: T.DataType, declared: str | None = None) -> SqlType:
    if declared and declared.startswith("VARCHAR("):
        return SqlType("VARCHAR", int(declared[8:-1]))
    known = {T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.StringType: "VARCHAR", T.BinaryType: "BINARY", T.DoubleType: "DOUBLE", T.FloatType: "FLOAT"}
    return SqlType(known.get(type(t), type(t).__name__.removesuffix("Type").upper()))


def comparable(a: SqlType, b: SqlType) -> bool:
    """Integers of any width compare; strings and binaries among themselves; integer literals with floating columns, too."""
    return a.family == b.family or {a.family, b.family} == {"int", "number"}


def convert(value: int | str | bytes | None, to: SqlType):
    """A literal as a value of ``to``; VARCHAR and BINARY lengths count bytes, as declared."""
    if value is None:
        return None
    if to.name in INTS and isinstance(value, int):
        if not -(1 << INTS[to.name] - 1) <= value < 1 << INTS[to.name] - 1:
            raise ValueOverflow(value, to)
        return value
    if to.name == "VARCHAR" and isinstance(value, str):
        if to.length is not None and len(value.encode()) > to.length:
            raise TooLarge(value, to)
        return value
    if to.name == "BINARY" and isinstance(value, bytes):
        if to.length is not None and len(value) > to.length:
            raise TooLarge(value, to)
        return value
    if to.name == "DOUBLE" and isinstance(value, int):
        return float(value)
    raise TypeNotConvertible(value, to)


__all__ = ["DataTypeNotConvertible", "INTS", "SqlType", "comparable", "convert", "from_spark"]
