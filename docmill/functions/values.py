"""Compiled values: a Column with the type it has, also inside lambdas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "_seq"  # the hidden column that keeps a collection's order


@dataclass
class Value:
    """col, and stand_in: the same with lambda variables replaced by typed nulls, so that Spark can tell its type."""

    scope: Scope
    col: Column
    stand_in: Column
    const: Any = None
    is_const: bool = False

    @property
    def type(self) -> T.DataType:
        return self.scope.frame.select(self.stand_in.alias("x")).schema["x"].dataType

    def map(self, f: Callable[..., Column], *others: Value) -> Value:
        return Value(self.scope, f(self.col, *(o.col for o in others)), f(self.stand_in, *(o.stand_in for o in others)))


@dataclass
class Scope:
    """What an expression sees: the fields of a frame, and variables."""

    frame: DataFrame
    variables: dict[str, Value] = field(default_factory=dict)

    def bind(self, **more: Value) -> Scope:
        return Scope(self.frame, self.variables | more)

    def const(self, x: Any) -> Value:
        c = literal(x)
        return Value(self, c, c, x, True)

    def element(self, x: Column, kind: T.DataType) -> Value:
        return Value(self, x, F.lit(None).cast(kind))

    def field(self, path: str) -> Value:
        parts = path.split(".")
        names = {f.name for f in self.frame.schema}
        if parts[0] not in names:
            return self.const(None)
        top = F.col(f"`{parts[0]}`")
        return walk(Value(self, top, top), parts[1:])


def literal(x: Any) -> Column:
    if isinstance(x, (list, tuple)):
        return F.array(*map(literal, x))
    if isinstance(x, dict):
        return F.struct(*[literal(v).alias(k) for k, v in x.items()]) if x else F.create_map()
    if isinstance(x, int) and not isinstance(x, bool) and -(1 << 31) <= x < 1 << 31:
        return F.lit(x)
    return F.lit(x)


def walk(v: Value, parts: list[str]) -> Value:
    """The value at a path below v; NULL where the type has no such field. Arrays of structs give arrays."""
    for i, part in enumerate(parts):
        kind = v.type
        if isinstance(kind, T.StructType) and part in kind.names:
            v = v.map(lambda c, p=part: c.getField(p))
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            v = v.map(lambda c, p=int(part): F.get(c, p))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and part in kind.elementType.names:
            rest = parts[i:]
            return v.map(lambda c, rest=rest: F.transform(c, lambda x: _deep(x, rest)))
        elif isinstance(kind, T.MapType):
            v = v.map(lambda c, p=part: c[p])
        elif isinstance(kind, T.VariantType):
            rest = ".".join(parts[i:])
            return v.map(lambda c: F.try_variant_get(c, f"$.{rest}", "variant"))
        else:
            return v.scope.const(None)
    return v


def _deep(x: Column, parts: list[str]) -> Column:
    for part in parts:
        x = x.getField(part)
    return x


def with_path(c: Column | None, kind: T.DataType, parts: list[str], new: Callable[[Column | None], Column]) -> Column:
    """c with new(old value) at a path below it. Objects that are missing on the way are made; in an array a number names
    one element, any other name that field of all elements."""
    if not parts:
        return new(c)
    name, rest = parts[0], parts[1:]
    if isinstance(kind, T.ArrayType) and c is not None:
        inner = kind.elementType
        if name.isdigit():
            return F.transform(c, lambda e, i: F.when(i == int(name), with_path(e, inner, rest, new)).otherwise(e))
        return F.transform(c, lambda e: with_path(e, inner, parts, new))
    names = kind.names if isinstance(kind, T.StructType) and c is not None else []
    fields = [(with_path(c.getField(n), kind[n].dataType, rest, new) if n == name else c.getField(n)).alias(n) for n in names]
    if name not in names:
        fields.append(with_path(None, T.NullType(), rest, new).alias(name))
    return F.struct(*fields)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_array(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


#: the order of types when values of different ones are compared
RANKS = ((T.NullType, 0), (T.NumericType, 1), (T.StringType, 2), (T.StructType, 3), (T.MapType, 3), (T.ArrayType, 4), (T.BinaryType, 5), (T.BooleanType, 6), (T.TimestampType, 7), (T.TimestampNTZType, 7), (T.DateType, 7))


def rank(t: T.DataType) -> int:
    return next((r for kind, r in RANKS if isinstance(t, kind)), 8)


def truthy(v: Value) -> Value:
    """NULL, false and 0 are false, everything else is true."""
    t = v.type
    if isinstance(t, T.BooleanType):
        return v.map(lambda c: F.coalesce(c, F.lit(False)))
    if is_number(t):
        return v.map(lambda c: F.coalesce(c != 0, F.lit(False)))
    return v.map(lambda c: c.isNotNull())
