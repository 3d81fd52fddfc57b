"""Update deltas as one projection; rows that don't match keep their values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.predicate import QueryError, compile_on, compile_query, condition
from docmill.functions.values import Scope, Value, literal, with_path

DELTAS = ("$set", "$unset", "$inc", "$mul", "$rename", "$min", "$max", "$push", "$addToSet", "$pull", "$pullAll", "$pop", "$currentDate")


def _array(old: Value, x: Any) -> Column:
    """The old array, or an empty one where it is null or no field yet."""
    kind = old.type if isinstance(old.type, T.ArrayType) else T.ArrayType(old.scope.frame.select(literal(x).alias("x")).schema["x"].dataType)
    return F.coalesce(old.col.cast(kind), F.array().cast(kind))


def _new(old: Value, delta: str, x: Any) -> Column:
    c = old.col
    if delta == "$set":
        return literal(x)
    if delta == "$inc":
        return F.coalesce(c, F.lit(0)) + x
    if delta == "$mul":
        return F.coalesce(c, F.lit(0)) * x
    if delta in ("$min", "$max"):
        return (F.least if delta == "$min" else F.greatest)(c, F.lit(x))
    if delta in ("$push", "$addToSet"):
        many = x["$each"] if isinstance(x, dict) and "$each" in x else [x]
        have = _array(old, many[0] if many else None)
        more = F.array(*map(literal, many))
        return F.concat(have, more) if delta == "$push" else F.concat(have, F.array_except(more, have))
    if delta == "$pull":
        inner = old.type.elementType
        if isinstance(x, dict) and isinstance(inner, T.StructType):
            return F.filter(c, lambda e: ~F.coalesce(compile_on(old.scope.element(e, inner), x), F.lit(False)))
        return F.filter(c, lambda e: ~F.coalesce(condition(old.scope.element(e, inner), x), F.lit(False)))
    if delta == "$pullAll":
        return F.filter(c, lambda e: ~F.coalesce(e.isin(list(x)), F.lit(False)))
    if delta == "$pop":
        return F.when(F.size(c) > 0, F.slice(c, F.lit(1 if x > 0 else 2), F.size(c) - 1)).otherwise(c)
    return F.current_timestamp()


def update(frame: DataFrame, query: dict, delta: dict) -> DataFrame:
    """frame with the delta applied to the rows that match; order and other fields unchanged."""
    if not delta or any(k not in DELTAS for k in delta):
        raise QueryError(f"an update is an object of {', '.join(DELTAS)}; not {list(delta)}")
    scope, match = Scope(frame), compile_query(frame, query)
    match = F.coalesce(match, F.lit(False))
    changed: dict[str, Column] = {}

    def put(path: str, new: Column | None) -> None:
        top, *rest = path.split(".")
        old_type = scope.field(path).type
        if new is None:
            new = F.lit(None).cast(old_type)
        if top not in frame.columns:
            for part in reversed(rest):
                new = F.struct(new.alias(part))
            changed[top] = F.when(match, new)
            return
        base = changed.get(top, F.col(f"`{top}`"))
        if not rest:
            changed[top] = F.when(match, _fitting(new, frame.schema[top].dataType, frame)).otherwise(F.col(f"`{top}`"))
        else:
            kind = frame.select(base.alias("x")).schema["x"].dataType
            put_in = with_path(base, kind, rest, lambda old: F.when(match, new) if old is None else F.when(match, new).otherwise(old))
            changed[top] = F.when(match | base.isNotNull(), put_in)

    for name, fields in delta.items():
        for path, x in fields.items():
            if name == "$unset":
                put(path, None)
            elif name == "$rename":
                put(x, scope.field(path).col)
                put(path, None)
            else:
                put(path, _new(scope.field(path), name, x))
    return frame.withColumns(changed)


def _fitting(new: Column, kind: T.DataType, frame: DataFrame) -> Column:
    """new, as the field's type where both are numbers and nothing is lost, or the field is a variant."""
    got = frame.select(new.alias("x")).schema["x"].dataType
    if isinstance(kind, T.VariantType) and not isinstance(got, T.VariantType):
        return F.parse_json(F.to_json(F.struct(new.alias("v")))).cast("variant") if isinstance(got, T.StructType) else F.try_variant_get(F.parse_json(F.to_json(F.struct(new.alias("v")))), "$.v", "variant")
    if isinstance(got, T.NullType) or isinstance(kind, (T.DoubleType, T.LongType)) and isinstance(got, (T.IntegerType, T.LongType)):
        return new.cast(kind)
    return new
