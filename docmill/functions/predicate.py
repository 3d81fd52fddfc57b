"""Query objects as filter Columns.

Leaves are emitted in shapes that reach the Parquet scan (col >= x, col IN, NOT col <=> x) and are only wrapped where
they are negated. Comparing a field with a value of another type is false, never an error, and is decided here from
the schema. A condition on an array field holds if it holds for the array or for any element.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.values import Scope, Value, is_array, is_number, is_time, literal


class QueryError(ValueError):
    """A query object that can't be compiled."""


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)


def no(c: Column) -> Column:
    """The complement in two-valued logic."""
    return ~F.coalesce(c, F.lit(False))


def same_kind(t: T.DataType, x: Any) -> bool:
    if isinstance(x, bool):
        return isinstance(t, T.BooleanType)
    if isinstance(x, (int, float)):
        return is_number(t)
    if isinstance(x, str):
        return isinstance(t, T.StringType)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return is_time(t)
    if isinstance(x, (bytes, bytearray)):
        return isinstance(t, T.BinaryType)
    if isinstance(x, list):
        return is_array(t)
    return isinstance(x, dict) and isinstance(t, (T.StructType, T.MapType))


def _typed(t: T.DataType, x: Any) -> Column:
    return literal(x).cast(t) if isinstance(x, (dict, list)) else F.lit(x)


#: the names that schema_of_variant gives to values of a kind, and what they are read as
_VARIANT = {bool: (r"^BOOLEAN$", "boolean"), int: (r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "double"), float: (r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "double"), str: (r"^STRING$", "string"), datetime.datetime: (r"^TIMESTAMP.*$", "timestamp")}


def _variant_leaf(c: Column, x: Any, compare: Callable[[Column, Column], Column]) -> Column:
    if x is None:
        return c.isNull() | F.is_variant_null(c)
    if type(x) not in _VARIANT:
        return F.lit(False)
    names, kind = _VARIANT[type(x)]
    return F.when(F.schema_of_variant(c).rlike(names), compare(F.try_variant_get(c, "$", kind), F.lit(x))).otherwise(False)


def _leaf(v: Value, x: Any, compare: Callable[[Column, Column], Column]) -> Column:
    """compare(v, x) where v and x are of one kind; over the elements of an array as well."""
    t = v.type
    if isinstance(t, T.VariantType):
        return _variant_leaf(v.col, x, compare)
    if is_array(t) and not isinstance(x, list):
        inner = t.elementType
        if is_array(inner) or same_kind(inner, x):
            return F.exists(v.col, lambda e: F.coalesce(_leaf(v.scope.element(e, inner), x, compare), F.lit(False)))
        return F.lit(False)
    return compare(v.col, _typed(t, x)) if same_kind(t, x) else F.lit(False)


def _eq(v: Value, x: Any) -> Column:
    if isinstance(x, re.Pattern):
        return _regex(v, x)
    if x is None:
        t = v.type
        if isinstance(t, T.VariantType):
            return _variant_leaf(v.col, None, None)
        if is_array(t):
            return v.col.isNull() | F.exists(v.col, lambda e: e.isNull())
        return v.col.isNull()
    whole = _leaf(v, x, lambda a, b: a == b)
    if isinstance(x, list) and is_array(v.type) and is_array(v.type.elementType):
        return whole | F.array_contains(v.col, _typed(v.type.elementType, x))
    return whole


def _ne(v: Value, x: Any) -> Column:
    t = v.type
    if x is None and not is_array(t) and not isinstance(t, T.VariantType):
        return v.col.isNotNull()
    if not is_array(t) and same_kind(t, x) and not isinstance(x, re.Pattern):
        return ~v.col.eqNullSafe(_typed(t, x))
    return no(_eq(v, x))


def _in(v: Value, xs: list) -> Column:
    t = v.type
    plain = [x for x in xs if x is not None and not isinstance(x, re.Pattern)]
    parts = [_eq(v, x) for x in xs if x is None or isinstance(x, re.Pattern)]
    if plain and not is_array(t) and not isinstance(t, (T.VariantType, T.StructType)):
        fitting = [x for x in plain if same_kind(t, x)]
        parts.insert(0, v.col.isin(fitting) if fitting else F.lit(False))
    else:
        parts += [_eq(v, x) for x in plain]
    return _any(parts)


def _nin(v: Value, xs: list) -> Column:
    t = v.type
    if not is_array(t) and xs and all(same_kind(t, x) for x in xs):
        return v.col.isNull() | ~v.col.isin(list(xs))
    return no(_in(v, xs))


def java_regex(pattern: Any, options: str = "") -> str:
    """A pattern with its flags inline; i, m, s and x are known."""
    if isinstance(pattern, re.Pattern):
        options += "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if pattern.flags & bit)
        pattern = pattern.pattern
    if bad := set(options) - set("imsxu"):
        raise QueryError(f"unknown regex options: {sorted(bad)}")
    flags = "".join(f for f in "imsx" if f in options)
    return f"(?{flags}){pattern}" if flags else pattern


def _regex(v: Value, pattern: Any, options: str = "") -> Column:
    t, java = v.type, java_regex(pattern, options)
    if is_array(t) and isinstance(t.elementType, T.StringType):
        return F.exists(v.col, lambda e: F.coalesce(e.rlike(java), F.lit(False)))
    if isinstance(t, T.VariantType):
        return F.when(F.schema_of_variant(v.col) == "STRING", F.try_variant_get(v.col, "$", "string").rlike(java)).otherwise(False)
    return v.col.rlike(java) if isinstance(t, T.StringType) else F.lit(False)


def _mod(v: Value, args: list) -> Column:
    if len(args) != 2 or args[0] == 0:
        raise QueryError("$mod takes a divisor other than 0 and a remainder")
    return _leaf(v, 0, lambda a, _: (a % args[0]) == args[1])


def _all_of(v: Value, xs: list) -> Column:
    if not xs:
        return F.lit(False)
    return _all([_elem_match(v, x["$elemMatch"]) if isinstance(x, dict) and "$elemMatch" in x else _eq(v, x) for x in xs])


def _elem_match(v: Value, q: dict) -> Column:
    t = v.type
    if not is_array(t):
        return F.lit(False)
    inner = t.elementType

    def each(e: Column) -> Column:
        elem = v.scope.element(e, inner)
        if all(k.startswith("$") and k not in ("$and", "$or", "$nor", "$expr") for k in q):
            return F.coalesce(conditions(elem, q), F.lit(False))
        return F.coalesce(compile_on(elem, q), F.lit(False))

    return F.exists(v.col, each)


def _exists(v: Value, wanted: Any) -> Column:
    return v.col.isNotNull() if wanted else v.col.isNull()


_TYPES = {"double": T.DoubleType, 1: T.DoubleType, "string": T.StringType, 2: T.StringType, "object": T.StructType, 3: T.StructType, "array": T.ArrayType, 4: T.ArrayType, "bindata": T.BinaryType, 5: T.BinaryType, "bool": T.BooleanType, "boolean": T.BooleanType, 8: T.BooleanType, "date": (T.TimestampType, T.TimestampNTZType, T.DateType), 9: (T.TimestampType, T.TimestampNTZType, T.DateType), "int": (T.IntegerType, T.ShortType, T.ByteType), 16: (T.IntegerType, T.ShortType, T.ByteType), "long": T.LongType, 18: T.LongType, "decimal": T.DecimalType, 19: T.DecimalType, "number": T.NumericType}
_VARIANT_NAMES = {"string": "^STRING", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "double": "^DOUBLE", "long": "^BIGINT", "int": "^BIGINT", "bool": "^BOOLEAN", "boolean": "^BOOLEAN", "object": "^OBJECT", "array": "^ARRAY", "date": "^TIMESTAMP"}


def _type(v: Value, names: Any) -> Column:
    t = v.type
    parts = []
    for name in names if isinstance(names, list) else [names]:
        if name in ("null", 10):
            parts.append(v.col.isNull())
        elif isinstance(t, T.VariantType) and name in _VARIANT_NAMES:
            parts.append(F.schema_of_variant(v.col).rlike(_VARIANT_NAMES[name]))
        elif name not in _TYPES:
            raise QueryError(f"unknown type: {name}")
        else:
            parts.append(v.col.isNotNull() if isinstance(t, _TYPES[name]) else F.lit(False))
    return _any(parts)


def _bits(test: Callable[[Column, int], Column]) -> Callable[[Value, Any], Column]:
    def op(v: Value, mask: Any) -> Column:
        mask = sum(1 << b for b in mask) if isinstance(mask, list) else mask
        return _leaf(v, 0, lambda a, _: test(a.cast("bigint").bitwiseAND(F.lit(mask).cast("bigint")), mask)) if is_number(v.type) else F.lit(False)

    return op


def _where(v: Value, f: Any) -> Column:
    raise QueryError("$where stands at the top of a query")


def _item_schema(v: Value, schema: dict) -> Callable[[Column], Column]:
    inner = v.type.elementType
    return lambda e: F.coalesce(_json_schema(v.scope.element(e, inner), schema), F.lit(False))


def _json_schema(v: Value, schema: dict) -> Column:
    """type, required, enum, minimum, maximum, minLength, maxLength, pattern, properties, items."""
    types = {"number": "number", "integer": ["int", "long"], "string": "string", "boolean": "bool", "object": "object", "array": "array", "null": "null"}
    parts = []
    absent = v.col.isNull()
    for key, x in schema.items():
        if key in ("type", "bsonType"):
            names = x if isinstance(x, list) else [x]
            parts.append(absent | _any([_type(v, types.get(n, n)) for n in names]))
        elif key == "required":
            from docmill.functions.values import walk

            parts += [walk(v, [name]).col.isNotNull() for name in x]
        elif key == "enum":
            parts.append(absent | _in(v, x))
        elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            op = {"minimum": "$gte", "maximum": "$lte", "exclusiveMinimum": "$gt", "exclusiveMaximum": "$lt"}[key]
            parts.append(absent | LEAVES[op](v, x))
        elif key in ("minLength", "maxLength"):
            n = F.char_length(v.col.cast("string"))
            parts.append(absent | (n >= x if key == "minLength" else n <= x))
        elif key == "pattern":
            parts.append(absent | _regex(v, x))
        elif key == "properties":
            from docmill.functions.values import walk

            parts += [_json_schema(walk(v, [name]), sub) for name, sub in x.items()]
        elif key == "items" and is_array(v.type):
            parts.append(absent | F.forall(v.col, _item_schema(v, x)))
        elif key not in ("title", "description"):
            raise QueryError(f"$jsonSchema: unknown keyword {key}")
    return _all(parts)


LEAVES: dict[str, Callable[[Value, Any], Column]] = {
    "$eq": _eq, "$ne": _ne, "$in": _in, "$nin": _nin, "$mod": _mod, "$all": _all_of, "$elemMatch": _elem_match, "$exists": _exists, "$type": _type, "$where": _where,
    "$gt": lambda v, x: F.lit(False) if x is None else _leaf(v, x, lambda a, b: a > b),
    "$gte": lambda v, x: v.col.isNull() if x is None else _leaf(v, x, lambda a, b: a >= b),
    "$lt": lambda v, x: F.lit(False) if x is None else _leaf(v, x, lambda a, b: a < b),
    "$lte": lambda v, x: v.col.isNull() if x is None else _leaf(v, x, lambda a, b: a <= b),
    "$size": lambda v, n: F.size(v.col) == n if is_array(v.type) else F.lit(False),
    "$bitsAllSet": _bits(lambda a, m: a == m), "$bitsAllClear": _bits(lambda a, m: a == 0),
    "$bitsAnySet": _bits(lambda a, m: a != 0), "$bitsAnyClear": _bits(lambda a, m: a != m),
}


def conditions(v: Value, q: dict) -> Column:
    """A field's conditions, {"$gte": 1, "$lt": 5} for one."""
    parts = []
    for op, x in q.items():
        if op == "$not":
            parts.append(no(condition(v, x)))
        elif op == "$regex":
            parts.append(_regex(v, x, q.get("$options", "")))
        elif op == "$options":
            continue
        elif op in LEAVES:
            parts.append(LEAVES[op](v, x))
        elif op in ("$and", "$or", "$nor"):
            each = [condition(v, x_) for x_ in x]
            parts.append(_all(each) if op == "$and" else _any(each) if op == "$or" else no(_any(each)))
        else:
            raise QueryError(f"unknown operator: {op}")
    return _all(parts)


def condition(v: Value, x: Any) -> Column:
    if isinstance(x, dict) and x and all(str(k).startswith("$") for k in x):
        return conditions(v, x)
    return _eq(v, x)


def compile_on(root: Value | Scope, q: dict) -> Column:
    """A query over the fields of a frame, or of a struct inside one."""
    from docmill.functions.values import walk

    scope = root if isinstance(root, Scope) else root.scope
    if not isinstance(q, dict):
        raise QueryError(f"a query is an object, not {q!r}")
    parts = []
    for key, x in q.items():
        if key == "$and":
            parts.append(_all([F.coalesce(compile_on(root, s), F.lit(False)) if len(x) > 1 and isinstance(root, Value) else compile_on(root, s) for s in x]))
        elif key == "$or":
            parts.append(_any([compile_on(root, s) for s in x]))
        elif key == "$nor":
            parts.append(no(_any([compile_on(root, s) for s in x])))
        elif key == "$not":
            parts.append(no(compile_on(root, x)))
        elif key == "$expr":
            from docmill.functions.expr import compile_expr
            from docmill.functions.values import truthy

            parts.append(truthy(compile_expr(scope, x)).col)
        elif key == "$where":
            parts.append(F.coalesce(x(F.col) if callable(x) else F.expr(x), F.lit(False)))
        elif key == "$jsonSchema":
            whole = F.struct(*[F.col(f"`{c}`") for c in scope.frame.columns])
            parts.append(_json_schema(Value(scope, whole, whole), x))
        elif key == "$comment":
            continue
        elif key.startswith("$"):
            raise QueryError(f"unknown operator: {key}")
        else:
            parts.append(condition(scope.field(key) if isinstance(root, Scope) else walk(root, key.split(".")), x))
    return _all(parts)


def compile_query(frame: DataFrame, q: dict) -> Column:
    return compile_on(Scope(frame), q)
