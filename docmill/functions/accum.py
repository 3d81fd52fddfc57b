"""Accumulators as aggregate Columns; those that depend on arrival order carry the order key."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.expr import compile_expr
from docmill.functions.predicate import QueryError
from docmill.functions.values import Scope, Value, is_number


def _number(v: Value) -> Column:
    """The value where it is a number, NULL else."""
    t = v.type
    return v.col if is_number(t) else F.lit(None).cast("double")


def _ordered(order: Column, c: Column) -> Column:
    """All values of a group in order, nulls kept."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), c.alias("v")))), lambda x: x["v"])


def _merge(v: Value, order: Column) -> Column:
    t = v.type
    if not isinstance(t, T.StructType):
        raise QueryError("$mergeObjects takes objects")
    of = lambda n: F.max_by(v.col.getField(n), F.when(v.col.getField(n).isNotNull(), order))
    return F.struct(*[of(f.name).alias(f.name) for f in t.fields])


def _in_order(scope: Scope, by: dict, order: Column, out: Column) -> Column:
    """out of all documents of a group by the keys, ties by arrival; null is lowest."""
    keys = [scope.field(path).col.alias(f"k{i}") for i, path in enumerate(by)]
    signs = list(by.values())

    def compare(x: Column, y: Column) -> Column:
        result = F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)
        for i, sign in reversed(list(enumerate(signs))):
            a, b = x[f"k{i}"], y[f"k{i}"]
            below, above = F.coalesce(a < b, a.isNull() & b.isNotNull()), F.coalesce(a > b, a.isNotNull() & b.isNull())
            result = F.when(below, -1 if sign > 0 else 1).when(above, 1 if sign > 0 else -1).otherwise(result)
        return result

    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, order.alias("o"), out.alias("v"))), compare), lambda e: e["v"])


#: Accumulators that keep n documents of a group.
RANKED = ("$firstN", "$lastN", "$minN", "$maxN", "$top", "$topN", "$bottom", "$bottomN")


def ranking(scope: Scope, name: str, arg: dict, order: Column) -> tuple[Column, list[tuple[Column, bool]], int, bool]:
    """Of one of RANKED: the value, the keys by which documents are taken (True: ascending, null lowest), how many, and
    whether they come back in reverse."""
    n, back = int(arg["n"]) if name.endswith("N") else 1, name in ("$lastN", "$bottom", "$bottomN")
    value = compile_expr(scope, arg["output" if "sortBy" in arg else "input"]).col
    if name in ("$minN", "$maxN"):
        return value, [(value, name == "$minN")], n, back
    keys = [*[(scope.field(path).col, sign > 0) for path, sign in arg.get("sortBy", {}).items()], (order, True)]
    return value, [(c, up != back) for c, up in keys], n, back


def accumulator(scope: Scope, name: str, arg: Any, order: Column) -> Column:
    value = lambda: compile_expr(scope, arg)
    if name == "$sum":
        v = value()
        return F.coalesce(F.sum(_number(v)), F.lit(0))
    if name == "$avg":
        return F.avg(_number(value()))
    if name in ("$min", "$max"):
        return (F.min if name == "$min" else F.max)(value().col)
    if name == "$count":
        return F.count(F.lit(1))
    if name in ("$first", "$last"):
        return (F.min_by if name == "$first" else F.max_by)(value().col, order)
    if name == "$push":
        return _ordered(order, value().col)
    if name == "$addToSet":
        return F.transform(F.array_sort(F.collect_set(F.struct(value().col.alias("v")))), lambda x: x["v"])
    if name in ("$stdDevPop", "$stdDevSamp"):
        return (F.stddev_pop if name == "$stdDevPop" else F.stddev_samp)(_number(value()))
    if name in ("$covariancePop", "$covarianceSamp"):
        x, y = [compile_expr(scope, a) for a in arg]
        return (F.covar_pop if name == "$covariancePop" else F.covar_samp)(x.col.cast("double"), y.col.cast("double"))
    if name == "$mergeObjects":
        return _merge(value(), order)
    if name in ("$firstN", "$lastN", "$minN", "$maxN"):
        c, n = compile_expr(scope, arg["input"]).col, int(arg["n"])
        if name == "$firstN":
            return F.slice(_ordered(order, c), 1, n)
        if name == "$lastN":
            return F.reverse(F.slice(F.reverse(_ordered(order, c)), 1, n))
        return F.slice(F.sort_array(F.collect_list(c), name == "$minN"), 1, n)
    if name in ("$top", "$bottom", "$topN", "$bottomN"):
        sorted_ = _in_order(scope, arg["sortBy"], order, compile_expr(scope, arg["output"]).col)
        if name in ("$top", "$bottom"):
            return F.get(sorted_, 0) if name == "$top" else F.element_at(sorted_, -1)
        return F.slice(sorted_, 1, int(arg["n"])) if name == "$topN" else F.reverse(F.slice(F.reverse(sorted_), 1, int(arg["n"])))
    if name == "$accumulator":
        f: Callable[..., Column] = arg["body"]
        return f(*[compile_expr(scope, a).col for a in arg.get("args", [])])
    raise QueryError(f"unknown accumulator: {name}")


