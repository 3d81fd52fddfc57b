"""Aggregation pipelines: each stage turns a DataFrame into a DataFrame.

The order of documents is a hidden column (_seq) between stages; stages that make new documents number them anew only
where order can be seen, by a sort key rather than by a global row number.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.accum import RANKED, accumulator, ranking
from docmill.functions.expr import compile_expr
from docmill.functions.predicate import QueryError, compile_on, compile_query, condition
from docmill.functions.values import SEQ, Scope, Value, walk, with_path

STAGES: dict[str, Callable[..., DataFrame]] = {}
SECONDS = {None: 1, "millisecond": 0.001, "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def stage(*names: str):
    def put(f):
        STAGES.update(dict.fromkeys(names, f))
        return f

    return put


def order_of(df: DataFrame) -> Column:
    return F.col(SEQ) if SEQ in df.columns else F.monotonically_increasing_id()


def visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != SEQ]


def run(df: DataFrame, pipeline: list[dict], others: dict[str, DataFrame] | None = None) -> DataFrame:
    """others: collections that $lookup and $unionWith may name."""
    for s in pipeline:
        if len(s) != 1:
            raise QueryError(f"a stage has one operator: {s!r}")
        name, arg = next(iter(s.items()))
        if name not in STAGES:
            raise QueryError(f"unknown stage: {name}")
        df = STAGES[name](df, arg, others or {})
    return df


@stage("$match")
def _match(df, q, _):
    return df.filter(compile_query(df, q)) if q else df


def _nested(specs: dict) -> dict[str, Any]:
    """{"a.b": 1} as {"a": {"b": 1}}."""
    out: dict[str, Any] = {}
    for path, x in specs.items():
        at, (*heads, last) = out, path.split(".")
        for h in heads:
            at = at.setdefault(h, {})
        at[last] = x
    return out


def _matching(v: Value, q: dict) -> Callable[[Column], Column]:
    inner = v.type.elementType
    test = condition if q and all(k.startswith("$") for k in q) and not isinstance(inner, T.StructType) else compile_on
    return lambda e: F.coalesce(test(v.scope.element(e, inner), q), F.lit(False))


def _is_flag(x: Any) -> bool:
    return isinstance(x, (bool, int, float)) and not isinstance(x, str)


def _included(scope: Scope, v: Value, spec: dict) -> Column:
    """The fields of a struct (or of the structs in an array) that spec names."""
    t = v.type
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        return F.transform(v.col, lambda e: _included(scope, scope.element(e, t.elementType), spec))
    names = t.names if isinstance(t, T.StructType) else []
    parts = []
    for k, x in spec.items():
        if _is_flag(x) and x:
            if k in names:
                parts.append(v.col.getField(k).alias(k))
        elif isinstance(x, dict) and not any(n.startswith("$") for n in x):
            parts.append(_included(scope, walk(v, [k]), x).alias(k))
        else:
            parts.append(compile_expr(scope, x).col.alias(k))
    return F.struct(*parts)


@stage("$project")
def _project(df, spec, _):
    scope = Scope(df)
    keep_id = spec.get("_id", 1)
    rest = {k: x for k, x in spec.items() if k != "_id" or not _is_flag(x)}
    hidden = [SEQ] if SEQ in df.columns else []
    if rest and all(_is_flag(x) and not x for x in rest.values()) or not rest and not keep_id:
        return _unset(df, [*rest, *([] if keep_id else ["_id"])], _)
    out = ["_id"] if keep_id and "_id" in df.columns and "_id" not in rest else []
    cols: list[Column] = [F.col("_id")] if out else []
    for k, x in _nested(rest).items():
        if _is_flag(x):
            if x and k in df.columns:
                cols.append(F.col(f"`{k}`"))
        elif isinstance(x, dict) and "$elemMatch" in x:
            cols.append(F.get(F.filter(scope.field(k).col, _matching(scope.field(k), x["$elemMatch"])), 0).alias(k))
        elif isinstance(x, dict) and "$slice" in x and not (isinstance(x["$slice"], list) and isinstance(x["$slice"][0], (str, dict, list))):
            args = x["$slice"] if isinstance(x["$slice"], list) else [x["$slice"]]
            cols.append(compile_expr(scope, {"$slice": [f"${k}", *args]}).col.alias(k))
        elif isinstance(x, dict) and not any(n.startswith("$") for n in x):
            cols.append(_included(scope, scope.field(k), x).alias(k))
        else:
            cols.append(compile_expr(scope, x).col.alias(k))
    return df.select(*cols, *hidden)


@stage("$addFields", "$set")
def _add_fields(df, spec, _):
    """All expressions see the document as it comes in."""
    scope, out = Scope(df), {}
    for path, e in spec.items():
        top, *rest = path.split(".")
        new = compile_expr(scope, e).col
        if rest:
            if top in df.columns:
                base = out.get(top, F.col(f"`{top}`"))
                new = with_path(base, df.select(base.alias("x")).schema["x"].dataType, rest, lambda _, new=new: new)
            else:
                new = reduce(lambda c, p: F.struct(c.alias(p)), reversed(rest), new)
        out[top] = new
    return df.withColumns(out)


def _without(field: str) -> Callable[[Column], Column]:
    return lambda e: e.dropFields(field)


@stage("$unset")
def _unset(df, paths, _):
    out = {}
    flat = []
    for path in [paths] if isinstance(paths, str) else paths:
        top, *rest = path.split(".")
        if rest and top in df.columns:
            kind = df.schema[top].dataType
            field = ".".join(rest)
            base = out.get(top, F.col(f"`{top}`"))
            out[top] = F.transform(base, _without(field)) if isinstance(kind, T.ArrayType) else base.dropFields(field)
        elif not rest:
            flat.append(top)
    return df.withColumns(out).drop(*flat)


@stage("$replaceRoot")
def _replace_root(df, spec, _):
    v = compile_expr(Scope(df), spec["newRoot"])
    if not isinstance(v.type, T.StructType):
        raise QueryError("the new root must be an object")
    return df.select(v.col.alias("_root"), *([SEQ] if SEQ in df.columns else [])).select("_root.*", *([SEQ] if SEQ in df.columns else []))


STAGES["$replaceWith"] = lambda df, e, o: _replace_root(df, {"newRoot": e}, o)


#: accumulators whose result depends on the order of documents
ORDERED = {"$first", "$last", "$push", "$mergeObjects", "$firstN", "$lastN", "$top", "$topN", "$bottom", "$bottomN"}


@stage("$group")
def _group(df, spec, _):
    if SEQ not in df.columns and any(next(iter(x)) in ORDERED for k, x in spec.items() if k != "_id"):
        df = df.withColumn(SEQ, F.monotonically_increasing_id())
    scope, order = Scope(df), F.col(SEQ) if SEQ in df.columns else F.lit(0)
    key = compile_expr(scope, spec["_id"])
    key_col = key.col if not (key.is_const and key.const is None) else F.lit(None).cast("string")
    plain, ranked = [], []
    for k, x in spec.items():
        if k != "_id":
            name, arg = next(iter(x.items()))
            (ranked if name in RANKED else plain).append((k, name, arg))
    best = [_best(df, scope, key_col, k, name, arg, order) for k, name, arg in ranked]
    if len(best) == 1 and not plain and ranked[0][1] not in ("$minN", "$maxN") and ranked[0][2].get("n", 1) > 0:
        return best[0]
    aggs = [accumulator(scope, name, arg, order).alias(k) for k, name, arg in plain]
    out = df.groupBy(key_col.alias("_id")).agg(*(aggs or [F.count(F.lit(1)).alias("_n")]))
    for (k, name, _arg), found in zip(ranked, best, strict=True):
        found = found.withColumnRenamed("_id", "_found")
        out = out.join(found, F.col("_id").eqNullSafe(F.col("_found")), "left").drop("_found")
        if name.endswith("N"):
            out = out.withColumn(k, F.coalesce(F.col(f"`{k}`"), F.array().cast(found.schema[k].dataType)))
    return out.select("_id", *[F.col(f"`{k}`") for k in spec if k != "_id"])


def _best(df: DataFrame, scope: Scope, key: Column, k: str, name: str, arg: dict, order: Column) -> DataFrame:
    """_id and k, of one of RANKED. Ranks are cut off before the shuffle and after it, so no group is gathered whole."""
    value, keys, n, back = ranking(scope, name, arg, order)
    rows = df.filter(value.isNotNull()) if name in ("$minN", "$maxN") else df
    rows = rows.select(key.alias("_id"), value.alias("v"), *[c.alias(f"k{i}") for i, (c, _) in enumerate(keys)])
    by = [F.col(f"k{i}").asc_nulls_first() if up else F.col(f"k{i}").desc_nulls_last() for i, (_, up) in enumerate(keys)]
    kept = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_id").orderBy(*by))).filter(F.col("rank") <= n)
    if not name.endswith("N"):
        return kept.select("_id", F.col("v").alias(k))
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("rank") if back else F.col("rank")).alias("rank"), "v")))
    return kept.groupBy("_id").agg(F.transform(in_order, lambda e: e["v"]).alias(k))


@stage("$sort")
def _sort(df, spec, _):
    """Null lowest; ties by the order before."""
    scope = Scope(df)
    keys = [scope.field(path).col for path in spec]
    keys = [k.asc_nulls_first() if sign == 1 else k.desc_nulls_last() for k, sign in zip(keys, spec.values(), strict=True)]
    return df.orderBy(*keys, *([F.col(SEQ)] if SEQ in df.columns else [])).drop(SEQ)


def _by_seq(df: DataFrame) -> DataFrame:
    return df.orderBy(SEQ) if SEQ in df.columns else df


@stage("$limit")
def _limit(df, n, _):
    return _by_seq(df).limit(n)


@stage("$skip")
def _skip(df, n, _):
    return _by_seq(df).offset(n)


@stage("$unwind")
def _unwind(df, spec, _):
    spec = {"path": spec} if isinstance(spec, str) else spec
    path, keep, index = spec["path"].lstrip("$"), spec.get("preserveNullAndEmptyArrays", False), spec.get("includeArrayIndex")
    v = Scope(df).field(path)
    top, *rest = path.split(".")
    if not isinstance(v.type, T.ArrayType):  # a lone value is its own element
        df = df if keep else df.filter(v.col.isNotNull())
        return df.withColumn(index, F.lit(None).cast("bigint")) if index else df
    f = F.posexplode_outer if keep else F.posexplode
    out = df.select("*", f(v.col).alias("_pos", "_element"))
    out = out.withColumn(top, F.col(f"`{top}`").withField(".".join(rest), F.col("_element")) if rest else F.col("_element"))
    if index:
        out = out.withColumn(index, F.col("_pos").cast("bigint"))
    if SEQ in df.columns:
        out = out.withColumn(SEQ, F.struct(F.col(SEQ).alias("s"), F.col("_pos").alias("p")))
    return out.drop("_pos", "_element")


@stage("$count")
def _count(df, name, _):
    return df.agg(F.count(F.lit(1)).alias(name)).filter(F.col(f"`{name}`") > 0)


@stage("$sortByCount")
def _sort_by_count(df, e, _):
    return df.groupBy(compile_expr(Scope(df), e).col.alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))


@stage("$bucket")
def _bucket(df, spec, _):
    """[lo, hi) of neighbouring boundaries; outside of all: default, or an error."""
    v, bounds = compile_expr(Scope(df), spec["groupBy"]).col, spec["boundaries"]
    key = None
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        hit = (v >= F.lit(lo)) & (v < F.lit(hi))
        key = F.when(hit, F.lit(lo)) if key is None else key.when(hit, F.lit(lo))
    if "default" in spec:
        d = spec["default"]
        mixed = isinstance(d, str) != isinstance(bounds[0], str)
        key = key.otherwise(F.lit(d))
        if mixed:
            key = None
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                hit = (v >= F.lit(lo)) & (v < F.lit(hi))
                key = F.when(hit, F.lit(str(lo))) if key is None else key.when(hit, F.lit(str(lo)))
            key = key.otherwise(F.lit(str(d)))
    else:
        key = key.otherwise(F.raise_error(F.lit("$bucket: a value is outside of all boundaries, and there is no default")))
    return _group(df.withColumn("_bucket", key), {"_id": "$_bucket", **spec.get("output", {"count": {"$sum": 1}})}, _).orderBy("_id")


@stage("$bucketAuto")
def _bucket_auto(df, spec, _):
    """n buckets of about one size, equal values never split; a bucket ends where the next begins.

    Values are counted first, and the distinct ones are placed by the rows before them. These come from a window inside
    range partitions and the totals of the partitions before, so no task holds all values.
    """
    n = spec["buckets"]
    df = df.withColumn("_value", compile_expr(Scope(df), spec["groupBy"]).col)
    counts = df.groupBy("_value").agg(F.count(F.lit(1)).alias("_rows"))
    counts = counts.repartitionByRange(F.col("_value").asc_nulls_first()).withColumn("_part", F.spark_partition_id()).persist()
    parts = counts.groupBy("_part").agg(F.sum("_rows").alias("_r"))  # a row for each partition
    before = F.coalesce(F.sum("_r").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_r").over(Window.partitionBy())
    parts = parts.select(F.col("_part").alias("_p"), before.alias("_before"), total.alias("_total"))
    inside = F.coalesce(F.sum("_rows").over(Window.partitionBy("_part").orderBy(F.col("_value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.withColumn("_inside", inside).join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    size = F.greatest(F.round(F.col("_total") / n), F.lit(1))
    placed = placed.select(F.col("_value").alias("_v"), F.least(F.floor((F.col("_inside") + F.col("_before")) / size), F.lit(n - 1)).alias("_bucket"))
    spans = placed.groupBy("_bucket").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    spans = spans.withColumn("_max", F.coalesce(F.lead("_min").over(Window.orderBy("_bucket")), F.col("_max"))).withColumnRenamed("_bucket", "_b")
    joined = df.join(placed, F.col("_value").eqNullSafe(F.col("_v"))).join(F.broadcast(spans), F.col("_bucket") == F.col("_b"))
    joined = joined.withColumn("_span", F.struct(F.col("_min").alias("min"), F.col("_max").alias("max")))
    return _group(joined, {"_id": "$_span", **spec.get("output", {"count": {"$sum": 1}})}, _).orderBy("_id.min")


@stage("$facet")
def _facet(df, spec, others):
    """One document of arrays; each facet is a row of its own, joined side by side."""
    frames = []
    for name, sub in spec.items():
        out = run(df, sub, others)
        whole = F.struct(*[F.col(f"`{c}`") for c in visible(out)])
        out = out.select(order_of(out).alias("o"), whole.alias("v"))
        frames.append(out.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias(name)))
    return reduce(lambda a, b: a.crossJoin(b), frames)  # of one row each


@stage("$sample")
def _sample(df, spec, _):
    return df.orderBy(F.rand()).limit(spec["size"])


@stage("$redact")
def _redact(df, e, _):
    """$$KEEP keeps a document, $$PRUNE drops it, $$DESCEND keeps it and asks again of each object below."""

    def verdict(scope: Scope) -> Column:
        return compile_expr(scope, e).col

    def below(v: Value, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            inner = Scope(_frame_of(v.scope.frame, t))
            if not all(_resolves(inner, n) for n in _fields(e)):
                return v.col
            return F.when(_over(v, e) == "$$PRUNE", F.lit(None)).otherwise(F.when(_over(v, e) == "$$KEEP", v.col).otherwise(F.struct(*[below(walk(v, [f.name]), f.dataType).alias(f.name) for f in t.fields])))
        if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
            el = t.elementType
            kept = F.filter(v.col, lambda x: _over(v.scope.element(x, el), e) != "$$PRUNE")
            return kept
        return v.col

    scope = Scope(df)
    said = verdict(scope)
    kept = df.withColumn("_said", said).filter(F.col("_said") != "$$PRUNE")
    changes = {}
    for f in df.schema:
        if f.name != SEQ and isinstance(f.dataType, (T.StructType, T.ArrayType)) and not (isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType)):
            v = Scope(kept).field(f.name)
            names = f.dataType.names if isinstance(f.dataType, T.StructType) else f.dataType.elementType.names
            if set(_fields(e)) & set(names):
                changes[f.name] = F.when(F.col("_said") == "$$DESCEND", below(v, f.dataType)).otherwise(v.col)
    return kept.withColumns(changes).drop("_said")


def _fields(e: Any) -> list[str]:
    """First names of the paths that an expression reads."""
    if isinstance(e, str) and e.startswith("$") and not e.startswith("$$"):
        return [e[1:].split(".")[0]]
    if isinstance(e, dict):
        return [n for x in e.values() for n in _fields(x)]
    return [n for x in e for n in _fields(x)] if isinstance(e, (list, tuple)) else []


def _frame_of(frame: DataFrame, t: T.StructType) -> DataFrame:
    return frame.sparkSession.createDataFrame([], t)


def _resolves(scope: Scope, name: str) -> bool:
    return name in scope.frame.columns


def _over(v: Value, e: Any) -> Column:
    """An expression over the fields of a struct."""
    if isinstance(e, str) and e.startswith("$") and not e.startswith("$$"):
        return walk(v, e[1:].split(".")).col
    bound = {f"f_{n}": walk(v, [n]) for n in _fields(e)}
    return compile_expr(v.scope.bind(**bound), _renamed(e)).col


def _renamed(e: Any) -> Any:
    if isinstance(e, str) and e.startswith("$") and not e.startswith("$$"):
        return f"$$f_{e[1:]}"
    if isinstance(e, dict):
        return {k: _renamed(x) for k, x in e.items()}
    return [_renamed(x) for x in e] if isinstance(e, (list, tuple)) else e


def _named(others: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in others:
        raise QueryError(f"unknown collection: {name}")
    return others[name]


def _gathered(keyed: DataFrame, by: str) -> DataFrame:
    """by and _matches: the documents (o, v) of each key, in order."""
    return keyed.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("_matches"))


@stage("$lookup")
def _lookup(df, spec, others):
    """Left outer equi-join; matches are gathered before the join, so a document keeps its one row, and only those that
    some document asks for. An array in localField matches by any of its elements."""
    if "let" in spec:
        raise QueryError("$lookup joins by localField and foreignField; let isn't known")
    right = run(_named(others, spec["from"]), spec.get("pipeline", []), others)
    whole = F.struct(*[F.col(f"`{c}`") for c in visible(right)])
    keyed = right.select(Scope(right).field(spec["foreignField"]).col.alias("_fk"), order_of(right).alias("o"), whole.alias("v"))
    local = Scope(df).field(spec["localField"])
    wanted = df.select(local.col.alias("_local")).distinct()
    if isinstance(local.type, T.ArrayType):
        each = wanted.select("_local", F.explode(F.array_distinct("_local")).alias("_lk"))
        matches = _gathered(each.join(keyed, F.col("_lk").eqNullSafe(F.col("_fk"))).dropDuplicates(["_local", "o"]), "_local")
    else:
        matches = _gathered(keyed.join(wanted, F.col("_fk").eqNullSafe(F.col("_local")), "left_semi").withColumnRenamed("_fk", "_local"), "_local")
    out = df.join(matches, local.col.eqNullSafe(F.col("_local")), "left")
    return out.withColumn(spec["as"], F.coalesce("_matches", F.array().cast(matches.schema["_matches"].dataType))).drop("_local", "_matches")


@stage("$graphLookup")
def _graph_lookup(df, spec, others):
    """From startWith along connectFromField to connectToField, breadth first, one join a round; each document once for
    each start. Rounds end at maxDepth, or when a round finds no document that is new."""
    right = _named(others, spec["from"])
    whole = F.struct(*[F.col(f"`{c}`") for c in visible(right)])
    nodes = right.select(Scope(right).field(spec["connectToField"]).col.alias("_to"), Scope(right).field(spec["connectFromField"]).col.alias("_next"), order_of(right).alias("o"), whole.alias("v"))
    if "restrictSearchWithMatch" in spec:
        nodes = nodes.filter(compile_query(right, spec["restrictSearchWithMatch"]))
    many = lambda d, c, name: d.withColumn(name, F.explode(c)) if isinstance(d.schema[c].dataType, T.ArrayType) else d.withColumn(name, F.col(c))
    start = compile_expr(Scope(df), spec["startWith"]).col
    front = many(df.select(start.alias("_start")).distinct(), "_start", "_at").filter("_at is not null")
    found = None
    for depth in range(spec.get("maxDepth", 1 << 30) + 1):
        step = front.select("_start", "_at").distinct().join(nodes, F.col("_at") == F.col("_to")).dropDuplicates(["_start", "o"])
        if found is not None:
            step = step.join(found.select(F.col("_start").alias("_s"), F.col("o").alias("_o")), F.col("_start").eqNullSafe(F.col("_s")) & (F.col("o") == F.col("_o")), "left_anti")
        step = step.select("_start", "_next", "o", "v", F.lit(depth).cast("bigint").alias("_depth")).persist()
        if step.isEmpty():
            break
        found = step if found is None else found.union(step)
        front = many(step, "_next", "_at").filter("_at is not null")
    if found is None:
        found = step
    if "depthField" in spec:
        found = found.withColumn("v", F.col("v").withField(spec["depthField"], F.col("_depth")))
    matches = _gathered(found, "_start")
    out = df.join(matches, start.eqNullSafe(F.col("_start")), "left")
    return out.withColumn(spec["as"], F.coalesce("_matches", F.array().cast(matches.schema["_matches"].dataType))).drop("_start", "_matches")


@stage("$unionWith")
def _union_with(df, spec, others):
    spec = {"coll": spec} if isinstance(spec, str) else spec
    other = run(_named(others, spec["coll"]), spec.get("pipeline", []), others)
    if SEQ in df.columns:
        df = df.withColumn(SEQ, F.struct(F.lit(0).alias("side"), F.col(SEQ).alias("s")))
        other = other.withColumn(SEQ, F.struct(F.lit(1).alias("side"), order_of(other).alias("s")))
    return df.unionByName(other, allowMissingColumns=True)


@stage("$out")
def _out(df, path, _):
    df.drop(SEQ).write.parquet(path)
    return df


def _decaying(xs: Column, alpha: float) -> Column:
    """The exponential moving average of an array, from its first value on."""
    return F.aggregate(xs, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(alpha * x + (1 - alpha) * acc))


@stage("$setWindowFields")
def _window_fields(df, spec, _):
    scope = Scope(df)
    w = Window.partitionBy(*([compile_expr(scope, spec["partitionBy"]).col] if spec.get("partitionBy") is not None else []))
    sort = [(scope.field(p).col, s) for p, s in (spec.get("sortBy") or {}).items()]
    if sort:
        w = w.orderBy(*[c.asc_nulls_first() if s > 0 else c.desc_nulls_last() for c, s in sort])
    ends = {"unbounded": (Window.unboundedPreceding, Window.unboundedFollowing), "current": (Window.currentRow, Window.currentRow)}
    out = {}
    for name, x in spec["output"].items():
        x = dict(x)
        frame = x.pop("window", None)
        (fn, arg) = next(iter(x.items()))
        over = w
        if frame and fn not in ("$rank", "$denseRank", "$documentNumber", "$shift"):
            kind = "documents" if "documents" in frame else "range"
            lo, hi = (ends[b][i] if isinstance(b, str) else b for i, b in enumerate(frame[kind]))
            over = w.rowsBetween(lo, hi) if kind == "documents" else w.rangeBetween(lo, hi)
        elif not frame and sort and fn not in ("$rank", "$denseRank", "$documentNumber", "$shift", "$expMovingAvg", "$locf"):
            over = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        if fn in ("$rank", "$denseRank", "$documentNumber"):
            out[name] = {"$rank": F.rank, "$denseRank": F.dense_rank, "$documentNumber": F.row_number}[fn]().over(w)
        elif fn == "$shift":
            c, by = compile_expr(scope, arg["output"]).col, arg["by"]
            shifted = F.lead(c, by) if by >= 0 else F.lag(c, -by)
            shifted = shifted.over(w)
            out[name] = F.coalesce(shifted, F.lit(arg["default"])) if arg.get("default") is not None else shifted
        elif fn == "$locf":
            out[name] = F.last(compile_expr(scope, arg).col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        elif fn == "$push":
            out[name] = F.transform(F.collect_list(F.struct(compile_expr(scope, arg).col.alias("v"))).over(over), lambda x: x["v"])
        elif fn in ("$first", "$last"):
            out[name] = (F.first if fn == "$first" else F.last)(compile_expr(scope, arg).col).over(over)
        elif fn == "$derivative":
            c, t = compile_expr(scope, arg["input"]).col.cast("double"), sort[0][0].cast("double")
            out[name] = F.try_divide(F.last(c).over(over) - F.first(c).over(over), F.last(t).over(over) - F.first(t).over(over))
        elif fn == "$addToSet":
            out[name] = F.transform(F.array_sort(F.collect_set(F.struct(compile_expr(scope, arg).col.alias("v"))).over(over)), lambda x: x["v"])
        elif fn == "$expMovingAvg":
            alpha = float(arg["alpha"]) if "alpha" in arg else 2.0 / (arg["N"] + 1)
            rows = math.ceil(40 / alpha)  # what is farther back weighs e^-40 at most, which a double can't tell from nothing
            xs = F.collect_list(compile_expr(scope, arg["input"]).col.cast("double")).over(w.rowsBetween(-rows, Window.currentRow))
            out[name] = _decaying(xs, alpha)
        elif fn == "$integral":
            c, t = compile_expr(scope, arg["input"]).col.cast("double"), sort[0][0].cast("double") / SECONDS[arg.get("unit")]
            df = df.withColumn(f"_area_{name}", F.coalesce((t - F.lag(t).over(w)) * (c + F.lag(c).over(w)) / 2, F.lit(0.0)))
            out[name] = F.sum(f"_area_{name}").over(over) - F.first(f"_area_{name}").over(over)
        else:
            agg = accumulator(scope, fn, arg, order_of(df))
            out[name] = F.coalesce(F.sum(compile_expr(scope, arg).col).over(over), F.lit(0)) if fn == "$sum" else agg.over(over)
    return df.withColumns(out).drop(*[f"_area_{name}" for name in out])


@stage("$fill")
def _fill(df, spec, _):
    scope, out = Scope(df), {}
    w = Window.partitionBy(*[scope.field(p).col for p in spec.get("partitionByFields", [])])
    if spec.get("sortBy"):
        w = w.orderBy(*[scope.field(p).col.asc_nulls_first() if s > 0 else scope.field(p).col.desc_nulls_last() for p, s in spec["sortBy"].items()])
    for name, how in spec["output"].items():
        c = scope.field(name).col
        if "value" in how:
            out[name] = F.coalesce(c, compile_expr(scope, how["value"]).col)
        elif how.get("method") == "locf":
            out[name] = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        elif how.get("method") == "linear":
            (by, _), *more = spec["sortBy"].items()
            if more:
                raise QueryError("linear $fill takes one sort field")
            at = scope.field(by).col.cast("double")
            known = F.when(c.isNotNull(), F.struct(at.alias("t"), c.cast("double").alias("v")))
            lo = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            hi = F.first(known, ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
            between = lo["v"] + (hi["v"] - lo["v"]) * F.try_divide(at - lo["t"], hi["t"] - lo["t"])
            out[name] = F.coalesce(c.cast("double"), between)
        else:
            raise QueryError("$fill knows value, locf and linear")
    return df.withColumns(out)


@stage("$densify")
def _densify(df, spec, _):
    """Rows for the missing steps between the least and the greatest value of each partition."""
    field, by, r = spec["field"], spec.get("partitionByFields", []), spec["range"]
    step = F.lit(r["step"]) if "unit" not in r else F.expr(f"interval {r['step']} {r['unit']}")
    spans = df.groupBy(*by).agg(F.min(field).alias("_lo"), F.max(field).alias("_hi"))
    if isinstance(r["bounds"], list):
        spans = spans.withColumn("_lo", F.lit(r["bounds"][0])).withColumn("_hi", F.lit(r["bounds"][1]) - step)
    full = spans.select(*by, F.explode(F.sequence("_lo", "_hi", step)).alias(field))
    return full.join(df, [*by, field], "full")
