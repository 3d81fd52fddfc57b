"""Aggregation expressions as Columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.predicate import QueryError, java_regex
from docmill.functions.values import Scope, Value, is_array, is_number, is_time, rank, truthy, walk

OPS: dict[str, Callable[[Scope, Any], Value]] = {}


def op(*names: str):
    def put(f):
        OPS.update(dict.fromkeys(names, f))
        return f

    return put


def compile_expr(scope: Scope, e: Any) -> Value:
    if isinstance(e, Value):
        return e
    if isinstance(e, Column):
        return Value(scope, e, e)
    if isinstance(e, str) and e.startswith("$$"):
        return _variable(scope, e[2:])
    if isinstance(e, str) and e.startswith("$"):
        return scope.field(e[1:])
    if isinstance(e, (list, tuple)):
        return _array(scope, [compile_expr(scope, x) for x in e])
    if isinstance(e, dict):
        if len(e) == 1 and next(iter(e)).startswith("$"):
            name, args = next(iter(e.items()))
            if name not in OPS:
                raise QueryError(f"unknown expression: {name}")
            return OPS[name](scope, args)
        if not e:
            return scope.const(None)
        return _struct(scope, {k: compile_expr(scope, x) for k, x in e.items()})
    return scope.const(e)


def _variable(scope: Scope, name: str) -> Value:
    head, *rest = name.split(".")
    if head in scope.variables:
        return walk(scope.variables[head], rest)
    if head in ("ROOT", "CURRENT"):
        whole = F.struct(*[F.col(f"`{c}`") for c in scope.frame.columns if not c.startswith("_ord") and c != "_seq"])
        return walk(Value(scope, whole, whole), rest)
    if head == "NOW":
        return Value(scope, F.current_timestamp(), F.current_timestamp())
    if head == "REMOVE":
        return scope.const(None)
    if head in ("KEEP", "PRUNE", "DESCEND"):
        return scope.const(f"$${head}")
    raise QueryError(f"unknown variable: $${name}")


def many(scope: Scope, vs: list[Value], f: Callable[..., Column]) -> Value:
    return Value(scope, f(*(v.col for v in vs)), f(*(v.stand_in for v in vs)))


def _struct(scope: Scope, vs: dict[str, Value]) -> Value:
    return many(scope, list(vs.values()), lambda *cs: F.struct(*[c.alias(k) for k, c in zip(vs, cs, strict=True)]))


def _array(scope: Scope, vs: list[Value]) -> Value:
    return many(scope, vs, lambda *cs: F.array(*cs))


def _list(scope: Scope, args: Any) -> list[Value]:
    return [compile_expr(scope, a) for a in (args if isinstance(args, (list, tuple)) else [args])]


def _one(scope: Scope, args: Any) -> Value:
    """The only argument, which may stand in a list of one."""
    if isinstance(args, (list, tuple)) and len(args) == 1:
        args = args[0]
    return compile_expr(scope, args)


def _simple(name: str, f: Callable[..., Column]) -> None:
    OPS[name] = lambda scope, args: many(scope, _list(scope, args), f)


def _unary(name: str, f: Callable[[Column], Column]) -> None:
    OPS[name] = lambda scope, args: _one(scope, args).map(f)


# field access, variables, control


@op("$literal")
def _literal(scope, x):
    return scope.const(x)


@op("$let")
def _let(scope, args):
    return compile_expr(scope.bind(**{k: compile_expr(scope, x) for k, x in args["vars"].items()}), args["in"])


@op("$cond")
def _cond(scope, args):
    test, then, other = (args["if"], args["then"], args["else"]) if isinstance(args, dict) else args
    return many(scope, [truthy(compile_expr(scope, test)), compile_expr(scope, then), compile_expr(scope, other)], lambda c, t, o: F.when(c, t).otherwise(o))


@op("$switch")
def _switch(scope, args):
    tests = [truthy(compile_expr(scope, b["case"])) for b in args["branches"]]
    thens = [compile_expr(scope, b["then"]) for b in args["branches"]]
    n = len(tests)
    last = [compile_expr(scope, args["default"])] if "default" in args else []

    def built(*cs: Column) -> Column:
        c = reduce(lambda acc, k: acc.when(cs[k], cs[n + k]), range(1, n), F.when(cs[0], cs[n]))
        return c.otherwise(cs[2 * n] if last else F.raise_error(F.lit("$switch: no branch matches, and there is no default")))

    return many(scope, [*tests, *thens, *last], built)


_simple("$ifNull", lambda *cs: F.coalesce(*cs))

# arithmetic


def _millis(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


@op("$add")
def _add(scope, args):
    vs = _list(scope, args)
    times = [v for v in vs if is_time(v.type)]
    if not times:
        return many(scope, vs, lambda *cs: reduce(lambda a, b: a + b, cs))
    others = [v for v in vs if v is not times[0]]
    return many(scope, [times[0], *others], lambda t, *cs: F.timestamp_add("MILLISECOND", reduce(lambda a, b: a + b, cs).cast("bigint"), t))


@op("$subtract")
def _subtract(scope, args):
    a, b = _list(scope, args)
    if is_time(a.type):
        if is_time(b.type):
            return a.map(lambda x, y: _millis(x) - _millis(y), b)
        return a.map(lambda x, y: F.timestamp_add("MILLISECOND", (-y).cast("bigint"), x), b)
    return a.map(lambda x, y: x - y, b)


_simple("$multiply", lambda *cs: reduce(lambda a, b: a * b, cs))
_simple("$divide", lambda a, b: F.try_divide(a.cast("double"), b.cast("double")))
_simple("$mod", lambda a, b: F.when(b != 0, a % F.nullif(b, F.lit(0))))
for _name in ("abs", "exp", "sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "ln", "log10"):
    _unary(f"${_name}", getattr(F, _name))
_unary("$ceil", F.ceil)
_unary("$floor", F.floor)
_unary("$degreesToRadians", F.radians)
_unary("$radiansToDegrees", F.degrees)
_simple("$atan2", lambda y, x: F.atan2(y, x))
_simple("$log", lambda x, b: F.ln(x) / F.ln(b))
_simple("$pow", lambda x, y: F.pow(x, y))
OPS["$rand"] = lambda scope, args: Value(scope, F.rand(), F.rand())
_simple("$bitAnd", lambda *cs: reduce(lambda a, b: a.bitwiseAND(b), cs))
_simple("$bitOr", lambda *cs: reduce(lambda a, b: a.bitwiseOR(b), cs))
_simple("$bitXor", lambda *cs: reduce(lambda a, b: a.bitwiseXOR(b), cs))
_unary("$bitNot", F.bitwise_not)


@op("$round")
def _round(scope, args):
    """Half to even."""
    args = args if isinstance(args, (list, tuple)) else [args]
    return compile_expr(scope, args[0]).map(lambda c: F.bround(c, int(args[1]) if len(args) > 1 else 0))


@op("$trunc")
def _trunc(scope, args):
    args = args if isinstance(args, (list, tuple)) else [args]
    by = 10.0 ** (int(args[1]) if len(args) > 1 else 0)
    return compile_expr(scope, args[0]).map(lambda c: F.signum(c) * F.floor(F.abs(c) * by) / by)


# comparison: two-valued, null lowest, different types by the order of types


def _compare(scope: Scope, args: Any, of: Callable[[Column, Column], Column], by_rank: Callable[[int, int], bool]) -> Value:
    a, b = _list(scope, args)
    ra, rb = rank(a.type), rank(b.type)
    if ra and rb and ra != rb:
        known = by_rank(ra, rb)
        both = lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.lit(known)).otherwise(of(x.isNotNull().cast("int"), y.isNotNull().cast("int")))
        return a.map(both, b)
    return a.map(of, b)


_false = lambda c: F.coalesce(c, F.lit(False))
_gt = lambda x, y: F.coalesce(x > y, x.isNotNull() & y.isNull())
_gte = lambda x, y: F.coalesce(x >= y, y.isNull())
OPS["$eq"] = lambda s, a: _compare(s, a, lambda x, y: x.eqNullSafe(y), lambda p, q: False)
OPS["$ne"] = lambda s, a: _compare(s, a, lambda x, y: ~x.eqNullSafe(y), lambda p, q: True)
OPS["$gt"] = lambda s, a: _compare(s, a, _gt, lambda p, q: p > q)
OPS["$gte"] = lambda s, a: _compare(s, a, _gte, lambda p, q: p > q)
OPS["$lt"] = lambda s, a: _compare(s, a, lambda x, y: _gt(y, x), lambda p, q: p < q)
OPS["$lte"] = lambda s, a: _compare(s, a, lambda x, y: _gte(y, x), lambda p, q: p < q)


@op("$cmp")
def _cmp(scope, args):
    same, less = OPS["$eq"](scope, args), OPS["$lt"](scope, args)
    return same.map(lambda e, l: F.when(e, 0).when(l, -1).otherwise(1), less)


OPS["$and"] = lambda s, a: many(s, [truthy(v) for v in _list(s, a)], lambda *cs: reduce(lambda x, y: x & y, cs, F.lit(True)))
OPS["$or"] = lambda s, a: many(s, [truthy(v) for v in _list(s, a)], lambda *cs: reduce(lambda x, y: x | y, cs, F.lit(False)))
OPS["$not"] = lambda s, a: truthy(_one(s, a)).map(lambda c: ~c)

# strings

_simple("$concat", lambda *cs: F.concat(*cs))
_unary("$toLower", lambda c: F.lower(F.coalesce(c.cast("string"), F.lit(""))))
_unary("$toUpper", lambda c: F.upper(F.coalesce(c.cast("string"), F.lit(""))))


def _substr(s: Column, i: Column, n: Column) -> Column:
    return F.when(n < 0, F.substring(s, i + 1, F.char_length(s))).otherwise(F.substring(s, i + 1, F.greatest(n, F.lit(0))))


_simple("$substr", _substr)
_simple("$substrCP", _substr)
_simple("$substrBytes", lambda s, i, n: F.decode(F.substring(F.encode(s, "UTF-8"), i + 1, F.when(n < 0, F.octet_length(s)).otherwise(n)), "UTF-8"))
_unary("$strLenCP", F.char_length)
_unary("$strLenBytes", F.octet_length)


@op("$indexOfCP")
def _index_of(scope, args):
    vs = _list(scope, args)

    def found(s, sub, start=None, end=None):
        start = F.lit(0) if start is None else start
        s = s if end is None else F.substring(s, F.lit(1), end)
        return F.position(sub, s, start + 1) - 1

    return many(scope, vs, found)


@op("$indexOfBytes")
def _index_of_bytes(scope, args):
    s, sub, *rest = _list(scope, args)
    if rest:
        raise QueryError("$indexOfBytes takes no start or end here")
    return s.map(lambda c, d: F.when(F.instr(c, d) > 0, F.octet_length(F.substring(c, F.lit(1), F.instr(c, d) - 1))).otherwise(F.when(c.isNotNull() & d.isNotNull(), -1)), sub)


def _quoted(d: Column) -> Column:
    return F.concat(F.lit("\\Q"), d, F.lit("\\E"))


_simple("$split", lambda s, d: F.split(s, _quoted(d)))
_simple("$strcasecmp", lambda a, b: F.when(F.upper(a) == F.upper(b), 0).when(F.upper(a) < F.upper(b), -1).otherwise(1))
for _name, _f in (("$trim", F.btrim), ("$ltrim", F.ltrim), ("$rtrim", F.rtrim)):
    OPS[_name] = lambda scope, args, f=_f: many(scope, [compile_expr(scope, args["input"]), *([compile_expr(scope, args["chars"])] if args.get("chars") is not None else [])], lambda c, chars=None: f(c, chars) if chars is not None else f(c))
OPS["$replaceOne"] = lambda s, a: many(s, [compile_expr(s, a[k]) for k in ("input", "find", "replacement")], lambda c, f, r: F.when(F.instr(c, f) > 0, F.concat(F.substring(c, F.lit(1), F.instr(c, f) - 1), r, F.substring(c, F.instr(c, f) + F.char_length(f), F.char_length(c)))).otherwise(c))
OPS["$replaceAll"] = lambda s, a: many(s, [compile_expr(s, a[k]) for k in ("input", "find", "replacement")], lambda c, f, r: F.replace(c, f, r))


def _pattern(args: dict) -> str:
    return java_regex(args["regex"], args.get("options", "") or "")


OPS["$regexMatch"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c: F.coalesce(c.rlike(_pattern(a)), F.lit(False)))
OPS["$regexFindAll"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c: F.transform(F.regexp_extract_all(c, F.lit(_pattern(a)), F.lit(0)), lambda m: F.struct(m.alias("match"))))


@op("$regexFind")
def _regex_find(scope, args):
    import re

    p = _pattern(args)
    groups = re.compile(re.sub(r"^\(\?[imsx]+\)", "", p)).groups

    def found(c: Column) -> Column:
        captures = F.array(*[F.regexp_extract(c, p, g) for g in range(1, groups + 1)]) if groups else F.array().cast("array<string>")
        return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 0).alias("match"), (F.regexp_instr(c, F.lit(p)) - 1).alias("idx"), captures.alias("captures")))

    return compile_expr(scope, args["input"]).map(found)


# dates


def _dated(f: Callable[[Column], Column]) -> Callable[[Scope, Any], Value]:
    def built(scope: Scope, args: Any) -> Value:
        if isinstance(args, dict) and "date" in args:
            v, zone = compile_expr(scope, args["date"]), args.get("timezone")
            return v.map(lambda c: f(F.from_utc_timestamp(c.cast("timestamp"), zone))) if zone else v.map(f)
        return _one(scope, args).map(f)

    return built


_week = lambda c: F.floor((F.dayofyear(c) + 6 - (F.dayofweek(c) - 1)) / 7).cast("int")
for _name, _f in {"year": F.year, "month": F.month, "dayOfMonth": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "dayOfYear": F.dayofyear, "dayOfWeek": F.dayofweek, "isoWeek": F.weekofyear, "isoDayOfWeek": lambda c: F.weekday(c) + 1, "isoWeekYear": lambda c: F.extract(F.lit("YEAROFWEEK"), c), "week": _week, "millisecond": lambda c: (_millis(c) % 1000).cast("int")}.items():
    OPS[f"${_name}"] = _dated(_f)

#: Format tokens and the Java patterns for them.
DATE_TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%L": "SSS", "%j": "DDD", "%z": "xx", "%Z": "xxx", "%%": "'%'"}


def _date_format(fmt: str) -> list[tuple[str, bool]]:
    """Pieces of a format: (text, is it a Java pattern?); week tokens stay as they are."""
    import re

    return [(DATE_TOKENS.get(t, t), t in DATE_TOKENS) for t in re.findall(r"%.|[^%]+", fmt)]


@op("$dateToString")
def _date_to_string(scope, args):
    weeks = {"%u": lambda c: F.weekday(c) + 1, "%V": lambda c: F.lpad(F.weekofyear(c).cast("string"), 2, "0"), "%G": lambda c: F.extract(F.lit("YEAROFWEEK"), c), "%w": F.dayofweek, "%U": lambda c: F.lpad(_week(c).cast("string"), 2, "0")}

    def shown(c: Column) -> Column:
        c = F.from_utc_timestamp(c.cast("timestamp"), args["timezone"]) if args.get("timezone") else c
        parts = [F.date_format(c, text) if java else weeks[text](c).cast("string") if text in weeks else F.lit(text) for text, java in _date_format(args.get("format", "%Y-%m-%dT%H:%M:%S.%LZ"))]
        return F.concat(*parts)

    v = compile_expr(scope, args["date"]).map(shown)
    return v.map(lambda c, d: F.coalesce(c, d), compile_expr(scope, args["onNull"])) if args.get("onNull") is not None else v


@op("$dateFromString")
def _date_from_string(scope, args):
    fmt = "".join(t if java else f"'{t}'" if t.isalpha() else t for t, java in _date_format(args["format"])) if "format" in args else None
    v = compile_expr(scope, args["dateString"])
    extra = [compile_expr(scope, args[k]) if args.get(k) is not None else scope.const(None) for k in ("onError", "onNull")]

    def parsed(c, on_error, on_null):
        t = F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
        return F.when(c.isNull(), on_null.cast("timestamp")).otherwise(F.coalesce(t, on_error.cast("timestamp")))

    return many(scope, [v, *extra], parsed)


@op("$dateFromParts")
def _date_from_parts(scope, args):
    names = ("year", "month", "day", "hour", "minute", "second", "millisecond")
    vs = [compile_expr(scope, args.get(k, 1 if k in ("month", "day") else 0)) for k in names]

    def made(y, mo, d, h, mi, s, ms):
        day = F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), (mo - 1).cast("int")), (d - 1).cast("int"))
        total = ((h * 60 + mi) * 60 + s) * 1000 + ms
        return F.timestamp_add("MILLISECOND", total.cast("bigint"), day.cast("timestamp"))

    return many(scope, vs, made)


OPS["$dateToParts"] = _dated(lambda c: F.struct(F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"), F.hour(c).alias("hour"), F.minute(c).alias("minute"), F.second(c).alias("second"), (_millis(c) % 1000).cast("int").alias("millisecond")))


def _shifted(sign: int):
    def built(scope: Scope, args: dict) -> Value:
        return compile_expr(scope, args["startDate"]).map(lambda c, n: F.timestamp_add(args["unit"].upper(), (n * sign).cast("int" if args["unit"] in ("year", "quarter", "month") else "bigint"), c), compile_expr(scope, args["amount"]))

    return built


OPS["$dateAdd"], OPS["$dateSubtract"] = _shifted(1), _shifted(-1)


@op("$dateDiff")
def _date_diff(scope, args):
    unit = args["unit"]
    return compile_expr(scope, args["startDate"]).map(lambda a, b: F.timestamp_diff(unit.upper(), F.date_trunc(unit, a), F.date_trunc(unit, b)), compile_expr(scope, args["endDate"]))


@op("$dateTrunc")
def _date_trunc(scope, args):
    v, size = compile_expr(scope, args["date"]), args.get("binSize", 1)
    kind = v.type
    if size == 1:
        return v.map(lambda c: F.date_trunc(args["unit"], c).cast(kind))
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    if args["unit"] not in seconds:
        raise QueryError("$dateTrunc: binSize goes with units up to a week")
    ms = seconds[args["unit"]] * 1000 * size
    origin = 946684800000  # 2000-01-01
    return v.map(lambda c: F.timestamp_millis(F.floor((_millis(c) - origin) / ms) * ms + origin).cast(kind))


# arrays


def _lambda(scope: Scope, v: Value, name: str, body: Any, f: Callable[[Column, Callable[[Column], Column]], Column], wrap=lambda x: x) -> Value:
    """f(array, element -> body) with the element bound to a name."""
    kind = v.type
    inner = kind.elementType if is_array(kind) else T.NullType()
    each = lambda x: wrap(compile_expr(scope.bind(**{name: scope.element(x, inner)}), body)).col
    flat = lambda x: wrap(compile_expr(scope.bind(**{name: Value(scope, x, F.lit(None).cast(inner))}), body)).col
    if any(_has_lambda(b) for b in scope.variables.values()):
        # inside another lambda: the stand-in must not name its variables
        free = Scope(scope.frame, {k: Value(scope, b.stand_in, b.stand_in) for k, b in scope.variables.items()})
        flat = lambda x: wrap(compile_expr(free.bind(**{name: Value(free, x, F.lit(None).cast(inner))}), body)).col
    return Value(scope, f(v.col, each), f(v.stand_in, flat))


def _has_lambda(v: Value) -> bool:
    return v.col is not v.stand_in


OPS["$map"] = lambda s, a: _lambda(s, compile_expr(s, a["input"]), a.get("as", "this"), a["in"], F.transform)
OPS["$filter"] = lambda s, a: _lambda(s, compile_expr(s, a["input"]), a.get("as", "this"), a["cond"], lambda c, f: F.filter(c, lambda x: f(x)), truthy)


@op("$reduce")
def _reduce(scope, args):
    v, init = compile_expr(scope, args["input"]), compile_expr(scope, args["initialValue"])
    inner = v.type.elementType if is_array(v.type) else T.NullType()

    def body(acc_type: T.DataType) -> Callable[[Column, Column], Column]:
        return lambda acc, x: compile_expr(scope.bind(value=scope.element(acc, acc_type), this=scope.element(x, inner)), args["in"]).col.cast(acc_type)

    kind = compile_expr(scope.bind(value=Value(scope, init.stand_in, init.stand_in), this=Value(scope, F.lit(None).cast(inner), F.lit(None).cast(inner))), args["in"]).type
    return Value(scope, F.aggregate(v.col, init.col.cast(kind), body(kind)), F.lit(None).cast(kind))


_at = lambda a, i: F.when(i >= 0, F.get(a, i)).otherwise(F.try_element_at(a, F.least(i, F.lit(-1))))
_simple("$arrayElemAt", _at)
_unary("$first", lambda a: F.get(a, 0))
_unary("$last", lambda a: F.try_element_at(a, F.lit(-1)))
_simple("$concatArrays", lambda *cs: F.concat(*cs))
_simple("$in", lambda x, a: F.coalesce(F.array_contains(a, x), F.lit(False)))
_simple("$nin", lambda x, a: ~F.coalesce(F.array_contains(a, x), F.lit(False)))
_unary("$reverseArray", F.reverse)
_unary("$size", F.size)
OPS["$isArray"] = lambda s, a: (lambda v: v.map(lambda c: c.isNotNull() if is_array(v.type) else F.lit(False)))(_one(s, a))


@op("$indexOfArray")
def _index_of_array(scope, args):
    def found(a, x, start=None, end=None):
        start = F.lit(0) if start is None else start
        part = F.slice(a, start + 1, F.greatest(F.least(F.size(a), F.size(a) if end is None else end) - start, F.lit(0)))
        at = F.array_position(part, x)
        return F.when(at > 0, at - 1 + start).otherwise(F.when(a.isNotNull(), -1)).cast("int")

    return many(scope, _list(scope, args), found)


@op("$range")
def _range(scope, args):
    def made(a, b, step=None):
        step = F.lit(1) if step is None else step
        some = ((step > 0) & (a < b)) | ((step < 0) & (a > b))
        return F.when(some, F.sequence(a, F.when(some, b - F.signum(step).cast("int")).otherwise(a), F.when(some, step).otherwise(1))).otherwise(F.array().cast("array<int>"))

    return many(scope, _list(scope, args), made)


@op("$slice")
def _slice(scope, args):
    def cut(a, i, n=None):
        if n is None:
            return F.when(i >= 0, F.slice(a, F.lit(1), F.greatest(i, F.lit(0)))).otherwise(F.slice(a, F.greatest(F.size(a) + i, F.lit(0)) + 1, F.greatest(-i, F.lit(0))))
        start = F.when(i < 0, F.greatest(F.size(a) + i, F.lit(0))).otherwise(i)
        return F.slice(a, start + 1, n)

    return many(scope, _list(scope, args), cut)


@op("$zip")
def _zip(scope, args):
    vs = [compile_expr(scope, x) for x in args["inputs"]]
    defaults = args.get("defaults") or [None] * len(vs)

    def zipped(*cs):
        sizes = [F.size(c) for c in cs]
        n = sizes[0] if len(cs) == 1 else (F.greatest if args.get("useLongestLength") else F.least)(*sizes)
        idx = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
        get = lambda c, d, i: F.get(c, i) if d is None else F.when(i < F.size(c), F.get(c, i)).otherwise(F.lit(d))
        return F.transform(idx, lambda i: F.array(*[get(c, d, i) for c, d in zip(cs, defaults, strict=True)]))

    return many(scope, vs, zipped)


@op("$sortArray")
def _sort_array(scope, args):
    v, by = compile_expr(scope, args["input"]), args["sortBy"]
    if isinstance(by, int):
        return v.map(lambda c: F.sort_array(c, by > 0))

    def order(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for path, sign in reversed(list(by.items())):
            a, b = x, y
            for part in path.split("."):
                a, b = a.getField(part), b.getField(part)
            out = F.when(a.eqNullSafe(b), out).when(_gt(b, a), -sign).otherwise(sign)
        return out

    return v.map(lambda c: F.array_sort(c, order))


OPS["$firstN"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c: F.slice(c, 1, a["n"]))
OPS["$lastN"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c: F.slice(c, F.greatest(F.size(c) - a["n"], F.lit(0)) + 1, F.lit(a["n"])))
OPS["$maxN"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c: F.slice(F.sort_array(F.array_compact(c), False), 1, a["n"]))
OPS["$minN"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c: F.slice(F.sort_array(F.array_compact(c)), 1, a["n"]))


@op("$arrayToObject")
def _array_to_object(scope, args):
    v = _one(scope, args)
    inner = v.type.elementType
    if isinstance(inner, T.StructType):
        return v.map(lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))))
    return v.map(lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(F.get(x, 0).alias("key"), F.get(x, 1).alias("value")))))


@op("$objectToArray")
def _object_to_array(scope, args):
    v = _one(scope, args)
    kind = v.type
    if isinstance(kind, T.MapType):
        return v.map(lambda c: F.transform(F.map_entries(c), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"))))
    kinds = {f.dataType for f in kind.fields}
    cast = (lambda c: c) if len(kinds) == 1 else (lambda c: c.cast("double" if all(map(is_number, kinds)) else "string"))
    return v.map(lambda c: F.array(*[F.struct(F.lit(f.name).alias("k"), cast(c.getField(f.name)).alias("v")) for f in kind.fields]))


# sets

_simple("$setUnion", lambda *cs: reduce(F.array_union, cs))
_simple("$setIntersection", lambda *cs: reduce(F.array_intersect, cs))
_simple("$setDifference", lambda a, b: F.array_except(a, b))
_simple("$setEquals", lambda *cs: reduce(lambda x, y: x & y, [F.array_sort(F.array_distinct(cs[0])) == F.array_sort(F.array_distinct(c)) for c in cs[1:]]))
_simple("$setIsSubset", lambda a, b: F.size(F.array_except(a, b)) == 0)


def _elements(f):
    def built(scope: Scope, args: Any) -> Value:
        v = _one(scope, args)
        inner = v.type.elementType
        return v.map(lambda c: f(c, lambda x: truthy(scope.element(x, inner)).col))

    return built


OPS["$allElementsTrue"], OPS["$anyElementTrue"] = _elements(F.forall), _elements(F.exists)

# objects and types


@op("$mergeObjects")
def _merge_objects(scope, args):
    vs = _list(scope, args)
    kinds = [v.type for v in vs]
    if any(isinstance(k, T.MapType) for k in kinds):
        later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
        return many(scope, vs, lambda *cs: reduce(later, cs))
    names = list(dict.fromkeys(f.name for k in kinds if isinstance(k, T.StructType) for f in k.fields))

    def merged(*cs):
        of = lambda n: [c.getField(n) for c, k in zip(cs, kinds, strict=True) if isinstance(k, T.StructType) and n in k.names][::-1]
        return F.struct(*[F.coalesce(*of(n)).alias(n) for n in names])

    return many(scope, vs, merged)


@op("$getField")
def _get_field(scope, args):
    if isinstance(args, str):
        return scope.field(args)
    return walk(compile_expr(scope, args.get("input", "$$CURRENT")), [args["field"]])


OPS["$setField"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c, x: c.withField(a["field"], x), compile_expr(s, a["value"]))
OPS["$unsetField"] = lambda s, a: compile_expr(s, a["input"]).map(lambda c: c.dropFields(a["field"]))


def type_name(t: T.DataType) -> str:
    for kind, name in ((T.DoubleType, "double"), (T.FloatType, "double"), (T.StringType, "string"), (T.StructType, "object"), (T.MapType, "object"), (T.ArrayType, "array"), (T.BinaryType, "binData"), (T.BooleanType, "bool"), (T.LongType, "long"), (T.DecimalType, "decimal"), (T.NumericType, "int")):
        if isinstance(t, kind):
            return name
    return "date" if is_time(t) else "null"


OPS["$type"] = lambda s, a: (lambda v: v.map(lambda c: F.when(c.isNull(), "null").otherwise(type_name(v.type))))(_one(s, a))
OPS["$isNumber"] = lambda s, a: (lambda v: v.map(lambda c: c.isNotNull() if is_number(v.type) else F.lit(False)))(_one(s, a))


def _to(v: Value, to: str) -> Value:
    kind = v.type
    if to == "string":
        return v.map(lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if is_time(kind) else c.cast("string"))
    if to in ("bool", "boolean"):
        return v.map(lambda c: c if isinstance(kind, T.BooleanType) else c != 0 if is_number(kind) else F.when(c.isNotNull(), True))
    if to == "date":
        return v.map(lambda c: F.timestamp_millis(c.cast("bigint")) if is_number(kind) else F.try_to_timestamp(c) if isinstance(kind, T.StringType) else c)
    if is_time(kind):
        v = v.map(_millis)
    names = {"int": "int", "long": "bigint", "double": "double", "decimal": "decimal(38,10)"}
    if to not in names:
        raise QueryError(f"can't convert to {to}")
    return v.map(lambda c: c.try_cast(names[to]))


for _name, _to_name in {"$toInt": "int", "$toLong": "long", "$toDouble": "double", "$toDecimal": "decimal", "$toString": "string", "$toBool": "bool", "$toDate": "date"}.items():
    OPS[_name] = lambda s, a, to=_to_name: _to(_one(s, a), to)


@op("$convert")
def _convert(scope, args):
    v = compile_expr(scope, args["input"])
    out = _to(v, args["to"])
    extra = [compile_expr(scope, args[k]) if args.get(k) is not None else scope.const(None) for k in ("onError", "onNull")]
    return many(scope, [v, out, *extra], lambda c, o, e, n: F.when(c.isNull(), n).otherwise(F.coalesce(o, e)))


@op("$function")
def _function(scope, args):
    """body: a callable from Columns to a Column (a pandas_udf is one)."""
    return many(scope, _list(scope, args.get("args", [])), args["body"])
