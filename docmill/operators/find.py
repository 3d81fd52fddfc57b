"""find: filter, sort, offset, limit; lazily, with lazy counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.predicate import QueryError, compile_query
from docmill.functions.values import SEQ, Scope


class FindResult:
    """rows (without the hidden order column), count after paging, total_count before; each computed when asked for."""

    def __init__(self, matching: DataFrame, page: DataFrame):
        self._matching, self._page = matching, page

    @property
    def rows(self) -> DataFrame:
        return self._page.drop(SEQ)

    @cached_property
    def count(self) -> int:
        return self._page.count()

    @cached_property
    def total_count(self) -> int:
        return self._matching.count()


def sort_columns(frame: DataFrame, sort: Any) -> list[Column]:
    """Sorters {"asc": selector} or {"desc": selector}; selectors are field paths, Columns or functions of a field
    getter. Nulls come last either way."""
    out = []
    for s in sort if isinstance(sort, (list, tuple)) else [sort]:
        if len(s) != 1 or next(iter(s)) not in ("asc", "desc"):
            raise QueryError(f"a sorter is {{'asc': field}} or {{'desc': field}}, not {s!r}")
        way, sel = next(iter(s.items()))
        scope = Scope(frame)
        for one in sel if isinstance(sel, (list, tuple)) else [sel]:
            c = one if isinstance(one, Column) else one(lambda path: scope.field(path).col) if isinstance(one, Callable) else scope.field(one).col
            keys = [c]
            if isinstance(frame.select(c.alias("x")).schema["x"].dataType, T.VariantType):  # numbers before strings
                keys = [F.when(F.schema_of_variant(c) != "STRING", F.try_variant_get(c, "$", "double")), F.try_variant_get(c, "$", "string")]
            out += [k.asc_nulls_last() if way == "asc" else k.desc_nulls_last() for k in keys]
    return out


def find(frame: DataFrame, query: dict | None = None, *, sort: Any = None, offset: int | None = None, limit: int | None = None) -> FindResult:
    """offset 0 and limit 0 mean none. A negative offset keeps the last rows, a negative limit drops them."""
    matching = frame.filter(compile_query(frame, query)) if query else frame
    keys = [*(sort_columns(matching, sort) if sort else []), *([F.col(SEQ)] if SEQ in matching.columns else [])]
    page = matching
    if (offset or 0) < 0 or (limit or 0) < 0:  # counted from the end: one count makes them ordinary numbers
        n = matching.count()
        offset = max(n + offset, 0) if (offset or 0) < 0 else offset or 0
        if (limit or 0) < 0:
            limit = n + limit - offset
            if limit <= 0:
                return FindResult(matching, matching.limit(0))
    if keys:
        page = page.orderBy(*keys)
    if offset:
        page = page.offset(offset)
    if limit:
        page = page.limit(limit)
    return FindResult(matching, page)
