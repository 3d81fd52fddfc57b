"""Databases and collections: the public API."""

from __future__ import annotations

import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions.predicate import compile_query
from docmill.functions.values import SEQ
from docmill.operators import pipeline as stages
from docmill.operators.find import FindResult, find
from docmill.operators.update import update
from docmill.sources.files import with_order
from docmill.sources.store import STORES, rows_frame

log = logging.getLogger("docmill")


class DestroyedError(RuntimeError):
    """The collection has been destroyed."""

    def __init__(self) -> None:
        super().__init__("this handle's collection is gone; init_collection makes it anew")


class Database:
    """Where collections live: a folder and an adapter. It holds no list of them."""

    def __init__(self, spark: SparkSession, path: str | None = None, adapter: str = "fs", log_level: str | int | None = None):
        if adapter not in STORES:
            raise ValueError(f"Unknown adapter type: {adapter}")
        self.spark, self.path, self.adapter = spark, path or str(Path.cwd() / ".docmill"), adapter
        if log_level:
            log.setLevel(log_level)

    def init_collection(self, name: str, columns: list[dict] | None = None, indexes: list[dict] | None = None) -> Collection:
        """Opens a collection, or makes it. columns: {"title", "type"}, of which date and datetime convert on insert;
        indexes are accepted and not used."""
        return Collection(self.spark, STORES[self.adapter](self.spark, self.path, name, columns), name)


class Collection:
    def __init__(self, spark: SparkSession, store: Any, name: str):
        self.spark, self._store, self.name, self._destroyed, self._frame = spark, store, name, False, None

    @classmethod
    def from_df(cls, df: DataFrame, name: str = "frame") -> Collection:
        """A read-only collection over a frame."""
        out = cls(df.sparkSession, None, name)
        out._frame = df
        return out

    def _check(self) -> None:
        if self._destroyed:
            raise DestroyedError

    def frame(self) -> DataFrame:
        """All documents, with the hidden order column if the collection is stored."""
        self._check()
        if self._frame is not None:
            return self._frame
        df = self._store.read()
        return self.spark.createDataFrame([], f"{SEQ} bigint") if df is None else df

    def insert_many(self, rows: list[dict] | DataFrame) -> None:
        """Documents go behind those that are there, in order."""
        self._check()
        if isinstance(rows, DataFrame):
            df = with_order(rows)
            top = df.agg(F.max(SEQ)).first()[0]
            if top is not None:
                self._store.append(df, top + 1)
        elif rows:
            self._store.append(rows_frame(self.spark, rows, self._store.manifest()["columns"]), len(rows))
        log.debug("%s: inserted", self.name)

    def insert_one(self, row: dict) -> None:
        self.insert_many([row])

    def find_many(self, query: dict | None = None, *, sort: Any = None, offset: int | None = None, limit: int | None = None) -> FindResult:
        return find(self.frame(), query, sort=sort, offset=offset, limit=limit)

    def update_many(self, query: dict, delta: dict) -> None:
        """Commits a new version; nothing is written where no document matches."""
        self._check()
        with self._store.lock:
            df = self.frame()
            new = update(df, query, delta)
            if not df.filter(compile_query(df, query)).isEmpty():
                self._store.replace(new)

    def aggregate(self, pipeline: list[dict], others: dict[str, Collection | DataFrame] | None = None) -> DataFrame:
        frames = {k: v.frame() if isinstance(v, Collection) else v for k, v in (others or {}).items()}
        out = stages.run(self.frame(), pipeline, frames)
        return out.orderBy(SEQ).drop(SEQ) if SEQ in out.columns else out

    def destroy(self) -> None:
        self._check()
        if self._store is not None:
            self._store.destroy()
        self._destroyed = True
