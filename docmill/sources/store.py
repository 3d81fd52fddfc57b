"""Collections on disk: Parquet segments under version folders, and a manifest that points at them.

A manifest names the segments that make up the collection and the next free order number. Writes put new segments
beside the old ones and then replace the manifest in one rename, so readers see a version as a whole; files that a
reader may have open are never overwritten. Writes of one collection are serialised by a lock in this process.
"""

from __future__ import annotations

import datetime
import json
import os
import threading
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmill.functions.values import SEQ

_locks: dict[str, threading.RLock] = {}
_guard = threading.Lock()


class ParquetStore:
    """The "fs" adapter; "indexeddb" and "localstorage" are names for it as well. Any file system that Hadoop knows."""

    MOST = 32  # segments, beyond which an append makes them one

    def __init__(self, spark: SparkSession, root: str, name: str, columns: list[dict] | None):
        root = root if "://" in root else os.path.abspath(root)
        self.spark, self.dir = spark, f"{root.rstrip('/')}/{name}"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.dir).getFileSystem(spark._jsc.hadoopConfiguration())
        with _guard:
            self.lock = _locks.setdefault(self.dir, threading.RLock())
        with self.lock:
            self._fs.mkdirs(self._path(self.dir))
            if not self._fs.exists(self._path(f"{self.dir}/manifest.json")):
                self._commit({"columns": columns or [], "segments": [], "next": 0})

    def manifest(self) -> dict:
        stream = self._fs.open(self._path(f"{self.dir}/manifest.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Writes the manifest beside the old one, and puts it in its place by one rename."""
        jvm, new = self.spark._jvm, self._path(f"{self.dir}/manifest-{uuid.uuid4().hex}.json~")
        stream = self._fs.create(new, True)
        stream.write(bytearray(json.dumps(manifest, indent=2).encode()))
        stream.close()
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        ways = self.spark.sparkContext._gateway.new_array(rename, 1)
        ways[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        at = lambda p: self._fs.makeQualified(p)
        context.rename(at(new), at(self._path(f"{self.dir}/manifest.json")), ways)

    def _write(self, df: DataFrame) -> dict:
        name = f"segment-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.dir}/{name}")
        return {"name": name, "schema": self.spark.read.parquet(f"{self.dir}/{name}").schema.json()}

    def append(self, df: DataFrame, n: int) -> None:
        with self.lock:
            m = self.manifest()
            segments = [*m["segments"], self._write(df.withColumn(SEQ, F.col(SEQ) + m["next"]))]
            if len(segments) > self.MOST:
                segments = [self._write(self._union(segments))]
            self._commit(m | {"segments": segments, "next": m["next"] + n})

    def replace(self, df: DataFrame) -> None:
        with self.lock:
            m = self.manifest()
            self._commit(m | {"segments": [self._write(df)]})

    def _union(self, segments: list[dict]) -> DataFrame:
        """All segments, those of one schema in one scan."""
        paths: dict[str, list[str]] = {}
        for s in segments:
            paths.setdefault(s["schema"], []).append(f"{self.dir}/{s['name']}")
        return union([self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*own) for schema, own in paths.items()])

    def read(self) -> DataFrame | None:
        segments = self.manifest()["segments"]
        return self._union(segments) if segments else None

    def destroy(self) -> None:
        with self.lock:
            self._fs.delete(self._path(self.dir), True)


class MemoryStore:
    """The "inmemory" adapter: frames that live as long as the handle."""

    def __init__(self, spark: SparkSession, root: str, name: str, columns: list[dict] | None):
        self.spark, self.frame, self.next, self.lock, self.columns = spark, None, 0, threading.RLock(), columns or []

    def manifest(self) -> dict:
        return {"columns": self.columns, "next": self.next}

    def append(self, df: DataFrame, n: int) -> None:
        with self.lock:
            df = df.withColumn(SEQ, F.col(SEQ) + self.next)
            self.frame = df if self.frame is None else union([self.frame, df])
            self.next += n

    def replace(self, df: DataFrame) -> None:
        with self.lock:
            self.frame = df

    def read(self) -> DataFrame | None:
        return self.frame

    def destroy(self) -> None:
        self.frame = None


STORES = {"fs": ParquetStore, "indexeddb": ParquetStore, "localstorage": ParquetStore, "inmemory": MemoryStore}


def _as_variant(df: DataFrame, name: str) -> DataFrame:
    kind = df.schema[name].dataType
    if isinstance(kind, T.VariantType):
        return df
    boxed = F.try_variant_get(F.parse_json(F.to_json(F.struct(F.col(f"`{name}`").alias("v")))), "$.v", "variant")
    return df.withColumn(name, boxed)


def union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a field whose types clash becomes a variant in all of them, numbers widen."""
    kinds: dict[str, set] = {}
    for f in frames:
        for field in f.schema:
            kinds.setdefault(field.name, set()).add(field.dataType)
    for name, ks in kinds.items():
        ks = {k for k in ks if not isinstance(k, T.NullType)}
        if len(ks) > 1 and all(isinstance(k, T.NumericType) for k in ks):
            frames = [f.withColumn(name, F.col(f"`{name}`").cast("double")) if name in f.columns else f for f in frames]
        elif len(ks) > 1:
            frames = [_as_variant(f, name) if name in f.columns else f for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _kind(x: Any) -> str:
    if isinstance(x, bool):
        return "bool"
    if isinstance(x, (int, float)):
        return "number"
    return "time" if isinstance(x, (datetime.datetime, datetime.date)) else type(x).__name__


def rows_frame(spark: SparkSession, rows: list[dict], columns: list[dict]) -> DataFrame:
    """Documents as a frame with an order number; fields of mixed types are variants, declared date fields timestamps."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    if any(not isinstance(r, dict) for r in rows):
        raise TypeError("documents are dicts")
    mixed = {n for n in names if len({_kind(r[n]) for r in rows if r.get(n) is not None}) > 1}
    mixed |= {n for n in names if any(isinstance(r.get(n), dict) and _ragged(r[n] for r in rows if isinstance(r.get(n), dict)) for r in rows)}
    dates = {c["title"] for c in columns if c.get("type") in ("date", "datetime")} & set(names) - mixed
    floats = {n for n in names if n not in mixed and any(isinstance(r.get(n), float) for r in rows)}
    fixed = []
    for i, r in enumerate(rows):
        out = {SEQ: i}
        for n in names:
            x = r.get(n)
            if n in mixed and n in r:
                x = json.dumps(x, default=str)
            elif n in floats and x is not None:
                x = float(x)
                if x != x:
                    raise ValueError("NaN is not a value of a document")
            out[n] = x
        fixed.append(out)
    first = lambda n: next((r[n] for r in fixed if r.get(n) is not None), None)
    fields = [T.StructField(SEQ, T.LongType())]
    for n in names:
        x = first(n)
        fields.append(T.StructField(n, T.StringType() if n in mixed or x is None else _type_of([r[n] for r in fixed if r[n] is not None])))
    df = spark.createDataFrame([tuple(r[f.name] for f in fields) for r in fixed], T.StructType(fields))
    for n in mixed:
        df = df.withColumn(n, F.parse_json(F.col(f"`{n}`")))
    for n in dates:
        kind = df.schema[n].dataType
        if isinstance(kind, T.StringType):
            df = df.withColumn(n, F.try_to_timestamp(F.col(f"`{n}`")))
        elif isinstance(kind, T.NumericType):
            df = df.withColumn(n, F.timestamp_millis(F.col(f"`{n}`").cast("bigint")))
    return df


def _ragged(docs) -> bool:
    """Whether one field of these objects has several kinds of values."""
    seen: dict[str, set] = {}
    for d in docs:
        for k, x in d.items():
            if x is not None:
                seen.setdefault(k, set()).add(_kind(x))
    return any(len(ks) > 1 for ks in seen.values())


def _type_of(xs: list[Any]) -> T.DataType:
    """The type of all of xs, objects with all their keys."""
    x = xs[0]
    if isinstance(x, bool):
        return T.BooleanType()
    if all(isinstance(v, int) for v in xs):
        return T.LongType()
    if isinstance(x, (int, float)):
        return T.DoubleType()
    if isinstance(x, str):
        return T.StringType()
    if isinstance(x, datetime.datetime):
        return T.TimestampType()
    if isinstance(x, datetime.date):
        return T.DateType()
    if isinstance(x, (bytes, bytearray)):
        return T.BinaryType()
    if isinstance(x, dict):
        keys = list(dict.fromkeys(k for d in xs for k in d))
        full = lambda k: [d[k] for d in xs if d.get(k) is not None]
        return T.StructType([T.StructField(k, _type_of(full(k)) if full(k) else T.StringType()) for k in keys])
    items = [v for a in xs for v in a if v is not None]
    return T.ArrayType(_type_of(items) if items else T.StringType())
