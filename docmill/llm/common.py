"""What several operators share: reading a table, shared folders, ASCII lower case."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; letters outside ASCII stay as they are."""
    return F.translate(c, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='docmill-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: what operators keep in a worker between tasks: by name, how to drop it
MODELS: dict = {}


def tidy(keeps: str | None = None) -> None:
    """Drops all models of this worker but those named, and gives memory that is free back to the machine."""
    for name, drop in MODELS.items():
        if name != keeps:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def in_arrow(df: DataFrame, f, schema: str, keeps: str | None = None) -> DataFrame:
    """df.mapInArrow(f, schema) with small batches, in workers that hold only the models in `keeps`.

    From now on the session hands its Python workers 512 rows or 4 MB at once at most, where it allowed more: batches of
    long texts stay small on both sides. Workers live on after a task, so what it leaves behind would add up.
    """
    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= 512:
        conf.set(rows, 512)
    if conf.get(size) == "67108864b":  # as Spark sets it
        conf.set(size, "4m")

    def run(batches):
        from docmill.llm import common

        common.tidy(keeps)
        yield from f(batches)
        common.tidy(keeps)

    return df.mapInArrow(run, schema)


def collect_garbage(spark: SparkSession) -> None:
    """Has the driver drop the shuffle files of frames that nothing holds any more, which else stay until it happens to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def kept_names(keep, own) -> list[str]:
    """Names under which kept columns come back: with "_in" behind them where they are those of our columns."""
    taken, out = {x.lower() for x in [*own, *keep]}, []
    for name in keep:
        new = name
        while new.lower() in {x.lower() for x in own} or new != name and new.lower() in taken:
            new += "_in"
        taken.add(new.lower())
        out.append(new)
    return out


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


SHIFTS = (0, 12, 24, 36)


def bit_filter(hashes: DataFrame, most_bits: int = 1 << 28) -> np.ndarray:
    """Bytes of a Bloom filter of hashes (one bigint column, h, whose bits are all random): four bits of each are set.

    It has 16 bits for each hash, rounded up to a power of two, and most_bits at most (32 MB as it stands): that is the
    most that is sent around, however many hashes there are. in_filter() may say yes to a hash that isn't there, in one of
    400 cases below that bound, so what it lets through is still held together by exact values.
    """
    bits = min(max(1 << 12, 1 << (16 * hashes.count()).bit_length()), most_bits)
    places = F.array(*[F.shiftrightunsigned("h", n).bitwiseAND(F.lit(bits - 1)) for n in SHIFTS])
    place = hashes.select(F.explode(places).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("mask"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["mask"]
    return out.view(np.uint8)


def in_filter(hashes, held: np.ndarray) -> np.ndarray:
    """For each hash whether the filter has it."""
    h, mask = np.asarray(hashes, np.int64).view(np.uint64), np.uint64(8 * len(held) - 1)
    out = np.ones(len(h), bool)
    for n in SHIFTS:
        place = h >> np.uint64(n) & mask
        out &= (held[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def slices(batches, rows: int = 512):
    """Arrow batches of at most so many rows, so that what is made of them stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
