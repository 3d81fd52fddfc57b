"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of digits, a-z and characters outside ASCII, after A-Z is lower-cased. Both sides are cut the same way:
hashes of K = 8 consecutive words, of which each window of W = 6 neighbours keeps the smallest. A shared span of
K + W - 1 = 13 words holds one whole window, so both sides keep its smallest hash: no shared span of 13 words is
missed. Of neighbouring windows with one smallest hash a document keeps the first, and each that is W or more behind
another with that hash. Kept hashes are joined with the benchmark's; a hit is extended by holding the 13 words of the
benchmark's window against the words around it, each alignment in turn, so hash collisions leave nothing behind.
Items of fewer than 13 words are one window of their own length, looked up by the hash of all words of that length.

Only hashes that the join keeps go on to the shuffle; windows of the benchmark are broadcast while they are at most
broadcast_windows, beyond that they are joined by shuffle. Hits are gathered for each document as sets of starts.

Null or empty texts have no words: n_hit 0 and not contaminated. One row comes back for each row of documents; rows
that repeat both id and text are judged together and come back as often as they came. Repeated items count once by
item_id; an item with a null id marks words, but is not listed. An empty benchmark leaves all clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import ascii_lower, small_enough

K, W = 8, 6
SPAN = K + W - 1
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def _paired(c: str, apart: int, length: int, how) -> Column:
    """how(x[i], x[i + apart]) for all i; length: of the words, less what c already spans."""
    n = F.greatest(F.size(c) - apart, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, F.lit(apart + 1), n), how)


def winnowed(df: DataFrame, words: str) -> DataFrame:
    """Adds least: for each start of SPAN words the smallest of its W hashes of K words."""
    mixed, least = lambda a, b: F.xxhash64(a, b), lambda a, b: F.least(a, b)
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    for apart in (1, 2, 4):  # 2, 4, 8 words
        df = df.withColumn("_h", _paired("_h", apart, 0, mixed))
    for apart in (1, 2, 2):  # 2, 4, 6 neighbours
        df = df.withColumn("_h", _paired("_h", apart, 0, least))
    return df.withColumnRenamed("_h", "least")


def _windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """One row for each distinct window of the benchmark: fp, win (its words), items (ids).

    The explode is an outer one, as a plain one has a filter inferred below it that repeats the nested hash expressions.
    """
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    long = winnowed(items.filter(F.size("w") >= SPAN), "w").select("item", "w", F.posexplode_outer("least").alias("at", "fp")).filter("fp is not null")
    long = long.select("item", "fp", F.slice("w", F.col("at") + 1, F.lit(SPAN)).alias("win"))
    short = items.filter(F.size("w") < SPAN).select("item", F.xxhash64("w", F.size("w")).alias("fp"), F.col("w").alias("win"))
    return long.union(short).groupBy("fp", "win").agg(F.collect_set("item").alias("items"))


def _short_windows(k: int) -> Column:
    """All k words in a row of a document, by the hash that items of k words have."""
    starts = F.when(F.col("n") >= k, F.sequence(F.lit(0), F.col("n") - k)).otherwise(F.array().cast("array<int>"))

    def window(i: Column) -> Column:
        own = F.slice("w", i + 1, F.lit(k))
        return F.struct(F.xxhash64(own, F.lit(k)).alias("fp"), i.alias("at"), own.alias("near"))

    return F.transform(starts, window)


def find_contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_windows: int = 200_000) -> DataFrame:
    """Per document: id_col, text_hash, n_words, n_hit, items (sorted ids as strings), spans (start and end of each run of hit words).

    text_hash: xxhash64 of the text as it stands, which tells rows with one id apart.
    """
    windows = _windows(benchmark, item_col, item_text_col).withColumnRenamed("fp", "item_fp")
    lengths = sorted(r[0] for r in windows.select(F.size("win").alias("n")).distinct().collect() if r[0] < SPAN)  # 12 at most
    if small_enough(windows, broadcast_windows):
        windows = F.broadcast(windows)

    d = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", F.xxhash64("text").alias("same"), words_of(F.col("text")).alias("w"))
    d = winnowed(d, "w").withColumn("n", F.size("w"))
    least = F.col("least")
    places = F.filter(F.transform(least, lambda x, i: F.when((i == 0) | (x != F.get(least, i - 1)) | (x == F.get(least, i - W)), i)), lambda i: i.isNotNull())
    d = d.withColumn("at", places)
    found = [F.transform("at", lambda i: F.struct(F.get(least, i).alias("fp"), i.alias("at"), F.slice("w", i + 1, F.lit(SPAN + W - 1)).alias("near")))]
    found += [_short_windows(n) for n in lengths]
    #: so that a document without any hash still has a row
    head = F.array(F.struct(F.lit(None).cast("bigint").alias("fp"), F.lit(-1).alias("at"), F.lit(None).cast("array<string>").alias("near")))
    rows = d.select("id", "same", "n", F.explode_outer(F.concat(head, *found)).alias("x")).select("id", "same", "n", "x.fp", "x.at", "x.near")

    hits = rows.join(windows, F.col("fp") == F.col("item_fp"), "left").filter("at = -1 or win is not null")
    n = F.size("win")
    offsets = F.filter(F.sequence(F.lit(0), F.greatest(F.size("near") - n, F.lit(0))), lambda j: F.slice("near", j + 1, n) == F.col("win"))
    spans = F.transform(offsets, lambda j: F.struct((F.col("at") + j).alias("start"), (F.col("at") + j + n).alias("end")))
    hits = hits.select("id", "same", "n", "at", F.when(F.col("at") >= 0, spans).alias("spans"), "items").filter("at = -1 or size(spans) > 0")
    hits = hits.groupBy("id", "same", "n").agg(F.sum((F.col("at") == -1).cast("int")).alias("times"), F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"))
    runs_type = "array<struct<start:int,end:int>>"

    def grown(runs: Column, s: Column) -> Column:
        """runs, with the last one grown by s if they touch."""
        last = F.element_at(runs, -1)
        touch = (F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["end"] >= s["start"])
        longer = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")))
        return F.when(touch, F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), longer)).otherwise(F.concat(runs, F.array(s)))

    hits = hits.withColumn("spans", F.array_sort(F.array_distinct(F.flatten("spans"))))
    hits = hits.withColumn("spans", F.aggregate("spans", F.array().cast(runs_type), grown))
    hits = hits.withColumn("items", F.array_sort(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + (s["end"] - s["start"]))
    hits = hits.select("id", "same", "n", "times", "spans", "items", n_hit.alias("n_hit"))
    hits = hits.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return hits.select(F.col("id").alias(id_col), F.col("same").alias("text_hash"), F.col("n").cast("bigint").alias("n_words"), "n_hit", "items", "spans")


def contaminated(found: DataFrame, one_in: int = 20) -> Column:
    """A document is contaminated where at least one word in so many is hit."""
    return (found["n_hit"] > 0) & (one_in * found["n_hit"] >= found["n_words"])
