"""Token counts from one exact histogram of encoded lengths.

Documents are aggregated by the number of their ids; everything else follows from suffix sums over the histogram. For
a context limit L: documents of at least L ids, their ids, and the ids left when each document is cut at L
(sum of min(length, L) = ids of the shorter ones + L * documents of L or more). The share of documents of at most L
ids gives every quantile. The histogram is written once, so that texts are encoded once. The sums run inside spans of
SPAN lengths, and over the totals of the spans, so no task sees more than SPAN lengths or one row a span.

Null texts are empty: length 0. Repeated rows count as often as they come; ids and other columns, of whatever name, aren't
looked at. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm import tokens
from docmill.llm.common import in_arrow, slices, written

SPAN = 1024


def token_lengths(documents: DataFrame, tokenizer: str, *, text_col: str = "text") -> DataFrame:
    """n_tokens of every row."""
    width = tokens.width_of(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.pieces(tokenizer, width).encode
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(x.as_py() or "")) // width for x in batch.column(0)], pa.int64())], names=["n_tokens"])

    return in_arrow(documents.select(F.col(text_col).alias("text")), count, "n_tokens bigint", "tokens")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per length that occurs: n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_total, share_at_most."""
    hist = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "histogram").withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    hist = hist.withColumn("ids", F.col("n_tokens") * F.col("n_docs"))
    totals = hist.groupBy("span").agg(F.sum("n_docs").alias("span_docs"), F.sum("ids").alias("span_ids"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each SPAN lengths
    whole = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("bigint")
    totals = totals.select(F.col("span").alias("s"), F.coalesce(F.sum("span_docs").over(later), none).alias("docs_later"), F.coalesce(F.sum("span_ids").over(later), none).alias("ids_later"), F.sum("span_docs").over(whole).alias("all_docs"), F.sum("span_ids").over(whole).alias("all_ids"))
    here = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("docs_here", F.sum("n_docs").over(here)).withColumn("ids_here", F.sum("ids").over(here))
    hist = hist.join(totals, F.col("span") == F.col("s"))
    docs, ids = F.col("docs_here") + F.col("docs_later"), F.col("ids_here") + F.col("ids_later")
    return hist.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), ids.alias("tokens_at_least"),
        (F.col("all_ids") - ids + F.col("n_tokens") * docs).alias("truncated_total"),
        ((F.col("all_docs") - docs + F.col("n_docs")).cast("double") / F.col("all_docs")).alias("share_at_most"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each limit: docs_longer, truncated_total. Limits need not occur as lengths."""
    each = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits]))
    longer = F.sum(F.when(F.col("n_tokens") > F.col("context"), F.col("n_docs")).otherwise(0))
    cut = F.sum(F.least("n_tokens", "context") * F.col("n_docs"))
    return histogram.select("n_tokens", "n_docs", each.alias("context")).groupBy("context").agg(longer.alias("docs_longer"), cut.alias("truncated_total"))


def quantile(histogram: DataFrame, q: float) -> Column:
    """An aggregate over a histogram: the least length that a share of q of the documents doesn't pass."""
    return F.min(F.when(F.col("share_at_most") >= q, F.col("n_tokens")))
