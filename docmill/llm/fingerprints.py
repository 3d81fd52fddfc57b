"""Document fingerprints by I-Match over randomised subsets of the lexicon, in DataFrame functions only.

The lexicon holds the terms whose document frequency lies in a band (rare_share to common_share of all documents), so
it has at most (mean number of distinct terms) / rare_share terms, whatever the size of the corpus; it is broadcast
while it has at most broadcast_terms, beyond that it is joined by shuffle. Of a document the distinct terms that are
in the lexicon are kept, put in order and hashed once for each of 64 random subsets of the lexicon: 16 subsets on each
of four levels, which take a 16th, a 64th, a 256th and a 1024th of the lexicon. A subset changes its hash only if one
of its terms comes or goes, so short documents are told apart on the first level and long ones on the last.

A fingerprint is 64 groups of four hexadecimal digits, 0000 where a subset has no term. Likeness of two fingerprints:
1 if they are equal; else the largest share, over the levels on which either has LEAST subsets with terms (the first
level if none has), of equal ones among these. Documents without any term in the lexicon, short or long, are hashed over
all their terms, with "f" behind the last group. Terms are looked up by 64 bits of a hash, those that a text shares with
its edited one only once.

The order of documents is that of their keys: (id is not null, id, hash of the text). Distinct keys, without texts, are
range-partitioned and numbered inside partitions, and the last of a partition is followed by the first of the next; what
is sorted or gathered in one task is a range of keys, or one key for each partition. Texts meet by joins on keys.

Null texts are empty, and texts without terms have a fingerprint of zeros. Repeated rows come back one for each row; rows
with one id stand in the order of their texts' hashes, null ids before all others. Very long texts are cut into words
like others. Columns of other names are left out. An empty table has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import small_enough, written
from docmill.llm.decontaminate import words_of

LEVELS, SUBSETS, LEAST = (4, 6, 8, 10), 16, 6
KEY = ["has_id", "id", "h"]


def lexicon(texts: DataFrame, *, text_col: str = "text", rare_share: float = 1 / 1000, common_share: float = 1 / 20) -> DataFrame:
    """term, count: those in the band of document frequency over all texts."""
    n = texts.count()
    terms = texts.select(F.explode_outer(F.array_distinct(words_of(F.col(text_col)))).alias("term")).filter("term is not null")
    frequent = terms.groupBy("term").count()
    return frequent.filter((F.col("count") >= rare_share * n) & (F.col("count") <= max(common_share * n, 1)))


def _after(keys: DataFrame) -> DataFrame:
    """KEY and n_* of the next key (after the last: the first) of distinct keys, beside their other columns."""
    placed = written(keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()), "keys")
    heads = placed.groupBy("part").agg(F.min(F.struct(*KEY)).alias("head"))
    order = Window.orderBy("part")  # a row for each partition
    first = F.min_by("head", "part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("part").alias("p"), F.coalesce(F.lead("head").over(order), first).alias("head"))
    inside = F.lead(F.struct(*KEY)).over(Window.partitionBy("part").orderBy(*KEY))
    out = placed.withColumn("after", inside).join(F.broadcast(heads), F.col("part") == F.col("p"))  # a row for each partition
    follows = F.coalesce("after", "head")
    return out.select(*[c for c in keys.columns], *[follows[c].alias(f"n_{c}") for c in KEY])


def edited_texts(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """KEY, copy (from 1, of equal rows), last (whether it is the last of these), n_* (the key of the next document), text,
    n_chars, edited: the last quarter replaced by the start of the next document, which of equal rows is the next of them."""
    text, own = F.coalesce(text_col, F.lit("")), F.col(id_col).cast("bigint")
    docs = documents.select(own.isNotNull().alias("has_id"), F.coalesce(own, F.lit(0)).cast("bigint").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    keys = written(_after(docs.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first(quarter).alias("k"))), "order")
    texts = docs.groupBy(*KEY).agg(F.first("text").alias("text"))
    wanted = keys.select(*[F.col(f"n_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"of_{c}") for c in KEY], F.col("k").alias("of_k"))
    heads = texts.join(wanted, KEY).select(*[F.col(f"of_{c}").alias(c) for c in KEY], F.col("text").substr(F.lit(1), F.col("of_k")).alias("head"))
    out = texts.join(keys, KEY).join(heads, KEY).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    out = out.withColumn("last", F.col("copy") == F.col("copies")).withColumn("n_chars", F.char_length("text"))
    start = F.when(F.col("last"), F.col("head")).otherwise(F.col("text").substr(F.lit(1), F.col("k")))
    return out.select(*KEY, "copy", "last", *[f"n_{c}" for c in KEY], "text", "n_chars", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars") - F.col("k")), start).alias("edited"))


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def _level(terms: Column, shift: int, bits: int) -> Column:
    """The 16 groups of one level."""

    def slot(x: Column) -> Column:
        return F.shiftright(x, shift).bitwiseAND(F.lit((1 << bits) - 1))

    def hashed(own: Column) -> Column:
        return F.when(F.size(own) > 0, F.lpad(F.hex(F.pmod(F.xxhash64(own), F.lit(65535)) + 1), 4, "0")).otherwise("0000")

    places = F.sequence(F.lit(0).cast("bigint"), F.lit(SUBSETS - 1).cast("bigint"))
    groups = lambda few: F.transform(places, lambda j: _let(F.filter(few, lambda x: slot(x) == j), hashed))
    return F.array_join(_let(F.filter(terms, lambda x: slot(x) < SUBSETS), groups), "")


def _groups(terms: str) -> Column:
    """The 64 groups of a sorted array of term hashes."""
    return _let(F.col(terms), lambda t: F.lower(F.concat(*[_level(t, sum(LEVELS[:i]), bits) for i, bits in enumerate(LEVELS)])))


def likeness(x: str, y: str) -> Column:
    """Of two fingerprints, 0 to 1."""
    shares = []
    for level in range(len(LEVELS)):
        places = F.sequence(F.lit(1 + 64 * level), F.lit(1 + 64 * level + 4 * (SUBSETS - 1)), F.lit(4))
        group = lambda c, i: F.substring(c, i, F.lit(4))
        full = F.size(F.filter(places, lambda i: (group(F.col(x), i) != "0000") | (group(F.col(y), i) != "0000")))
        same = F.size(F.filter(places, lambda i: (group(F.col(x), i) != "0000") & (group(F.col(x), i) == group(F.col(y), i))))
        shares.append(F.when(full >= (LEAST if level else 1), same / full))
    best = reduce(lambda a, b: F.greatest(a, b), shares[1:], F.when(F.lit(True), shares[0]))
    return F.when(F.col(x) == F.col(y), 1.0).otherwise(F.coalesce(best, F.lit(0.0)))


def _finished(prints: DataFrame, id_col: str) -> DataFrame:
    """Likeness to the edited text and to the next document."""
    follows = prints.filter(F.col("copy") == 1).select(*[F.col(c).alias(f"n_{c}") for c in KEY], F.col("fingerprint").alias("after"))
    out = prints.join(follows, [f"n_{c}" for c in KEY]).withColumn("next", F.when(F.col("last"), F.col("after")).otherwise(F.col("fingerprint")))
    out = out.withColumn("near_edited", likeness("fingerprint", "edited_fingerprint")).withColumn("near_next", likeness("fingerprint", "next"))
    return out.select(F.when(F.col("has_id"), F.col("id")).alias(id_col), F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rare_share: float = 1 / 1000, common_share: float = 1 / 20, broadcast_terms: int = 500_000) -> DataFrame:
    """Per document: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    band = written(lexicon(documents, text_col=text_col, rare_share=rare_share, common_share=common_share).select(F.xxhash64("term").alias("known")).distinct(), "lexicon")
    terms = F.broadcast(band) if small_enough(band, broadcast_terms) else band
    docs = edited_texts(documents, id_col=id_col, text_col=text_col)
    row, rest = [*KEY, "copy"], ["last", *[f"n_{c}" for c in KEY], "n_chars"]
    hashed = lambda c: F.array_distinct(F.transform(words_of(F.col(c)), lambda w: F.xxhash64(w)))
    docs = docs.select(*row, *rest, F.sha2("edited", 256).alias("edited_sha256"), hashed("text").alias("own"), hashed("edited").alias("edited"))
    # the terms of both texts once, behind one element that carries the row's other values past the look-up
    whole = F.struct(*rest, "edited_sha256", "own", "edited")
    nothing = F.lit(None).cast(docs.select(whole.alias("x")).schema["x"].dataType)
    head = F.array(F.struct(F.lit(None).cast("bigint").alias("term"), whole.alias("rest")))
    each = docs.select(*row, F.explode(F.concat(head, F.transform(F.array_union("own", "edited"), lambda x: F.struct(x.alias("term"), nothing.alias("rest"))))).alias("x"))
    each = each.select(*row, "x.term", "x.rest").join(terms, F.col("term") == F.col("known"), "left").filter("known is not null or term is null")
    sets = each.groupBy(*row).agg(F.first("rest", ignorenulls=True).alias("rest"), F.collect_list("known").alias("known"))
    sets = sets.select(*row, "rest.*", "known")
    for name in ("own", "edited"):
        sets = sets.withColumn(f"in_{name}", F.array_intersect(name, "known")).withColumn(f"used_{name}", F.array_sort(F.when(F.size(f"in_{name}") > 0, F.col(f"in_{name}")).otherwise(F.col(name))))
    marked = lambda name: F.concat(_groups(f"used_{name}"), F.when((F.size(f"in_{name}") == 0) & (F.size(name) > 0), F.lit("f")).otherwise(F.lit("")))
    prints = sets.select(*row, *rest, "edited_sha256", marked("own").alias("fingerprint"), marked("edited").alias("edited_fingerprint"))
    return _finished(written(prints, "prints"), id_col)
