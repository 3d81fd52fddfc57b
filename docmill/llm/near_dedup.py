"""Near-duplicate detection by min-max hashing: of each permutation both the minimum and the maximum are kept.

A document's set holds the hashes of its distinct five-word shingles. 72 permutations give 144 values; three permutations
make a band of six values, so documents with similarity s share one of the 24 bands but for (1 - s^6)^24 of them:
1e-5 at 0.85, 7e-4 at 0.8, and two of similarity 0.3 meet in one of 57 cases. Every pair that is looked at is confirmed
on the full sets.

Exact copies (equal sets) are one class from the start, a node of the graph of links, whatever the ids of its rows. Buckets of a band are never
expanded into pairs. First every member of a bucket is held against one pivot, and what is linked forms components.
Buckets of more than BLOCK members that still hold several components get PIVOTS more pivots, ROUNDS times; members of a
pivot's own component need no look. Buckets that are open after that are compared set by set, as far as members are in
different components: buckets with members in common are gathered in clusters, so that each set is sent once, and of a
cluster of more than CLUSTER members each bucket on its own, dealt into blocks of which each two meet. That is the exact
way for what the pivots leave. All that is gathered are links; components are joins of written tables.

Null or empty texts have an empty set and are linked with nothing, not even with each other. Rows with a null id are
returned on their own (component null, kept true). Rows that repeat an id are judged each by its own text; text_hash
(xxhash64 of the text) tells them apart. Long texts are shingled whole, a few at a time. Other columns, of whatever name,
are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm import shingles
from docmill.llm.common import bit_filter, in_filter, in_arrow, slices, written
from docmill.llm.components import components, extended

PERMUTATIONS, BANDS, BLOCK, ROUNDS, PIVOTS, CLUSTER = 72, 24, 256, 1, 4, 4096
_rng = np.random.Generator(np.random.PCG64(20240501))
_A = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BANDS) keys; each set must have an element."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    per = PERMUTATIONS // BANDS
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), np.uint64(band + 1), np.uint64) * shingles._C
        for p in range(band * per, band * per + per):
            v = flat * _A[p]
            v += _B[p]
            key = shingles.mix(key * shingles._C + np.minimum.reduceat(v, at))
            key = shingles.mix(key * shingles._C + np.maximum.reduceat(v, at))
        keys[:, band] = key
    return keys


def _content(s: np.ndarray) -> bytes | None:
    """What equal sets have in common; None of an empty one."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw = [x or b"" for x in batch.column("text").to_pylist()]
        for lo, hi in shingles.in_parts(raw):
            sets = shingles.shingle_sets(raw[lo:hi])
            full = [s for s in sets if len(s)]
            keys = band_keys(full).view(np.int64).reshape(-1) if full else np.empty(0, np.int64)
            ends = np.cumsum([0] + [BANDS * bool(len(s)) for s in sets])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys))
            own = [batch.column(c).slice(lo, hi - lo) for c in ("id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(map(_content, sets), pa.binary()), bands], names=["id", "text_hash", "n", "same", "bands"])


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, set of the wanted (rep, same, id). A filter of bounded size drops most other texts where they are read, the join the rest."""
    held = texts.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(F.xxhash64("rep").alias("h"))))

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(in_filter(batch.column("h").to_numpy(zero_copy_only=False), held.value)))
            raw = [x or b"" for x in batch.column("text").to_pylist()]
            for lo, hi in shingles.in_parts(raw):
                sets = shingles.shingle_sets(raw[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(map(_content, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["same", "set"])

    sets = in_arrow(texts.select("text", F.xxhash64("id").alias("h")), with_sets, "same binary, set binary")
    return sets.join(wanted.select("same", "id"), "same").dropDuplicates(["id"]).select("id", "set")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * |x and y| >= percent * |x or y|; both sorted and distinct."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that are alike."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            xs, ys = batch.column("x"), batch.column("y")
            good = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(xs, ys, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    return in_arrow(full.select("a", "b", "x", "y"), confirm, "a bigint, b bigint")


class Forest:
    """Components that grow as links come."""

    def __init__(self, labels):
        self.root = {label: label for label in labels}

    def find(self, x):
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def joins(self, x, y) -> bool:
        """Whether a link between x and y joins two components, which from then on are one."""
        p, q = self.find(x), self.find(y)
        self.root[max(p, q)] = min(p, q)
        return p != q


def _links_among(rows: np.ndarray, sets: list[np.ndarray], labels: list, forest: Forest, percent: int) -> list[tuple[int, int]]:
    """Links between these rows that join components."""
    out, sizes = [], np.array([len(sets[i]) for i in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, codes = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)
    marked = np.zeros(codes.max() + 1, np.int64)
    for i in range(1, len(rows)):
        own = codes[starts[i] : starts[i] + sizes[i]]
        marked[own] = 1
        common = np.add.reduceat(marked[codes[: starts[i]]], starts[:i])
        marked[own] = 0
        for j in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes[:i] - common)).tolist():
            if forest.joins(labels[rows[i]], labels[rows[j]]):
                out.append((rows[i], rows[j]))
    return out


def _compare(members: DataFrame, sets: DataFrame, percent: int, by: list[str]) -> DataFrame:
    """Links that join components, among members (id, label, keys) of one group and bucket."""

    def compare(group: pa.Table) -> pa.Table:
        ids, labels = group.column("id").to_pylist(), group.column("label").to_pylist()
        sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("set")]
        buckets: dict[int, list[int]] = {}
        for i, keys in enumerate(group.column("keys").to_pylist()):
            for key in keys:
                buckets.setdefault(key, []).append(i)
        forest, out = Forest(labels), []
        for rows in sorted(buckets.values(), key=len):
            if len({forest.find(labels[i]) for i in rows}) > 1:
                out += _links_among(np.array(rows), sets_, labels, forest, percent)
        return pa.table([pa.array([ids[i] for i, _ in out], pa.int64()), pa.array([ids[j] for _, j in out], pa.int64())], names=["a", "b"])

    return members.join(sets, "id").groupBy(*by).applyInArrow(compare, "a bigint, b bigint")


def _compare_open(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join components, among members of one open bucket (key, id, label, n).

    Members of small clusters go to one task each; of a large bucket every member goes to all pairs of blocks that its
    block is in, so that each two members meet once or more, in groups of 2 * BLOCK on average.
    """
    first = members.groupBy("key").agg(F.min("id").alias("first"))
    near = members.join(first, "key").filter("id != first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    clusters = components(written(near, "near"), "clusters").select(F.col("v").alias("id"), F.col("label").alias("cluster"))
    sized = clusters.groupBy("cluster").agg((F.count("*") <= CLUSTER).alias("small"))
    members = written(members.join(clusters.join(sized, "cluster"), "id"), "clustered")
    small = members.filter("small").groupBy("cluster", "id", "label").agg(F.collect_list("key").alias("keys"))
    large = members.filter("not small").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "label", F.array("key").alias("keys"))
    return _compare(small, sets, percent, ["cluster"]).union(_compare(large, sets, percent, ["key", "i", "j"]))


def _finish(buckets: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """The components of all links: first more pivots for the large buckets, then pairs of blocks."""
    labels = components(links)
    open_ = buckets.filter("n > 2").select("key", "id", "n")
    for k in range(ROUNDS + 1):
        labelled = open_.join(labels, F.col("id") == F.col("v"), "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
        drawn = [F.min_by(F.struct("id", "label"), F.xxhash64("id", F.lit(k * PIVOTS + j))) for j in range(PIVOTS)]
        several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.array_distinct(F.array(*drawn)).alias("pivots")).filter("lo != hi")
        labelled = written(labelled.join(several.select("key", "pivots"), "key"), "open")
        open_ = labelled.select("key", "id", "n")
        large = labelled.filter(F.col("n") > BLOCK)
        if k == ROUNDS or large.isEmpty():
            break
        pairs = large.select("id", "label", F.explode("pivots").alias("p")).filter("p.label != label").select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b"))
        labels = extended(labels, written(_confirm(pairs.distinct(), sets, percent), "links"))
    if not labelled.isEmpty():
        labels = extended(labels, written(_compare_open(labelled.select("key", "id", "label", "n"), sets, percent), "links"))
    return labels


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Per document: id_col, n_shingles, component_id, kept, text_hash. Linked where 100 * |both| >= percent * |either|."""
    kind = documents.schema[id_col].dataType.simpleString()
    texts = documents.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    signed = in_arrow(texts, _signed, f"id {kind}, text_hash bigint, n bigint, same binary, bands array<bigint>")
    signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    some = signed.filter("same is not null and id is not null")
    classes = written(some.groupBy("same").agg(F.min("id").alias("rep"), F.min_by("row", "id").alias("id"), F.first("n").alias("size"), F.min_by("bands", "id").alias("bands")), "classes")

    members = classes.select(F.explode("bands").alias("key"), "id", "size")
    who = [F.sum(F.xxhash64("id", F.lit(seed)).cast("decimal(20,0)")).alias(f"who_{seed}") for seed in (1, 2)]
    shared = members.groupBy("key").agg(F.min_by(F.struct("id", "size"), "id").alias("pivot"), F.count("*").alias("n"), *who).filter("n > 1")
    shared = shared.groupBy("pivot", "n", "who_1", "who_2").agg(F.min("key").alias("key"))  # one of the bands that hold the same members
    buckets = written(members.join(shared.select("key", "pivot", "n"), "key"), "buckets")
    fits = 100 * F.least("size", "pivot.size") >= percent * F.greatest("size", "pivot.size")  # sets of other sizes can't be alike
    pairs = written(buckets.filter(F.col("id") != F.col("pivot.id")).filter(fits).select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    wanted = buckets.select("id").distinct()
    sets = written(_sets_of(texts, written(wanted.join(classes.select("id", "rep", "same"), "id"), "wanted")), "sets")
    links = written(_confirm(pairs, sets, percent), "links")

    labels = _finish(buckets, sets, links, percent)

    named = labels.join(classes.select(F.col("id").alias("v"), "rep", "same"), "v")
    smallest = named.groupBy("label").agg(F.min("rep").alias("least"))
    by_class = classes.select("same", "rep").join(named.join(smallest, "label").select(F.col("same").alias("linked"), "least"), F.col("same") == F.col("linked"), "left")
    by_class = by_class.select("same", F.coalesce("least", "rep").alias("label"))
    out = signed.select("id", "n", "same", "text_hash").join(by_class, "same", "left")
    label = F.coalesce("label", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), label).alias("component_id"), F.coalesce(label == F.col("id"), F.lit(True)).alias("kept"), "text_hash")
