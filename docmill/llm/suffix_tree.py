"""LM scoring with a probabilistic suffix tree over words.

Symbols are words (A-Z lower-cased, split at ASCII white space), one end for each text, and "unknown" for all words that
training never showed. The state of the root is P(a) = (c(a) + 0.5) / (N + 0.5 * (V + 1)), a distribution over the V
known symbols and the unknown one. Contexts are the words before, up to DEPTH of them, the start of the text among them.
Every context that training shows twice or more is counted, however rare, so what is gathered grows with the corpus. A
context s of n occurrences is kept if its next-symbol distribution diverges from that of the state one word shorter:

    sum over next symbols a of c(s, a) * ln(P'(a | s) / P(a | s less its first word)) >= min_gain

where P' is the smoothed estimate without the occurrence that is looked at, so that chance doesn't pass for divergence.
Divergences are summed in whole units of 2^-20, so that no order or place of the sums shows in a verdict.
P(a | s) = (c(s, a) + K * P(a | shorter)) / (n + K), K the number of different words that follow s. A word is scored in the state of the longest kept suffix of what is before it; contexts between that and the root that
aren't kept are passed over. score is the sum of log10 P over the text's words and its end; base_score that of the root.

How it runs: documents are cut into blocks of about BLOCK words, each a row of a table that is bucketed by block, so that
the joins of each level move no text. Level by level a block asks for what its words need: each distinct pair of a
context and a next word, with how often the block's training texts have it. Requests are packed arrays, dealt by a hash
of the context; whoever gets a context counts it over all blocks, tests it, and answers with the verdict and the counts.
Deeper contexts are asked for only where the shorter one occurred twice. A context of more than `share` occurrences
(2^18, or N / 2^20 if that is more) is dealt out by next word as well: its K is the sum of what its parts count, and its
verdict that of their divergences, which are worked out once K is known, from how many words have each count and rounded
P(a | shorter). So it gets what it would get in one place, whatever the size of the input. There are at most
N / share <= 2^20 such contexts of one length; they come to the driver with their K, and the kept ones are broadcast.
A caller may have K estimated as n ** 0.9 for contexts of more than `hot` occurrences; by default none is.

Words are known by 64 bits of a hash, contexts of a bucket by 40 and next words of one context by 32 more; divergence is
computed from P(a | shorter) rounded to an eighth of a bit, scores aren't. Null texts are empty: one token, the end. Repeated rows, null ids and very
long texts (a block of their own) take the same way; one row comes back for each row. Kept columns with a name of ours
come back with "_in" behind it. Without training rows every count is 0 and every score that of an unknown word, log10(1).
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm import shingles
from docmill.llm.common import collect_garbage, in_arrow, kept_names, shared_folder, slices, written

U = np.uint64
BEGIN, END = U(0x5851F42D4C957F2D), U(0x14057B7EF767814F)
DEPTH, BLOCK, BUCKET, SHARE, HEAPS, SHARED = 3, 1 << 19, 1 << 19, 1 << 18, 0.9, 0xFFFFFFFF
UNIT = 2.0**-20  # of divergence
OWN = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
ANSWER = "block bigint, bucket int, answer binary, ctx bigint, follow bigint"


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as byte planes in one zstandard frame."""
    import zstandard

    head = struct.pack(f"<{len(arrays)}I", *map(len, arrays))
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() for a in arrays]
    return head + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    lengths = struct.unpack_from(f"<{len(kinds)}I", data)
    flat, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 * len(kinds) :]), np.uint8), [], 0
    for n, kind in zip(lengths, map(np.dtype, kinds), strict=True):
        planes = flat[at : at + n * kind.itemsize].reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * kind.itemsize
    return out


def rounded(p: np.ndarray) -> np.ndarray:
    """Probabilities as eighths of a bit."""
    return np.clip(np.rint(-8 * np.log2(p)), 0, 255).astype(np.uint8)


def escape(n: np.ndarray, follow: np.ndarray, hot: float) -> np.ndarray:
    """K of contexts of n occurrences: how many different words follow, or about how many beyond hot occurrences."""
    return np.where((follow > 0) & (n > hot), n**HEAPS, follow)


def gains(c: np.ndarray, n: np.ndarray, k: np.ndarray, code: np.ndarray) -> np.ndarray:
    """What c of n occurrences of a context (n > 1) add to its divergence, each looked at without itself, in units."""
    p, k = 2.0 ** (code.astype(float) / -8), np.maximum(k - (c == 1), 1e-9)
    return np.rint(np.where(c > 0, c * np.log((np.maximum(c - 1.0, 0.0) + k * p) / ((n - 1.0 + k) * p)), 0.0) / UNIT).astype(np.int64)


def _cells(buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """bucket, first and end of each run of a sorted array."""
    if len(buckets):
        edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(buckets)], strict=True):
            yield int(buckets[i]), i, j


def ordered(keys: np.ndarray) -> np.ndarray:
    """An order that sorts keys (unsigned, 64 bits). Their upper bits and their places are packed together and sorted as
    plain numbers, which is many times faster than argsort; runs that need the lower bits are put right after that."""
    if not len(keys):
        return np.empty(0, np.int64)
    bits, free = U((len(keys) - 1).bit_length()), U(64 - int(keys.max()).bit_length())
    both = keys << free
    both >>= bits
    both <<= bits
    both |= np.arange(len(keys), dtype=U)
    both.sort()
    if bits <= free:
        both &= (U(1) << bits) - U(1)
        return both.view(np.int64)
    order = (both & ((U(1) << bits) - U(1))).view(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):
        run = np.concatenate([[0], np.cumsum((both[1:] >> bits) != (both[:-1] >> bits))])
        odd = np.zeros(run[-1] + 1, bool)
        odd[run[wrong]] = True
        odd = odd[run]
        order[odd] = order[odd][np.argsort(found[odd], kind="stable")]
    return order


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key, from the smallest to the greatest, where one is; and for each key the number of its group."""
    order = ordered(keys)
    new, held = np.ones(len(keys), bool), keys[order]
    np.not_equal(held[1:], held[:-1], out=new[1:])
    del held
    number, group = np.cumsum(new, dtype=np.int32), np.empty(len(keys), np.int32)
    number -= 1
    group[order] = number
    return order[new], group


def bucket_of(address: np.ndarray, n_buckets: int) -> np.ndarray:
    """Ascends with the address."""
    return ((address >> U(40)) * U(n_buckets) >> U(24)).astype(np.int64)


class Asked:
    """The distinct pairs of context and next word of a block on one level, in the order of the request.

    What only a request needs is worked out with it: most are made again to read the answer."""

    def __init__(self, pos: np.ndarray, ctx: np.ndarray, hashes: np.ndarray, totals: np.ndarray, word: np.ndarray, words: np.ndarray, p: np.ndarray, weight: np.ndarray, n_buckets: int, share: int):
        """pos, ctx, word, p, weight: for each position; hashes, totals: of each context; words: hash of each word."""
        parts = np.where(totals > share, -(-totals // share), 1)
        first_part = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(parts)), parts)
        part = np.arange(len(owner)) - first_part[owner]
        address = np.where(part > 0, shingles.mix(hashes[owner] + part.astype(U) * shingles._C), hashes[owner])
        by_address = ordered(address)
        rank = np.empty(len(owner), np.int64)
        rank[by_address] = np.arange(len(owner))
        short = (words >> U(32)).astype(np.uint32)
        place, several = first_part[ctx], np.flatnonzero((parts > 1)[ctx])
        place[several] += short[word[several]] % parts[ctx[several]]
        slot = rank[place].view(U)
        del place, several
        key = slot << U(max(len(words) - 1, 1).bit_length())
        key |= word.astype(U)
        first, self.row_of = grouped(key)
        del key
        own, self.pos, self.word, self.first, self.p, self.weight = slot[first].view(np.int64), pos, word[first], first, p, weight
        del slot
        self.n, self.hash, self.short = totals[ctx[first]], hashes[ctx[first]], short[self.word]
        new = np.ones(len(first), bool)
        new[1:] = own[1:] != own[:-1]
        self.heads = np.flatnonzero(new)  # the first pair of each context
        self.sizes = np.diff(np.append(self.heads, len(first))).astype(np.uint32)
        self.bucket = bucket_of(address[by_address[own[self.heads]]], n_buckets)
        self.ctx = self.hash[self.heads] & U((1 << 40) - 1)

    def requests(self) -> Iterator[tuple[int, bytes]]:
        code, count = rounded(self.p[self.first]), np.bincount(self.row_of, weights=self.weight, minlength=len(self.first)).astype(np.uint32)
        for bucket, i, j in _cells(self.bucket):
            a, b = self.heads[i], self.heads[j - 1] + self.sizes[j - 1]
            yield bucket, packed(self.ctx[i:j], self.sizes[i:j], self.n[self.heads[i:j]], self.short[a:b], code[a:b], count[a:b])

    def answered(self, answers: dict[int, bytes], shared: tuple[np.ndarray, np.ndarray], hot: float) -> tuple[np.ndarray, np.ndarray]:
        """For each pair K of its context (0 where it isn't kept), and its count. shared: kept contexts in parts, and their followers."""
        follow, counts = [np.empty(0, np.uint32)], [np.empty(0, np.uint64)]
        for bucket, _, _ in _cells(self.bucket):
            for held, x in zip((follow, counts), unpacked(answers[bucket], "<u4", "<u8"), strict=True):
                held.append(x)
        followed = np.concatenate(follow).astype(float)
        parted, (ctx, of_ctx) = np.flatnonzero(followed == SHARED), shared
        at = np.searchsorted(ctx, self.ctx[parted])
        followed[parted] = np.where(np.append(ctx, ~U(0))[at] == self.ctx[parted], np.append(of_ctx, 0)[at], 0)
        k = escape(self.n[self.heads].astype(float), followed, hot)
        return np.repeat(k, self.sizes), np.concatenate(counts).astype(np.int64)


class Block:
    """The words of a block with what is known of them so far. Runs of words that were met are numbered inside the block."""

    def __init__(self, row: dict, n_buckets: int, share: int, hot: float):
        self.n_buckets, self.share, self.hot = n_buckets, share, hot
        self.words = np.append(unpacked(row["words"], "<u8")[0], END)
        index, lengths = unpacked(row["index"], "<u4")[0], np.asarray(row["lengths"], np.int64)
        self.starts = np.cumsum(lengths + 2) - (lengths + 2)  # each text has a begin and an end
        of = np.repeat(np.arange(len(lengths)), lengths)
        self.which = np.full(len(index) + 2 * len(lengths), len(self.words) - 1, np.int32)  # the end, where nothing else is put
        self.which[np.arange(len(index)) + 2 * of + 1] = index
        self.own = np.ones(len(self.which), bool)
        self.own[self.starts] = False
        self.train = np.repeat(np.asarray(row["train"], bool), lengths + 2) & self.own
        self.order = ordered(self.words)
        self.bucket = bucket_of(self.words[self.order], n_buckets)

    def word_requests(self) -> Iterator[tuple[int, bytes]]:
        count = np.bincount(self.which[self.train], minlength=len(self.words)).astype(np.uint32)
        for bucket, i, j in _cells(self.bucket):
            yield bucket, packed(self.words[self.order[i:j]], count[self.order[i:j]])

    def know_words(self, answers: dict[int, bytes], n: int, v: int, n_texts: int) -> None:
        counts = np.empty(len(self.words), np.int64)
        counts[self.order] = np.concatenate([unpacked(answers[bucket], "<u8")[0] for bucket, _, _ in _cells(self.bucket)]).astype(np.int64)
        p = (counts + 0.5) / (n + 0.5 * (v + 1))
        self.base, self.known, self.p = np.log10(p), counts > 0, p[self.which]
        self.run = np.where(self.own, self.which, len(self.words)).astype(np.int32)  # the run of words that ends here, -1 if none
        self.hashes, self.totals = np.append(self.words, BEGIN), np.append(counts, n_texts)

    def asked(self) -> Asked:
        often = np.append(self.totals >= 2, False)  # the last: no context
        live = np.zeros(len(self.own), bool)
        live[1:] = self.own[1:] & often[self.run[:-1]]
        pos = np.flatnonzero(live)
        return Asked(pos, self.run[pos - 1], self.hashes, self.totals, self.which[pos], self.words, self.p[pos], self.train[pos], self.n_buckets, self.share)

    def know(self, asked: Asked, answers: dict[int, bytes], shared: tuple[np.ndarray, np.ndarray]) -> None:
        """Goes one word deeper."""
        k, self.totals = asked.answered(answers, shared, self.hot)
        kept = np.flatnonzero((k > 0)[asked.row_of])
        row = asked.row_of[kept]
        own = k[row]
        self.p[asked.pos[kept]] = (self.totals[row] + own * asked.p[kept]) / (asked.n[row] + own)
        self.run = np.full(len(self.run), -1, np.int32)
        self.run[asked.pos] = asked.row_of
        self.hashes = shingles.mix(asked.hash * shingles._C + self.words[asked.word])

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        of = lambda x: np.add.reduceat(np.where(self.own, x, 0), self.starts)
        return of(np.ones(len(self.own), np.int64)), of(self.known.astype(np.int64)[self.which]), of(self.base[self.which]), of(np.log10(self.p))


def _blocks(size: int):
    """Cuts documents into blocks of about so many words."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        kept: list[pa.Array] = []
        train, lengths, hashes, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(hashes)
            first, inverse = grouped(flat)
            words, order = flat[first], np.argsort(-np.bincount(inverse, minlength=len(first)), kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            rows = pa.concat_arrays(kept)
            cols = [pa.array([part << 32 | k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows), pa.array([train], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32()))]
            cols += [pa.array([packed(words[order])], pa.binary()), pa.array([packed(rank[inverse])], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["block", "kept", "train", "lengths", "words", "index"])

        for batch in slices(batches):
            raw = [x or b"" for x in batch.column("raw").to_pylist()]
            for lo, hi in shingles.in_parts(raw):
                h, counts = shingles.word_hashes(raw[lo:hi])
                hashes.append(h), kept.append(batch.column("kept").slice(lo, hi - lo))
                train += batch.column("train").slice(lo, hi - lo).to_pylist()
                lengths += counts.tolist()
                held += len(h) + hi - lo
                if held >= size:
                    yield close()
                    kept, train, lengths, hashes, held, k = [], [], [], [], 0, k + 1
        if lengths:
            yield close()

    return blocks


def _answers(blocks: list[int], bucket: int, answers: list[bytes], stats: list[tuple[int, int, bytes | None]]) -> pa.Table:
    n, m = len(answers), len(stats)
    cols = [blocks + [None] * m, [bucket] * (n + m), answers + [s[2] for s in stats], [None] * n + [s[0] for s in stats], [None] * n + [s[1] for s in stats]]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["block", "bucket", "answer", "ctx", "follow"])


def count_words(group: pa.Table) -> pa.Table:
    """Answers to the requests of a bucket: the training count of each word. The one row of statistics has how many words have one."""
    cells = [unpacked(x, "<u8", "<u4") for x in group.column("request").to_pylist()]
    words, inverse = grouped(np.concatenate([c[0] for c in cells]))
    count = np.bincount(inverse, weights=np.concatenate([c[1] for c in cells]), minlength=len(words)).astype(np.uint64)
    ends = np.cumsum([len(c[0]) for c in cells])[:-1]
    return _answers(group.column("block").to_pylist(), group.column("bucket")[0].as_py(), [packed(x) for x in np.split(count[inverse], ends)], [(-1, int((count > 0).sum()), None)])


def tested_contexts(share: int, hot: float, min_gain: float):
    def test(group: pa.Table) -> pa.Table:
        """Answers: for each context how many words follow it (0: not kept; SHARED: see all its parts), for each pair its
        count. Statistics: of each part of a context, followers, and what divergences() needs once K is known."""
        cells = [unpacked(x, "<u8", "<u4", "<i8", "<u4", "u1", "<u4") for x in group.column("request").to_pylist()]
        ctx, sizes, n, word, code, count = (np.concatenate(x) for x in zip(*cells, strict=True))
        names, of_row = grouped(ctx)
        total, names = n[names], ctx[names]
        pairs = np.repeat(of_row, sizes).astype(U) << U(32) | word
        first, inverse = grouped(pairs)
        c, owner = np.bincount(inverse, weights=count, minlength=len(first)), (pairs[first] >> U(32)).astype(np.int64)
        code, is_shared, follow = code[first], total > share, np.bincount(owner[c > 0], minlength=len(names))
        edges = np.searchsorted(owner, np.arange(len(names) + 1))
        k = escape(total.astype(float), follow, hot)
        gain = np.add.reduceat(gains(c, total[owner].astype(float), k[owner], code), edges[:-1])
        flag = np.where(is_shared, SHARED, np.where(gain >= min_gain / UNIT, follow, 0)).astype(np.uint32)
        counts = c.astype(np.uint64)[inverse]
        row_ends, pair_ends = np.cumsum([len(x[0]) for x in cells])[:-1], np.cumsum([len(x[3]) for x in cells])[:-1]
        answers = [packed(f, c) for f, c in zip(np.split(flag[of_row], row_ends), np.split(counts, pair_ends), strict=True)]
        stats = []
        for i in np.flatnonzero(is_shared).tolist():
            seen = slice(edges[i], edges[i + 1])
            kinds, times = np.unique(c[seen].astype(U) << U(8) | code[seen], return_counts=True)
            stats.append((int(names[i]), int(follow[i]), packed(total[i : i + 1].astype("<i8"), kinds, times.astype("<i8"))))
        return _answers(group.column("block").to_pylist(), group.column("bucket")[0].as_py(), answers, stats)

    return test


def divergences(stats: DataFrame, ctx: np.ndarray, follow: np.ndarray, hot: float) -> DataFrame:
    """ctx and gain (in units) of contexts that were counted in parts. follow: of each of the sorted ctx, by all its parts."""
    sent = stats.sparkSession.sparkContext.broadcast((ctx, follow))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, followed = sent.value
        for batch in slices(batches):
            out = []
            for name, part in zip(batch.column("ctx").to_pylist(), batch.column("answer").to_pylist(), strict=True):
                n, kinds, times = unpacked(part, "<i8", "<u8", "<i8")
                n, at = n.astype(float), np.searchsorted(names, U(name))
                k = escape(n, followed[at : at + 1], hot)
                out.append(int((gains((kinds >> U(8)).astype(float), n, k, (kinds & U(255)).astype(np.uint8)) * times).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("ctx"), pa.array(out, pa.int64())], names=["ctx", "gain"])

    return in_arrow(stats.select("ctx", "answer"), summed, "ctx bigint, gain bigint").groupBy("ctx").agg(F.sum("gain").alias("gain"))


def score(documents: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), depth: int = DEPTH, min_gain: float = 4.0, hot: int | None = None) -> DataFrame:
    """id_col, keep, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    kept = [id_col, *keep]
    names = kept_names(kept, OWN)
    whole = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    texts = documents.select(whole.alias("kept"), F.coalesce(training, F.lit(False)).alias("train"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    kind = texts.schema["kept"].dataType.simpleString()
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"docmill_blocks_{uuid.uuid4().hex}"
    cut = in_arrow(texts, _blocks(BLOCK), f"block bigint, kept array<{kind}>, train array<boolean>, lengths array<int>, words binary, index binary")
    cut.repartition(dealt, "block").write.bucketBy(dealt, "block").sortBy("block").option("path", f"{shared_folder(spark)}/{table}").saveAsTable(table)
    collect_garbage(spark)
    blocks = spark.table(table)
    sized = blocks.select(F.arrays_zip("train", "lengths").alias("x")).select(F.inline("x"))
    n_all, n, n_texts = sized.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum(F.col("lengths") + 1), F.sum(F.when(F.col("train"), F.col("lengths") + 1)), F.count_if("train"))]).first()
    n_buckets = max(-(-n_all // BUCKET), 1)
    share, hot = max(SHARE, n >> 20), math.inf if hot is None else hot
    columns = ["block", "train", "lengths", "words", "index"]
    levels: list[DataFrame] = []
    facts: dict = {"n": n, "n_texts": n_texts, "shared": []}

    def joined(*more: str) -> DataFrame:
        """Blocks beside all answers to them so far."""
        out = blocks.select(*columns, *more)
        for d, found in enumerate(levels):
            own = found.filter("block is not null").select(F.col("block").alias(f"b{d}"), "bucket", "answer").repartition(dealt, f"b{d}")
            own = own.groupBy(f"b{d}").agg(F.collect_list(F.struct("bucket", "answer")).alias(f"a{d}"))
            out = out.join(own, F.col("block") == F.col(f"b{d}"), "left").drop(f"b{d}")
        return out

    def replayed(row: dict, facts: dict, n_levels: int) -> Block:
        block = Block(row, n_buckets, share, hot)
        for d in range(n_levels):
            answers = {x["bucket"]: x["answer"] for x in row[f"a{d}"] or []}
            if d:
                block.know(block.asked(), answers, facts["shared"][d - 1])
            else:
                block.know_words(answers, facts["n"], facts["v"], facts["n_texts"])
        return block

    for d in range(depth + 1):
        sent, n_levels = spark.sparkContext.broadcast(dict(facts)), len(levels)

        def ask(batches: Iterator[pa.RecordBatch], sent=sent, n_levels=n_levels) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                row = batch.to_pylist()[0]
                block = replayed(row, sent.value, n_levels)
                cells = list(block.asked().requests() if n_levels else block.word_requests())
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(cells), pa.int64()), pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.binary())], names=["block", "bucket", "request"])

        serve = tested_contexts(share, hot, min_gain) if d else count_words
        found = in_arrow(joined(), ask, "block bigint, bucket int, request binary").groupBy("bucket").applyInArrow(serve, ANSWER)
        levels.append(written(found, f"level-{d}"))
        stats = levels[-1].filter("block is null")
        if d:
            rows = stats.groupBy("ctx").agg(F.sum("follow").alias("follow")).orderBy("ctx").collect()  # n / share at most
            ctx, follow = np.array([r["ctx"] for r in rows], U), np.array([r["follow"] for r in rows], np.int64)
            wide = divergences(stats, ctx, follow, hot).filter(F.col("gain") >= min_gain / UNIT).collect() if rows else []
            kept_ones = np.isin(ctx, np.array([r["ctx"] for r in wide], U))
            facts = facts | {"shared": [*facts["shared"], (ctx[kept_ones], follow[kept_ones])]}
        else:
            facts["v"] = int(stats.agg(F.coalesce(F.sum("follow"), F.lit(0))).first()[0])
        del found
        collect_garbage(spark)

    sent, n_levels = spark.sparkContext.broadcast(facts), len(levels)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = batch.column("kept").flatten()
            sums = replayed(batch.drop_columns(["kept"]).to_pylist()[0], sent.value, n_levels).sums()
            yield pa.RecordBatch.from_arrays([rows, *map(pa.array, sums)], names=["kept", "n_tokens", "n_known", "base_score", "score"])

    scored = written(in_arrow(joined("kept"), finish, f"kept {kind}, n_tokens bigint, n_known bigint, base_score double, score double"), "scored")
    spark.sql(f"DROP TABLE {table}")
    out = [F.col(f"kept.c{i}").alias(name) for i, name in enumerate(names)]
    return scored.select(*out, "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")
