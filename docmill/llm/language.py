"""Language ID by compression: the language whose text, as zstandard's raw dictionary, makes a document smallest.

Fitting is bounded by rows: docs_per_lang training rows for each language, those with the smallest hash of id and text
(rows that repeat both count as one); the dictionary is the whole of their texts. Each language that occurs has one.
Texts are reduced to lower-case words first. Prediction cuts every whole text into pieces of about PIECE bytes, all of one
size, compresses each with each language's dictionary behind the last LEAD bytes of that dictionary (zstandard stores what
gains only a few bytes as it is; the size of the lead alone is taken off), and takes the language with the smallest sum;
of equal sums the language with more training rows, then the first name. Each byte that a rival needs more halves its
weight: score = 1 / sum(2^-(extra bytes)), between 0 and 1. Texts of all lengths go the same way.

"und" where a text is null or holds no letter (score 0). rejected: "und", a margin (bytes to the second smallest) below
min_margin or least_bits a byte of the text, or a gain (the share by which the dictionary makes the text smaller than it
is without one) below least_gain. The two are set from held-out rows of sf0.1: see README. Without training rows all are
"und". Rows with null ids and repeated rows pass through: one row comes back for each row. Kept columns with a name of
ours come back with "_in" behind it.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import in_arrow, kept_names, slices


PIECE, LEAD, LEVEL = 1 << 12, 1 << 6, 12
OWN = ("lang_pred", "score", "margin", "rejected")
_BLANK = bytes(32 if chr(i) not in string.ascii_letters and i < 128 else i for i in range(256))


def plain(text: str) -> bytes:
    """Lower-case words between single blanks; digits and ASCII punctuation say nothing of a language."""
    return b" " + b" ".join(text.lower().encode().translate(_BLANK).split()) + b" "


def pieces_of(raw: bytes) -> list[bytes]:
    """Pieces of one size (the last may lack a few bytes), of PIECE bytes or more, but for shorter texts."""
    n = max(len(raw) // PIECE, 1)
    step = max(-(-len(raw) // n), 1)
    return [raw[i : i + step] for i in range(0, len(raw), step)]


class Packers:
    """Compressed sizes with each dictionary, and without any."""

    def __init__(self, model: list[tuple[str, bytes]], level: int):
        import zstandard

        def settings(dict_size: int):
            """Those of the level, with smaller tables and fewer tries: pieces are short."""
            frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
            return zstandard.ZstdCompressionParameters.from_level(level, source_size=PIECE, dict_size=dict_size, hash_log=16, chain_log=16, search_log=4, **frame)

        self.with_each = []
        for _, data in model:
            shared, own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), settings(len(data))
            shared.precompute_compress(compression_params=own)
            pack, lead = zstandard.ZstdCompressor(dict_data=shared, compression_params=own).compress, data[-LEAD:]
            self.with_each.append((pack, lead, len(pack(lead))))
        self.pack_alone = zstandard.ZstdCompressor(compression_params=settings(0)).compress
        self.frame = len(self.pack_alone(b""))

    def sizes(self, raw: bytes) -> list[int]:
        parts = pieces_of(raw)
        return [sum(len(pack(lead + x)) - alone for x in parts) for pack, lead, alone in self.with_each]

    def alone(self, raw: bytes) -> int:
        return sum(len(self.pack_alone(x)) - self.frame for x in pieces_of(raw))


def fit(documents: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 32) -> list[tuple[str, bytes]]:
    """(lang, dictionary) of each language, most frequent first. Chooses rows by hashes first, and reads their texts after."""
    rows = documents.filter(training & F.col(lang_col).isNotNull() & (F.coalesce(F.length(text_col), F.lit(0)) > 0))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("t"))
    counted = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row for each language
    chosen = rows.select("lang", "h").distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    chosen = chosen.filter(F.col("k") <= docs_per_lang).select("lang", "h").collect()  # docs_per_lang for each language
    texts: dict[str, list] = {r["lang"]: [] for r in counted}
    sample = rows.filter(F.col("h").isin([r["h"] for r in chosen])).groupBy("lang", "h").agg(F.first("t").alias("t"))
    wanted = {(r["lang"], r["h"]) for r in chosen}
    for r in sample.collect():
        if (r["lang"], r["h"]) in wanted:
            texts[r["lang"]].append((r["h"], plain(r["t"])))
    return [(lang, b"".join(t for _, t in sorted(held))) for lang, held in texts.items()]


def classify(documents: DataFrame, model: list[tuple[str, bytes]], *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_margin: int = 1, least_bits: float = 0.05, least_gain: float = 0.03, level: int = LEVEL) -> DataFrame:
    """id_col, the columns in keep, lang_pred, score, margin (bytes), rejected."""
    kept = [id_col, *keep]
    names = [*kept_names(kept, OWN), *OWN]
    place = kept.index(text_col) if text_col in kept else len(kept)  # a kept text is sent once
    sent = documents.sparkSession.sparkContext.broadcast(model)  # docs_per_lang texts for each language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, langs, packers = regex.compile(r"\p{L}").search, [lang for lang, _ in sent.value], Packers(sent.value, level)
        for batch in slices(batches, 64):
            pred, score, margin, rejected = [], [], [], []
            for text in batch.column(place):
                text = text.as_py()
                if text is None or not langs or not letter(text):
                    pred.append("und"), score.append(0.0), margin.append(0), rejected.append(True)
                    continue
                raw = plain(text)
                sizes, bare = packers.sizes(raw), packers.alone(raw)
                least = min(sizes)
                extra = sorted(sizes)[1] - least if len(sizes) > 1 else len(raw)
                pred.append(langs[sizes.index(least)])
                score.append(1.0 / sum(2.0 ** -min(n - least, 1000) for n in sizes))
                margin.append(extra), rejected.append(extra < min_margin or 8 * extra < least_bits * len(raw) or bare - least < least_gain * bare)
            cols = [batch.column(i) for i in range(len(kept))] + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.int64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    read = documents.select(*kept, *([] if text_col in kept else [F.col(text_col).alias("_text")]))
    kinds = [f.dataType.simpleString() for f in documents.select(*kept).schema] + ["string", "double", "bigint", "boolean"]
    return in_arrow(read, predict, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold
