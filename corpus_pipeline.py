"""A training corpus from raw documents: language ID, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last return the
columns of documents, extra ones of whatever name among them; the last returns doc_id, n_tokens, ids (unsigned 16-bit
little-endian), ids_sha256 and decoded_sha256. Null ids and repeated rows are carried along: rows that repeat both id and
text go or stay together, rows that repeat only the id are judged each by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import chunk_reuse, common, decontaminate, language, near_dedup, tokens


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with columns of our own names, so that theirs can't clash with those of operators."""
    return docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])


def _own(docs: DataFrame, name: str) -> str:
    return f"_c{docs.columns.index(name)}"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows of gone, which has doc_id and text_hash (xxhash64 of the text)."""
    gone = gone.select(F.col("doc_id").alias("_g0"), F.col("text_hash").alias("_g1")).distinct()
    same = F.col(_own(docs, "doc_id")).eqNullSafe(F.col("_g0")) & (F.xxhash64(_own(docs, "text")) == F.col("_g1"))
    return _numbered(docs).join(gone, same, "left_anti").toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is told by a margin stay; those without letters, ties, and texts of no learned language go."""
    model = language.fit(docs, F.lit(True))
    held = _numbered(docs)
    found = language.classify(held, model, id_col=held.columns[0], text_col=_own(docs, "text"), keep=tuple(held.columns[1:]))
    return found.filter(~F.col("rejected")).select(*held.columns).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the smallest id stays."""
    return _without(docs, near_dedup.near_duplicates(docs, percent=80).filter(~F.col("kept")))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a twentieth or more of their words in passages of the benchmark go."""
    found = decontaminate.find_contamination(docs, common.table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter(decontaminate.contaminated(found)))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text as ids, and the digest of what they decode to."""
    decoded = chunk_reuse.encode_and_decode(docs, tokens.path_of("byte_bpe_50k.json"))
    return decoded.select("doc_id", "n_tokens", "ids", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("bpe", bpe)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
