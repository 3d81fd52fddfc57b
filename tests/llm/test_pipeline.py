"""The pipeline's stages, each against a brute-force version over what the stage before it kept."""

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from docmill.llm import tokens  # noqa: E402
from tests.llm.test_ops import brute_components, brute_contamination, prose  # noqa: E402

RNG = random.Random(8)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    items = [(i, prose(25)) for i in range(6)]
    texts = [prose(RNG.randrange(20, 150), RNG.choice(["en", "fr"])) for _ in range(50)]
    near = texts[0].split() + prose(100).split()
    texts += [" ".join(near), " ".join([*near[:70], "other", *near[71:]]), texts[1], texts[1], None, "", "123 !!", prose(60) + " " + items[2][1] + " " + prose(10), items[3][1], prose(2000) + items[4][1], "word " * 5000]
    rows = [(i, t, "fr" if t and "eau" in t else "en", "src", len(t or "")) for i, t in enumerate(texts)] + [(None, prose(40), "en", "src", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), rows, items


def test_stages(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    texts = {r[0]: r[1] for r in rows}
    kept = dict(texts)
    for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        docs = stage(spark, docs, path).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if k == 0:
            assert len(set(ids)) == len(ids) and set(ids) <= set(kept)
            gone = {i for i in kept if i not in ids}
            assert {54, 55, 56} <= gone and all(len(kept[i] or "") < 30 or len(set(kept[i].split())) < 3 for i in gone)
            kept = {i: kept[i] for i in ids}
        elif k == 1:
            groups = brute_components([(i, t) for i, t in kept.items() if i is not None], 80)
            kept = {i: t for i, t in kept.items() if i is None or groups[i][1] == i}
            assert set(ids) == set(kept) and 51 not in kept and 52 not in kept
        else:
            hit = {i for i, t in kept.items() if (c := brute_contamination(t, items))[1] and 20 * c[1] >= c[0]}
            assert {57, 58} <= hit and 59 not in hit
            kept = {i: t for i, t in kept.items() if i not in hit}
            assert set(ids) == set(kept)
    encode = tokenizers.Tokenizer.from_file(tokens.path_of("byte_bpe_50k.json")).encode
    got = {r["doc_id"]: r for r in pipeline.STAGES[-1][1](spark, docs, path).collect()}
    assert set(got) == set(kept)
    for i, r in got.items():
        ids = encode(kept[i], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(kept[i].encode()).hexdigest()
    assert {r["doc_id"] for r in pipeline.run(spark, path).select("doc_id").collect()} == set(kept)


def test_stages_on_nothing(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.count() == 0
