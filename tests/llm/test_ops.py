"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and odd columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from docmill.llm import chunk_reuse, components, decontaminate, fingerprints, language, license_scan, near_dedup, shingles, suffix_tree, token_counts, token_planes, tokens, url_filter  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, n_tokens string, id string, key string"  # three names clash with ours
RNG = random.Random(5)
SYLLABLES = {"en": ["the", "an", "er", "ing", "tion", "sh", "ou"], "fr": ["eau", "que", "oi", "ment", "é", "aux", "le"]}


def word(lang="en"):
    return "".join(RNG.choice(SYLLABLES[lang]) for _ in range(RNG.randrange(1, 4)))


def prose(n, lang="en"):
    return " ".join(word(lang) for _ in range(n))


def make_docs():
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    long = prose(20000)
    passage = prose(40)
    texts = [base, base, " ".join(near), prose(30, "fr"), None, "", "   \n\t", "a", "a b c", "a b c", "!!! 123 ???", long, long + " tail", passage + " " + prose(30), prose(20) + "\n" + passage,
             "Two  blanks\u00a0and\ttabs <|endoftext|> <b>", "É\u0301Ñ ß İ 😀 中文字", "x" * 30000, prose(60, "fr"), prose(60, "fr"), "Licensed under the Apache License, Version 2.0.\n" + prose(10)]
    rows = [(i * 3, t, "fr" if i in (3, 18, 19) else "en", "x", "y", "z") for i, t in enumerate(texts)]
    rows += [(None, prose(25), None, None, None, None), (None, None, None, None, None, None)]
    rows += [(1000 + i, prose(RNG.randrange(1, 200), "fr" if i % 2 else "en"), "fr" if i % 2 else "en", None, None, None) for i in range(60)]
    return rows


DOCS = make_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lib(file):
    return tokenizers.Tokenizer.from_file(tokens.path_of(file))


# op1


@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("n", [0, 1, 99, 100, 101, 1000])
def test_planes_round_trip(n, width):
    ids = np.random.default_rng(1).integers(0, 60000, n).astype(f"<u{width}")
    planes, ends = token_planes.pack(ids, block=100)
    assert len(ends) == width * math.ceil(n / 100)
    assert np.array_equal(token_planes.unpack(planes, ends, width), ids)


def test_token_table(spark, docs, none, tmp_path):
    path = tokens.path_of("word_bpe_49k.json")
    token_planes.write_token_planes(docs, str(tmp_path / "t"), path, end_id=2)
    got = token_planes.with_crc32(token_planes.read_token_planes(spark, str(tmp_path / "t"))).collect()
    encode, start, want = lib("word_bpe_49k.json"), 0, []
    for r in sorted((r for r in DOCS if r[0] is not None), key=lambda r: r[0]):
        ids = [*encode.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in sorted((r for r in got if r["doc_id"] is not None), key=lambda r: r["doc_id"])] == want
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])][:2] == [None, None] and len(got) == len(DOCS)
    token_planes.write_token_planes(none, str(tmp_path / "e"), path)
    assert token_planes.read_token_planes(spark, str(tmp_path / "e")).count() == 0


def test_words_of_letters_are_merged_by_rank(monkeypatch):
    rng, p = random.Random(6), tokens.Pieces(tokens.path_of("word_bpe_49k.json"), 4)
    letters = [chr(i) for i in range(0x180) if chr(i).isalpha()]
    words = [a + b + c for a in letters for b, c in (("", ""), ("e", "n"), (rng.choice(letters), ""))]
    words += ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + ["x" * 200, "x" * 201, "anna" * 50]
    words += [name.removesuffix("</w>") for name in rng.sample(sorted(p.library.get_vocab()), 5000) if name.removesuffix("</w>").isalpha()]
    others, joined = [], p._learn_joined
    monkeypatch.setattr(p, "_learn_joined", lambda words: others.extend(words) or joined(words))
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    assert p.encode_all(texts) == [p.whole(t) for t in texts]
    assert not [w for w in others if w.isascii() and w.isalpha() and len(w) <= 200]


def test_merges_that_no_rank_tells(tmp_path):
    """A file with a token that its own merge doesn't make out of its text is left to the library."""
    import json

    state = json.load(open(tokens.path_of("word_bpe_49k.json")))
    merges, vocab = state["model"]["merges"], state["model"]["vocab"]
    at, odd = next((i, [x[:k], x[k:]]) for i in range(len(merges) - 1, 0, -1) for m in [merges[i] if isinstance(merges[i], list) else merges[i].split(" ")] for x in ["".join(m)] if x.isalpha() for k in range(1, len(x)) if k != len(m[0]) and x[:k] in vocab and x[k:] in vocab)
    merges[at] = odd if isinstance(merges[at], list) else " ".join(odd)
    (tmp_path / "odd.json").write_text(json.dumps(state))
    p, word = tokens.Pieces(str(tmp_path / "odd.json"), 4), "".join(odd)
    assert p.by_word is None and p.encode(f"{word}s {word} x{word}") == p.whole(f"{word}s {word} x{word}")


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(file):
    rng, p = random.Random(2), tokens.Pieces(tokens.path_of(file), 4, memo=50)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "e\u0301", "'s", "1", "23", "!", "<|endoftext|>", "中", "\u00a0", "\u3000", "😀", "I", "İ", "\x85", "\x1c", "don't", "\u0301", "_", "\r\n", "\u200b", "\x00", "The", "tion"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert p.encode(text) == p.whole(text), repr(text)
    assert p.encode("x" * 30000) == p.whole("x" * 30000)


# op2


def test_licenses(spark, none):
    t = license_scan.TEMPLATES
    rows = [(1, t["MIT"]), (2, f"{prose(5)}\n{t['GPL-3.0']}\n{t['MIT']}"), (3, "released under the mit licence"), (4, "The license of this is unknown to us."), (5, None), (6, ""), (None, "So: " + t["Apache-2.0"])]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["line"], r["license"], r["n_differing"]) for r in got) == [(0, 0, "Apache-2.0", 0), (1, 0, "MIT", 0), (2, 1, "GPL-3.0", 0), (2, 2, "MIT", 0), (3, 0, "MIT", 1)]
    assert [r["differences"] for r in got if r["doc_id"] == 3] == [["-license"]]
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3}
    assert license_scan.scan(none).count() == 0


def test_notices_over_several_lines_and_several_in_one():
    t = license_scan.TEMPLATES
    found = license_scan.Scanner(t, 19, 3, 0.25).notices
    rng = random.Random(3)
    for name, text in t.items():
        for width, mark in ((20, "# "), (35, " * "), (60, "//"), (45, "-- "), (1000, "")):
            lines, words = [""], text.split()
            for w in words:
                lines = [*lines[:-1], f"{lines[-1]} {w}".strip()] if len(lines[-1]) + len(w) < width else [*lines, w]
            head = "".join(f"{' '.join('ab' * rng.randrange(1, 4) for _ in range(9))}\n" for _ in range(3))
            got = found(head + "\n".join(mark + x for x in lines) + "\nand then the code\n")
            assert [(r[0], r[2], r[4]) for r in got] == [(3 + (not lines[0]), name, [])] and all(w in got[0][1] for w in words)
    both = f"{t['MIT']} So it is. {t['Apache-2.0']} {t['MIT-text']}"
    assert [(r[0], r[2], r[4]) for r in found(both)] == [(0, n, []) for n in ("MIT", "Apache-2.0", "MIT-text")]
    assert [r[2] for r in found(f"{t['MIT']}\n" * 3 + t["BSD"].replace("source", "any").replace(" with ", "\nwith "))] == ["MIT"] * 3 + ["BSD"]
    long = found("word " * 5000 + t["ISC"] + " word" * 5000)
    assert len(long) == 1 and t["ISC"] in long[0][1] and len(long[0][1]) < 1000 and found("license ..." + "." * 50_000) == []


def test_exact_wording_among_many_siblings():
    tail = "of the Example Public License as published by the Example Foundation for all works of this kind."
    siblings = {f"v{i}": f"You may use this under version {i} {tail}" for i in range(10, 40)}
    scanner = license_scan.Scanner(siblings, 19, 3, 0.25)
    for name, text in siblings.items():
        assert scanner.judge(f"Not of the {' of the '.join(f'under version {i} {tail[:12]}' for i in range(10, 40))}. {text}")[0::2] == (name, [])


def fewest(template, words):
    """Fewest words to leave out of or add to the template for any part of words, by longest common subsequences."""
    best = len(template)
    for i in range(len(words)):
        row = [0] * (len(template) + 1)
        for n, w in enumerate(words[i:], 1):
            above, row = row, [0]
            for j, t in enumerate(template):
                row.append(above[j] + 1 if t == w else max(above[j + 1], row[j]))
            best = min(best, len(template) + n - 2 * row[-1])
    return best


def test_licenses_against_brute_force(spark):
    rng, names, rows = random.Random(5), list(license_scan.TEMPLATES), []
    for i in range(120):
        words = license_scan.TEMPLATES[names[i % len(names)]].split()
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = ["other"] * rng.randrange(2) or words[at : at + 1]
        rows.append((i, " ".join(["so"] * rng.randrange(3) + words + ["it", "is"][: rng.randrange(3)])))
    rows += [rows[0], (None, "no notice, but a copyright"), (998, f"license {'word ' * 20_000}{license_scan.TEMPLATES['MIT']}")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit("x")).withColumn("line", F.lit(7))
    got, found = license_scan.scan(frame).collect(), 0
    for doc_id, text in rows:
        mine = [r for r in got if r["doc_id"] == doc_id]
        if doc_id in (None, 998):
            assert [(r["license"], r["n_differing"]) for r in mine] == ([("MIT", 0)] if doc_id else [])
            continue
        cost = {n: fewest(license_scan.words_of(t), license_scan.words_of(text)) for n, t in license_scan.TEMPLATES.items()}
        near = {n: c for n, c in cost.items() if c <= 0.25 * len(license_scan.words_of(license_scan.TEMPLATES[n]))}
        if not near or not license_scan.TRIGGERS.search(text):
            assert mine == [], text
            continue
        first = min(mine, key=lambda r: r["n_differing"])
        assert first["n_differing"] == len(first["differences"]) == min(near.values()) == near[first["license"]], text
        found += 1
    assert 40 < found < 121 and len([r for r in got if r["doc_id"] == 0]) == 2


def test_every_template_finds_itself():
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 19, 3, 0.25)
    for name, text in license_scan.TEMPLATES.items():
        assert scanner.judge(text)[0::2] == (name, [])


# op3


def words3(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(text, items):
    w, hit, found = words3(text), set(), set()
    for item, t in items:
        v = words3(t)
        n = min(13, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def test_contamination(spark, none):
    rng = random.Random(3)
    few = ["the", "of", "a"]
    items = [(i, " ".join(rng.choice(few + ["x", "y"]) for _ in range(rng.choice([1, 5, 12, 13, 14, 40])))) for i in range(12)]
    items += [(50, "a " * 30), (51, None), (52, ""), (53, "..."), (0, items[0][1])]
    rows = [(i, " ".join(rng.choice(few + ["x", "y", "Z9é"]) for _ in range(rng.randrange(120)))) for i in range(60)]
    rows += [(100 + i, f"{prose(20)}. {(t or '').upper()}! {prose(9)}") for i, t in items]
    rows += [(900, None), (901, ""), (902, "a " * 300), (903, "a " * 300), (903, "a " * 300), (None, items[3][1])]
    got = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got.collect())
    assert got == sorted((str(i), *brute_contamination(t, items)) for i, t in rows)
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert {r["n_hit"] for r in decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id bigint, text string"), empty).collect()} == {0}
    assert decontaminate.find_contamination(none, empty).count() == 0


def test_contamination_without_broadcast(spark):
    rows, items = [(1, prose(40)), (2, "one two " + " ".join(f"w{i}" for i in range(20)))], [(7, " ".join(f"w{i}" for i in range(20)))]
    a, b = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_contamination(a, b, broadcast_windows=0).collect()
    assert sorted((r["doc_id"], r["n_hit"], r["items"]) for r in got) == [(1, 0, []), (2, 20, ["7"])]


# op4


def test_encode_and_decode(docs, none):
    path, encode = tokens.path_of("byte_bpe_50k.json"), lib("byte_bpe_50k.json")
    got = chunk_reuse.decode_ids(chunk_reuse.encode_documents(docs, path), path).collect()
    want = []
    for r in DOCS:
        ids = encode.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), encode.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["text"]) for r in got) == sorted(want)
    assert chunk_reuse.encode_documents(none, path).count() == 0
    with pytest.raises(ValueError, match="byte-level"):
        chunk_reuse.encode_documents(docs, tokens.path_of("word_bpe_49k.json"))


def workers_of_a_task(node):
    """Python workers at once in a task of this stage, and the most in any stage below."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return workers_of_a_task(node.initialPlan())
    children = [workers_of_a_task(node.children().apply(i)) for i in range(node.children().size())]
    own, below = (max((x[i] for x in children), default=0) for i in (0, 1))
    if "Exchange" in node.nodeName():
        return 0, max(own, below)
    return own + ("InArrow" in node.nodeName()), below


def test_encode_and_decode_have_one_worker_in_a_task(docs, none):
    path, order = tokens.path_of("byte_bpe_50k.json"), lambda df: sorted(map(str, df.select("doc_id", "ids", "n_tokens", "ids_sha256", "text").collect()))
    got = chunk_reuse.encode_and_decode(docs, path)
    assert order(got) == order(chunk_reuse.decode_ids(chunk_reuse.encode_documents(docs, path), path, keep=("doc_id",)))
    assert max(workers_of_a_task(got._jdf.queryExecution().executedPlan())) == 1
    assert chunk_reuse.encode_and_decode(none, path).count() == 0
    query = __import__("__spark_entry__").corpus_pipeline.bpe(docs.sparkSession, docs, "")
    assert max(workers_of_a_task(query._jdf.queryExecution().executedPlan())) == 1


def test_cores_are_shared_wherever_they_stand():
    passage = prose(3000).encode()
    a, b = prose(333).encode() + b" " + passage + b" end", b"start " + passage + b" " + prose(50).encode()
    cut = lambda x: {x[s:e] for s, e in chunk_reuse.cores(x)}
    assert len(cut(a) & cut(b)) >= 0.7 * len(chunk_reuse.cores(passage))
    p = tokens.Pieces(tokens.path_of("byte_bpe_50k.json"))
    known = {chunk_reuse._hash(x): p.whole(x.decode()) for x in cut(a)}
    assert chunk_reuse._joined(b, chunk_reuse.cores(b), known, p.whole) == p.whole(b.decode())


# op5


def test_language(docs, none):
    from pyspark.sql import functions as F

    model = language.fit(docs, ~F.coalesce(language.held_out(F.col("doc_id")), F.lit(False)))
    got = {r["doc_id"]: r for r in language.classify(docs, model, keep=("lang",)).filter("doc_id is not null").collect()}
    assert {lang for lang, _ in model} == {"en", "fr"} and all(0 <= r["score"] <= 1 for r in got.values())
    for i in (12, 15, 18, 30):
        assert got[i]["lang_pred"] == "und" and got[i]["rejected"]
    clear = [r for r in got.values() if r["doc_id"] >= 1000]
    assert sum(r["lang_pred"] == r["lang"] for r in clear) >= 0.95 * len(clear)
    assert language.fit(none, F.lit(True)) == [] and {r["lang_pred"] for r in language.classify(docs, []).collect()} == {"und"}
    assert language.classify(docs, model).count() == len(DOCS) and language.classify(none, model).count() == 0


def test_language_against_brute_force(spark, docs):
    """The dictionaries and every prediction, worked out again without the operator's classes."""
    import zstandard
    from pyspark.sql import functions as F

    rows = DOCS + [DOCS[3]] * 40 + [(DOCS[3][0], prose(50, "fr"), "fr", None, None, None), (77, prose(9), "rare", None, None, None)]
    some = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(some, F.lit(True), docs_per_lang=5)
    hashed = {(r["lang"], r["h"]): r["text"] for r in some.filter("lang is not null and text != ''").selectExpr("lang", "text", "xxhash64(doc_id, text) as h").collect()}
    n_of = Counter(r[2] for r in rows if r[2] and r[1])
    assert [x for x, _ in model] == sorted(n_of, key=lambda x: (-n_of[x], x)) and "rare" in n_of
    for lang, data in model:
        drawn = sorted(h for x, h in hashed if x == lang)[:5]
        assert data == b"".join(language.plain(hashed[lang, h]) for h in drawn)

    def size(raw, data):
        own = zstandard.ZstdCompressionParameters.from_level(12, source_size=4096, dict_size=len(data), hash_log=16, chain_log=16, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)
        pack = zstandard.ZstdCompressor(compression_params=own, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if data else None)
        n = max(len(raw) // 4096, 1)
        step = -(-len(raw) // n)
        return sum(len(pack.compress(data[-64:] + raw[i : i + step])) - len(pack.compress(data[-64:])) for i in range(0, len(raw), step))

    got = {(r["doc_id"], r["text"]): r for r in language.classify(some, model, keep=("text", "lang")).collect()}
    assert language.classify(some, model, keep=("text",)).count() == len(rows)
    for i, text, *_ in rows:
        r = got[i, text]
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        raw = language.plain(text)
        sizes = [size(raw, data) for _, data in model]
        best, bare = min(sizes), size(raw, b"")
        extra = sorted(sizes)[1] - best
        assert r["lang_pred"] == model[sizes.index(best)][0] and r["margin"] == extra
        assert math.isclose(r["score"], 1 / sum(2.0 ** (best - x) for x in sizes))
        assert r["rejected"] == (extra < 1 or 8 * extra < 0.05 * len(raw) or bare - best < 0.03 * bare)


def test_unlearned_languages_and_junk_are_rejected(spark):
    import base64

    rng = random.Random(11)
    syllables = SYLLABLES | {"xx": ["kra", "vžd", "ský", "ně", "oucí", "pře", "zmy"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    learned = [(i, text(lang, 150), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    model = language.fit(spark.createDataFrame(learned, "doc_id bigint, text string, lang string"), language.F.lit(True))
    good = [text(lang, n) for lang in ("en", "fr") for n in (60, 200, 1000, 20000)]
    bad = [text("xx", n) for n in (150, 1000, 20000)] + [f(rng.randbytes(n)) for n in (400, 3000, 50000) for f in (lambda b: b.hex(), lambda b: base64.b64encode(b).decode())]
    got = language.classify(spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string"), model).collect()
    assert {r["doc_id"] for r in got if r["rejected"]} == set(range(len(good), len(good + bad)))
    assert [r["lang_pred"] for r in sorted(got, key=lambda r: r["doc_id"])[: len(good)]] == ["en"] * 4 + ["fr"] * 4
    for n in (1, 100, 4095, 4096, 4097, 8191, 8192, 100_000):
        parts = language.pieces_of(b"y" * n)
        assert b"".join(parts) == b"y" * n and len({len(x) for x in parts[:-1]}) <= 1 and all(len(x) >= min(n, 4096) for x in parts[:-1])


# op6


def test_fingerprints(spark, docs, none):
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(DOCS)
    real = sorted((r for r in DOCS if r[0] is not None), key=lambda r: r[0])
    text = lambda r: r[1] or ""
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    same = {}
    for r, after in zip(real[:-1], real[1:], strict=True):
        n, k = len(text(r)), len(text(r)) // 4
        x = by_id[r[0]]
        assert x["n_chars"] == n and x["edited_sha256"] == hashlib.sha256((text(r)[: n - k] + text(after)[:k]).encode()).hexdigest()
        assert same.setdefault(text(r), x["fingerprint"]) == x["fingerprint"] and 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
    assert by_id[0]["near_next"] == 1.0 and by_id[0]["fingerprint"] != by_id[9]["fingerprint"]
    assert fingerprints.fingerprints(none).count() == 0
    assert fingerprints.fingerprints(docs, broadcast_terms=0).select("doc_id", "fingerprint").exceptAll(fingerprints.fingerprints(docs).select("doc_id", "fingerprint")).count() == 0


def test_long_texts_without_a_term_in_the_lexicon(spark):
    one, two, rare = (" ".join(f"{x}{i}" for i in range(30)) for x in "pqr")
    near = one.replace("p7 ", "changed ")
    rows = [(i, one if i < 20 else two if i < 40 else f"mid{i // 4} own{i}") for i in range(98)] + [(98, rare), (99, ""), (100, near), (101, "...")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for broadcast_terms in (500_000, 0):
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, rare_share=0.015, broadcast_terms=broadcast_terms).collect()}
        prints = {i: r["fingerprint"] for i, r in got.items()}
        assert len({prints[i] for i in range(20)}) == len({prints[i] for i in range(20, 40)}) == 1
        assert len({prints[i] for i in (0, 20, 98, 99, 100)}) == 5 and all(prints[i].endswith("f") for i in (0, 20, 98, 100))
        assert prints[99] == prints[101] == "0" * 256 and got[98]["near_next"] == 0.0 and got[19]["near_next"] == 0.0 and got[0]["near_next"] == 1.0
        assert len(prints[60]) == 256 and all(0 < got[i]["near_edited"] < 1 for i in (0, 19))


def test_next_document(spark):
    """Ids far apart, repeated ids with equal and with other texts, null ids, and a lone document."""
    rows = [(i, f"{chr(97 + k)}" * (8 + k)) for k, i in enumerate((0, 1, 2, 4, 10**12, 2 * 10**12, 2 * 10**12 + 1, 3 * 10**15))]
    rows += [(4, "same text of one id"), (4, "same text of one id"), (4, None), (None, "without an id"), (None, "without an id"), (None, "another text without")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    hashes = {r["text"]: r["h"] for r in table.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i is not None, i or 0, hashes[t or ""], t or "") for i, t in rows))
    want = []
    for x, after in zip(order, [*order[1:], order[0]], strict=True):
        k = len(x[3]) // 4
        want.append((x[0], x[1], x[3][: len(x[3]) - k] + after[3][:k]))
    got = fingerprints.edited_texts(table).collect()
    assert sorted((r["has_id"], r["id"], r["edited"]) for r in got) == sorted(want)
    one = fingerprints.fingerprints(table.filter("doc_id = 0")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(("a" * 8).encode()).hexdigest()


def brute_prints(texts, hashes, rare=1 / 1000, common=1 / 20):
    """Fingerprints of texts (the lexicon is that of the first list), by the definition; hashes: of a list of words, as Spark has them."""
    n, df = len(texts[0]), Counter(w for t in texts[0] for w in set(words3(t)))
    lexicon = {w for w, c in df.items() if rare * n <= c <= max(common * n, 1)}
    out = []
    for t in texts[1]:
        words = set(words3(t))
        used = sorted(hashes(w) for w in words & lexicon) or sorted(map(hashes, words))
        groups = []
        for shift, bits in zip((0, 4, 10, 18), (4, 6, 8, 10), strict=True):
            for slot in range(16):
                own = [x for x in used if (x >> shift) & ((1 << bits) - 1) == slot]
                groups.append(f"{hashes(own) % 65535 + 1:04x}" if own else "0000")
        out.append("".join(groups) + ("f" if words and not words & lexicon else ""))
    return out


def test_fingerprints_against_brute_force(spark, docs):
    got = {(r["doc_id"], r["n_chars"]): r for r in fingerprints.fingerprints(docs).collect()}
    texts = [r[1] or "" for r in DOCS]
    words = sorted({w for t in texts for w in words3(t)})
    of_word = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) as h").collect()}
    wanted, known = [], {}

    def hashes(x):
        if isinstance(x, list):
            if tuple(x) not in known:
                wanted.append(x)
                return 0
            return known[tuple(x)]
        return of_word[x]

    brute_prints((texts, texts), hashes)
    for r in spark.createDataFrame([(x,) for x in {tuple(x) for x in wanted}], "x array<bigint>").selectExpr("x", "xxhash64(x) as h").collect():
        known[tuple(r["x"])] = r["h"]
    for r, want in zip(DOCS, brute_prints((texts, texts), hashes), strict=True):
        if r[0] is not None:
            assert got[r[0], len(r[1] or "")]["fingerprint"] == want, r[0]


# op7


def brute_scores(rows, depth=3, min_gain=4.0, hot=10**9):
    """rows: (train, text). A tree of dictionaries, and (n_tokens, n_known, base, score) of each text."""
    texts = [["<begin>", *suffix_words(t), "<end>"] for _, t in rows]
    of_word = Counter(w for (train, _), t in zip(rows, texts, strict=True) if train for w in t[1:])
    n, v = sum(of_word.values()), len(of_word)
    follow = {}
    for (train, _), t in zip(rows, texts, strict=True):
        for i in range(1, len(t)) if train else ():
            for d in range(1, min(depth, i) + 1):
                follow.setdefault(tuple(t[i - d : i]), Counter())[t[i]] += 1
    kept = {}

    def p_of(ctx, a):
        p = (of_word[a] + 0.5) / (n + 0.5 * (v + 1))
        for d in range(1, len(ctx) + 1):
            s = ctx[-d:]
            if kept.get(s):
                p = (follow[s][a] + kept[s] * p) / (follow[s].total() + kept[s])
        return p

    for s in sorted(follow, key=len):
        total, k = follow[s].total(), len(follow[s])
        if total > hot:
            k = total**0.9
        gain = 0.0
        for a, c in follow[s].items() if total > 1 else ():
            p, own = 2.0 ** (-min(round(-8 * math.log2(p_of(s[1:], a))), 255) / 8), k - (c == 1)
            gain += c * math.log((c - 1 + own * p) / ((total - 1 + own) * p))
        kept[s] = k if gain >= min_gain else 0
    out = []
    for t in texts:
        ps = [p_of(tuple(t[max(i - depth, 0) : i]), t[i]) for i in range(1, len(t))]
        base = [math.log10((of_word[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t[1:]]
        out.append((len(t) - 1, sum(of_word[w] > 0 for w in t[1:]), sum(base), sum(map(math.log10, ps))))
    return n, out, sum(map(bool, kept.values()))


def suffix_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@pytest.mark.parametrize("hot", [None, 40])
def test_scores(spark, docs, none, monkeypatch, hot):
    from pyspark.sql import functions as F

    monkeypatch.setattr(suffix_tree, "BLOCK", 9000)
    monkeypatch.setattr(suffix_tree, "BUCKET", 7000)
    rng, phrases = random.Random(4), ["one two three four", "two three five", "of the old", "of the new", "a"]
    rows = DOCS + [(5000 + i, " ".join(rng.choice(phrases) for _ in range(30)), None, "kept", None, None) for i in range(20)] + [DOCS[3]] * 2
    all_docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = F.coalesce(language.held_out(F.col("doc_id"), 5, 1), F.lit(False))
    train = [not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1) for r in rows]
    n, want, n_kept = brute_scores([(x, r[1]) for x, r in zip(train, rows, strict=True)], hot=hot or 10**9)
    assert n_kept > 20
    got = suffix_tree.score(all_docs, ~out, keep=("lang", "n_tokens"), hot=hot)
    assert got.columns == ["doc_id", "lang", "n_tokens_in", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = sorted(((str(r["doc_id"]), str(r["lang"]), str(r["n_tokens_in"]), r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got.collect()), key=lambda r: r[:5] + (round(r[5], 3),))
    want = sorted(((str(r[0]), str(r[2]), str(r[3]), *w) for r, w in zip(rows, want, strict=True)), key=lambda r: r[:5] + (round(r[5], 3),))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(x, y, rel_tol=1e-9) for g, w in zip(got, want, strict=True) for x, y in zip(g[5:], w[5:], strict=True))
    assert suffix_tree.score(none, F.lit(True)).count() == 0
    assert {(r["base_score"], r["score"], r["train_tokens"]) for r in suffix_tree.score(docs.limit(1), F.lit(False)).collect()} == {(0.0, 0.0, 0)}


@pytest.mark.parametrize("share", [None, 40])
def test_scores_of_contexts_counted_in_parts(spark, monkeypatch, share):
    """A context of more than 2^18 (here also 40) occurrences is counted in parts, but judged and smoothed as any other."""
    monkeypatch.setattr(suffix_tree, "BUCKET", 1 << 16 if share is None else 700)
    if share:
        monkeypatch.setattr(suffix_tree, "BLOCK", 900)
        monkeypatch.setattr(suffix_tree, "SHARE", share, raising=False)
    rng, words = random.Random(8), [f"w{i}" for i in range(300)]
    n_texts, length = (40, 50) if share else (20, 15500)
    texts = [" ".join(f"the {w}" for w in rng.choices(words, [1 / (i + 1) for i in range(300)], k=length)) for _ in range(n_texts)] + [prose(50), "the w1 the w299", None]
    rows = [(i, t) for i, t in enumerate(texts)]
    n, want, _ = brute_scores([(i % 10 != 3, t) for i, t in rows])
    assert sum((t or "").split().count("the") for i, t in rows if i % 10 != 3) > (share or 1 << 18)
    got = suffix_tree.score(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), F.col("doc_id") % 10 != 3).orderBy("doc_id").collect()
    assert {r["train_tokens"] for r in got} == {n}
    for r, w in zip(got, want, strict=True):
        assert (r["n_tokens"], r["n_known"]) == w[:2] and math.isclose(r["base_score"], w[2], rel_tol=1e-9) and math.isclose(r["score"], w[3], rel_tol=1e-9), r["doc_id"]


def test_planes_of_arrays():
    a, b, c = np.array([1, 1 << 40], "<u8"), np.empty(0, "<u4"), np.array([255], "u1")
    x, y, z = suffix_tree.unpacked(suffix_tree.packed(a, b, c), "<u8", "<u4", "u1")
    assert np.array_equal(x, a) and not len(y) and np.array_equal(z, c)


def test_reading_answers_again_makes_no_requests(monkeypatch):
    """A block goes over its levels again and again; that takes under 110 bytes a word (119 before), and the same numbers."""
    rng, n = np.random.default_rng(4), 1 << 18
    index = np.minimum(rng.zipf(1.2, n), 1 << 16).astype("<u4") - 1
    row = {"words": suffix_tree.packed(rng.integers(1, 1 << 64, 1 << 16, dtype="<u8")), "index": suffix_tree.packed(index), "lengths": [n // 8] * 8, "train": [True, False] * 4}
    serve = lambda f, cells: {b: f(pa.table({"block": [0], "bucket": [b], "request": [x]})).column("answer")[0].as_py() for b, x in cells}
    none = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def replayed(answers):
        block = suffix_tree.Block(row, 16, 1 << 18, math.inf)
        block.know_words(answers[0], n // 2 + 4, 1 << 16, 4)
        for x in answers[1:]:
            block.know(block.asked(), x, none)
        return block

    answers = [serve(suffix_tree.count_words, suffix_tree.Block(row, 16, 1 << 18, math.inf).word_requests())]
    answers.append(serve(suffix_tree.tested_contexts(1 << 18, math.inf, 4.0), replayed(answers).asked().requests()))
    assert (replayed(answers).sums()[3] != replayed(answers[:1]).sums()[3]).any()
    monkeypatch.setattr(suffix_tree, "rounded", lambda p: pytest.fail("a request was worked out"))
    tracemalloc.start()
    replayed(answers)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 110 * n



# op8


def test_urls(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("a.b.net", "/", "allow"), ("B.net", "/es/x", "allow"), ("net", "/es/", "allow"), ("", "/", "block"), (None, "/", "block"), ("org", None, "block")]
    urls = [None, "", "no scheme", "http://", "http://Example.COM/en/x?q#f", "https://www.example.com/en/", "https://notexample.com/en/", "http://m.www.example.com/en/a", "x://com", "x://com/", "x://com?a/", "x://net/es/", "x://b.net/es/x", "x://a.b.net/es/x", "x://c.a.b.net/fr", "x://xnet/es/", "a://b://net/es/", "x://org", "x://.org", "x://q.org:80/", "x://net/es"]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[4], "c"), (4, urls[4], "c")]

    def judge(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + (p or "")), len(h), v == "block", h.lower() + (p or ""), v) for h, p, v in rules if h and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or "")]
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))

    for salts in (1, 7):
        got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, rule string"), spark.createDataFrame(rules, "host string, path string, verdict string"), salts=salts)
        assert sorted(map(str, [tuple(r) for r in got.collect()])) == sorted(map(str, [(i, *judge(u)) for i, u, _ in rows]))
    nothing = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id bigint, url string, rule string"), nothing).collect()} == {"allow"}


# op9


def test_token_counts(docs, none):
    path, encode = tokens.path_of("byte_bpe_50k.json"), lib("byte_bpe_50k.json")
    n = np.array([len(encode.encode(r[1] or "", add_special_tokens=False).ids) for r in DOCS])
    hist = token_counts.length_histogram(token_counts.token_lengths(docs, path))
    for r in hist.collect():
        x = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["truncated_total"]) == ((n == x).sum(), (n >= x).sum(), n[n >= x].sum(), np.minimum(n, x).sum())
    for r in token_counts.at_limits(hist, [0, 10, 100000]).collect():
        assert (r["docs_longer"], r["truncated_total"]) == ((n > r["context"]).sum(), np.minimum(n, r["context"]).sum())
    assert hist.agg(token_counts.quantile(hist, 0.5)).first()[0] == sorted(n)[math.ceil(0.5 * len(n)) - 1]
    assert token_counts.length_histogram(token_counts.token_lengths(none, path)).count() == 0


# op10


def shingle_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = [i for i in sets if sets[i]]
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("block", [2, 256])
def test_near_duplicates(spark, monkeypatch, block):
    """Chains, stars and pairs just above and below the threshold; small blocks take the way of large buckets."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng, rows = random.Random(11), [(r[0], r[1]) for r in DOCS if r[0] is not None]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(100)]
        chain = list(base)
        for k in range(8):
            star = list(base)
            for at in rng.sample(range(100), rng.randrange(0, 4)):
                star[at] = f"s{k}"
            rows.append((5000 + g * 100 + k, " ".join(star)))
            chain[10 * k + 5] = "c"
            rows.append((8000 + g * 100 + k, " ".join(chain)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(docs, none):
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(DOCS) and sum(r["doc_id"] is None for r in got) == 2
    assert near_dedup.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["v"]: r["label"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_more_links_are_held_against_components_alone(spark, monkeypatch):
    """What is known already isn't joined again: stars around many pivots would count once for each round of each call."""
    rng, schema = random.Random(3), "a bigint, b bigint"
    old = [(p, i) for p in range(6) for i in range(6, 60)] + [(100 + i, 101 + i) for i in range(9)] + [(200, 201)]
    more = [(59, 109), (105, 300), (400, 401), (7, 8), *[(500 + rng.randrange(20), 500 + rng.randrange(20)) for _ in range(15)]]
    looked, whole = [], components.components
    labels = whole(spark.createDataFrame(old, schema))
    monkeypatch.setattr(components, "components", lambda links, *name: looked.append(links.count()) or whole(links, *name))
    got = components.extended(labels, spark.createDataFrame(more, schema))
    want = whole(spark.createDataFrame(old + more, schema))
    assert {r["v"]: r["label"] for r in got.collect()} == {r["v"]: r["label"] for r in want.collect()}
    assert got.count() == want.count() and looked[0] <= len(more)
    assert whole(spark.createDataFrame(old, schema)).exceptAll(components.extended(labels, spark.createDataFrame([], schema))).count() == 0


def test_shingles_ignore_kind_of_space():
    a, b, c, d = shingles.shingle_sets([b"One two  three\tfour\nfive six", b"one two three four five six", b"one two", b""])
    assert np.array_equal(a, b) and len(a) == 2 and len(c) == 1 and len(d) == 0
