"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import shared_folder, table

#: the rules that the contract of op8 names: host, path, verdict
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.url_filter import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.decontaminate import contaminated, find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(found).alias("contaminated"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import language

    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, ~language.held_out(F.col("doc_id")))
    found = language.classify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("text_hash")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import chunk_reuse, tokens

    decoded = chunk_reuse.encode_and_decode(table(spark, sf_dir, "documents"), tokens.path_of("byte_bpe_50k.json"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from docmill.llm import token_planes, tokens

    target = f"{shared_folder(spark)}/planes-{uuid.uuid4().hex}"
    token_planes.write_token_planes(table(spark, sf_dir, "documents"), target, tokens.path_of("word_bpe_49k.json"), end_id=2)
    return token_planes.with_crc32(token_planes.read_token_planes(spark, target))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import token_counts, tokens

    return token_counts.length_histogram(token_counts.token_lengths(table(spark, sf_dir, "documents"), tokens.path_of("byte_bpe_50k.json")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm import suffix_tree
    from docmill.llm.language import held_out

    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 5, 1)
    scored = suffix_tree.score(docs, ~F.coalesce(out, F.lit(False)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docmill.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan, "op6_fingerprints": op6_fingerprints, "op7_lm_score": op7_lm_score, "op1_token_planes": op1_token_planes, "op9_token_counts": op9_token_counts, "op4_bpe": op4_bpe, "op3_decontaminate": op3_decontaminate, "op5_language": op5_language, "op8_url_filter": op8_url_filter, "op10_near_dedup": op10_near_dedup}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULES = ", ".join(str(r) for r in URL_RULES)

ORACLE_SQL = {
    "op8_url_filter": f"""
WITH rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS k, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
r(h, p, v) AS (VALUES {_RULES}),
fit AS (SELECT u.k, h || p AS rule, v, row_number() OVER (PARTITION BY u.k ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS best
        FROM u JOIN r ON (u.host = h OR suffix(u.host, '.' || h)) AND prefix(u.path, p))
SELECT u.page_id, u.host, u.path, fit.rule, coalesce(fit.v, 'allow') AS verdict FROM u LEFT JOIN fit ON fit.k = u.k AND fit.best = 1
""",
    "op3_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(w) AS n, array_to_string(w, ' ') AS win FROM b WHERE len(w) BETWEEN 1 AND 12
       UNION SELECT item_id, 13, array_to_string(w[i:i + 12], ' ') FROM b, unnest(range(1, len(w) - 11)) t(i) WHERE len(w) >= 13),
ns AS (SELECT DISTINCT n FROM bw),
hit AS (SELECT d.k, t.i AS s, ns.n, bw.item_id FROM d, ns, unnest(range(1, len(d.w) - ns.n + 2)) t(i), bw WHERE bw.n = ns.n AND bw.win = array_to_string(d.w[t.i:t.i + ns.n - 1], ' ')),
covered AS (SELECT k, count(DISTINCT t.p) AS n_hit FROM (SELECT DISTINCT k, s, n FROM hit) h, unnest(range(h.s, h.s + h.n)) t(p) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN items USING (k)
""",
    "op10_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[t.i:t.i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5
      UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(v, u) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.v, e.b FROM reach r JOIN edge e ON e.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(u) AS component_id FROM reach GROUP BY v) c ON c.v = d.doc_id
""",
}
