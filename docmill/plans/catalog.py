"""The registered queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.collection import Collection
from docmill.operators.update import update

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["acc_avg"](spark, sf_dir)


def _find(name: str, on: str, query: dict, where: str, cols: str, tail: str = "", **options) -> None:
    keep = [c.strip() for c in cols.split(",")]
    _queries[name] = lambda spark, d: Collection.from_df(table(spark, d, on)).find_many(query, **options).rows.select(*keep)
    _sql[name] = f"SELECT {cols} FROM {on} WHERE {where} {tail}"


def _agg(name: str, on: str, pipeline: list[dict], sql: str | None, after: Callable[[DataFrame], DataFrame] | None = None, others: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = Collection.from_df(table(spark, d, on)).aggregate(pipeline, {o: table(spark, d, o) for o in others})
        return after(out) if after else out

    _queries[name] = run
    if sql:
        _sql[name] = sql


def _expr(name: str, on: str, keep: list[str], exprs: dict, sql: str, after=None) -> None:
    """Computed fields beside key fields; sql: the select list after the key fields."""
    _agg(name, on, [{"$project": {"_id": 0, **{k: 1 for k in keep}, **exprs}}], f"SELECT {', '.join(keep)}, {sql} FROM {on}", after)


def _update(name: str, on: str, query: dict, delta: dict, sql: str, after=None) -> None:
    _queries[name] = lambda spark, d: (after or (lambda x: x))(update(table(spark, d, on), query, delta))
    _sql[name] = sql


_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_find("find_eq", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", _O)
_find("find_gte", "orders", {"o_totalprice": {"$gte": 100000.0}}, "o_totalprice >= 100000", _O)
_find("find_range", "orders", {"o_totalprice": {"$gt": 50000, "$lt": 150000}, "o_orderdate": {"$gte": datetime.datetime(1995, 1, 1)}}, "o_totalprice > 50000 AND o_totalprice < 150000 AND o_orderdate >= TIMESTAMP '1995-01-01'", _O)
_find("find_lte", "orders", {"o_custkey": {"$lte": 100}}, "o_custkey <= 100", _O)
_find("find_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", None]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')", _O)
_find("find_nin", "orders", {"o_orderpriority": {"$nin": ["1-URGENT", "2-HIGH"]}}, "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')", _O)
_find("find_ne", "orders", {"o_orderstatus": {"$ne": "O"}}, "o_orderstatus <> 'O'", _O)
_find("find_and_or", "orders", {"$or": [{"o_orderstatus": "F", "o_totalprice": {"$lt": 30000}}, {"$and": [{"o_custkey": {"$gt": 1000}}, {"o_orderstatus": "P"}]}]}, "(o_orderstatus = 'F' AND o_totalprice < 30000) OR (o_custkey > 1000 AND o_orderstatus = 'P')", _O)
_find("find_nor", "orders", {"$nor": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 100000}}]}, "NOT (o_orderstatus = 'F' OR o_totalprice > 100000)", _O)
_find("find_not", "orders", {"o_totalprice": {"$not": {"$gte": 100000}}}, "NOT o_totalprice >= 100000", _O)
_find("find_mod", "orders", {"o_orderkey": {"$mod": [7, 3]}}, "o_orderkey % 7 = 3", _O)
_find("find_regex", "orders", {"o_orderpriority": {"$regex": "^[12]-|low$", "$options": "i"}}, "regexp_matches(o_orderpriority, '(?i)^[12]-|low$')", _O)
_find("find_exists", "events", {"props": {"$exists": True}, "nothing": {"$exists": False}}, "props IS NOT NULL", "event_id, user_id")
_find("find_type", "events", {"value": {"$type": "number"}, "event_type": {"$type": "string"}, "user_id": {"$not": {"$type": "string"}}}, "value IS NOT NULL", "event_id, user_id")
_find("find_type_bracket", "events", {"event_type": {"$gte": 5}}, "false", "event_id, user_id")
_find("find_expr", "events", {"$expr": {"$gt": ["$value", {"$divide": ["$user_id", 10]}]}}, "value > user_id / 10.0", "event_id, user_id")
_find("find_bits", "events", {"event_id": {"$bitsAllSet": 5, "$bitsAnyClear": [1, 3]}}, "event_id & 5 = 5 AND event_id & 10 <> 10", "event_id, user_id")
_find("find_json_schema", "orders", {"$jsonSchema": {"required": ["o_orderkey"], "properties": {"o_totalprice": {"type": "number", "minimum": 1000, "maximum": 90000}, "o_orderstatus": {"enum": ["O", "F"]}, "o_orderpriority": {"pattern": "^[1-3]"}}}}, "o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('O', 'F') AND regexp_matches(o_orderpriority, '^[1-3]')", _O)
_find("find_where", "orders", {"$where": lambda c: c("o_totalprice") > c("o_custkey") * 100}, "o_totalprice > o_custkey * 100", _O)
_find("find_sort_offset_limit", "orders", {"o_orderstatus": "O"}, "o_orderstatus = 'O'", "o_orderkey, o_totalprice", "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey OFFSET 100 LIMIT 100", sort=[{"desc": "o_totalprice"}, {"asc": "o_orderkey"}], offset=100, limit=100)
_find("find_multi_sort", "events", {}, "true", "event_id, event_type", "ORDER BY event_type NULLS LAST, event_id DESC LIMIT 250", sort=[{"asc": "event_type"}, {"desc": lambda f: f("event_id")}], limit=250)

# nested and array fields, made from the flat tables first
_ITEMS = [{"$group": {"_id": "$l_orderkey", "items": {"$push": {"sku": "$l_partkey", "qty": "$l_quantity"}}, "flags": {"$addToSet": "$l_returnflag"}}}]
_LISTS = "WITH g AS (SELECT l_orderkey AS _id, list({'sku': l_partkey, 'qty': l_quantity}) AS items, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1)"
_count = lambda d: d.select("_id")
_agg("match_elem_match", "lineitem", [*_ITEMS, {"$match": {"items": {"$elemMatch": {"qty": {"$gte": 40}, "sku": {"$lt": 500}}}}}], f"{_LISTS} SELECT _id FROM g WHERE len(list_filter(items, lambda x: x.qty >= 40 AND x.sku < 500)) > 0", _count)
_agg("match_dotted", "lineitem", [*_ITEMS, {"$match": {"items.qty": {"$gt": 49}}}], f"{_LISTS} SELECT _id FROM g WHERE len(list_filter(items, lambda x: x.qty > 49)) > 0", _count)
_agg("match_all", "lineitem", [*_ITEMS, {"$match": {"flags": {"$all": ["A", "R"]}}}], f"{_LISTS} SELECT _id FROM g WHERE list_contains(flags, 'A') AND list_contains(flags, 'R')", _count)
_agg("match_size", "lineitem", [*_ITEMS, {"$match": {"items": {"$size": 3}}}], f"{_LISTS} SELECT _id FROM g WHERE len(items) = 3", _count)
_agg("match_any_element", "lineitem", [*_ITEMS, {"$match": {"flags": "N"}}], f"{_LISTS} SELECT _id FROM g WHERE list_contains(flags, 'N')", _count)
_queries["match_json_prop"] = lambda spark, d: Collection.from_df(table(spark, d, "events").withColumn("doc", F.parse_json("props"))).find_many({"doc.k": {"$gte": 50}}).rows.select("event_id")
_sql["match_json_prop"] = "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 50"

# stages
_agg("stage_project", "orders", [{"$project": {"_id": 0, "o_orderkey": 1, "year": {"$year": "$o_orderdate"}, "price": "$o_totalprice"}}], "SELECT o_orderkey, year(o_orderdate)::INT AS year, o_totalprice AS price FROM orders")
_agg("stage_project_exclude", "nation", [{"$project": {"n_name": 0}}], "SELECT n_nationkey, n_regionkey FROM nation")
_agg("stage_add_fields", "nation", [{"$addFields": {"n_nationkey": {"$add": ["$n_nationkey", 1]}, "both": {"$add": ["$n_nationkey", "$n_regionkey"]}}}], "SELECT n_nationkey + 1 AS n_nationkey, n_name, n_regionkey, n_nationkey + n_regionkey AS both FROM nation")
_agg("stage_unset", "customer", [{"$unset": ["c_name", "c_acctbal"]}], "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
_agg("stage_replace_root", "nation", [{"$replaceRoot": {"newRoot": {"key": "$n_nationkey", "name": {"$toLower": "$n_name"}}}}], "SELECT n_nationkey AS key, lower(n_name) AS name FROM nation")
_agg("stage_skip_limit", "orders", [{"$sort": {"o_orderkey": 1}}, {"$skip": 50}, {"$limit": 40}, {"$project": {"o_orderkey": 1}}], "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 40 OFFSET 50")
_agg("stage_count", "orders", [{"$match": {"o_orderstatus": "P"}}, {"$count": "n"}], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0")
_agg("stage_sort_by_count", "events", [{"$sortByCount": "$event_type"}], "SELECT event_type AS _id, count(*) AS count FROM events GROUP BY 1")
_agg("stage_bucket", "orders", [{"$bucket": {"groupBy": "$o_totalprice", "boundaries": [0, 50000, 100000, 200000], "default": 999999, "output": {"n": {"$sum": 1}}}}], "SELECT CASE WHEN o_totalprice >= 0 AND o_totalprice < 50000 THEN 0 WHEN o_totalprice >= 50000 AND o_totalprice < 100000 THEN 50000 WHEN o_totalprice >= 100000 AND o_totalprice < 200000 THEN 100000 ELSE 999999 END AS _id, count(*) AS n FROM orders GROUP BY 1")
_agg("stage_bucket_auto", "orders", [{"$bucketAuto": {"groupBy": "$o_orderkey", "buckets": 4}}], "WITH r AS (SELECT o_orderkey AS v, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders), b AS (SELECT v, least(floor(k / greatest(round(n / 4.0), 1)), 3) AS b FROM r), s AS (SELECT b, min(v) AS lo, max(v) AS hi, count(*) AS c FROM b GROUP BY b) SELECT lo AS min, coalesce(lead(lo) OVER (ORDER BY b), hi) AS max, c AS count FROM s", lambda d: d.select("_id.min", "_id.max", "count"))
_U = "WITH g AS (SELECT l_orderkey, list(l_quantity ORDER BY l_quantity, l_partkey, l_extendedprice) AS qs FROM lineitem GROUP BY 1)"
_QS = [{"$group": {"_id": "$l_orderkey", "qs": {"$push": "$l_quantity"}}}, {"$addFields": {"qs": {"$sortArray": {"input": "$qs", "sortBy": 1}}}}]
_agg("stage_unwind", "lineitem", [*_QS, {"$unwind": "$qs"}], f"{_U} SELECT l_orderkey AS _id, unnest(qs) AS qs FROM g")
_agg("stage_unwind_index", "lineitem", [*_QS, {"$unwind": {"path": "$qs", "includeArrayIndex": "i"}}], f"{_U} SELECT l_orderkey AS _id, unnest(qs) AS qs, unnest(range(len(qs)))::BIGINT AS i FROM g")
_agg("stage_unwind_preserve", "orders", [{"$project": {"_id": 0, "o_orderkey": 1, "xs": {"$cond": [{"$eq": ["$o_orderstatus", "F"]}, {"$split": ["$o_orderpriority", "-"]}, None]}}}, {"$unwind": {"path": "$xs", "preserveNullAndEmptyArrays": True}}], "SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN string_split(o_orderpriority, '-') ELSE [NULL] END) AS xs FROM orders")
_agg("stage_facet", "orders", [{"$facet": {"status": [{"$sortByCount": "$o_orderstatus"}, {"$sort": {"_id": 1}}], "total": [{"$count": "n"}]}}], "SELECT (SELECT string_agg(_id || c, ',' ORDER BY _id) FROM (SELECT o_orderstatus AS _id, count(*) AS c FROM orders GROUP BY 1)) AS status, (SELECT count(*) FROM orders) AS total", lambda d: d.select(F.array_join(F.array_sort(F.transform("status", lambda x: F.concat(x["_id"], x["count"].cast("string")))), ",").alias("status"), F.get("total", 0)["n"].alias("total")))
_agg("stage_redact", "orders", [{"$redact": {"$cond": [{"$eq": ["$o_orderstatus", "F"]}, "$$PRUNE", "$$KEEP"]}}, {"$project": {"_id": 0, "o_orderkey": 1}}], "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
_agg("stage_sample", "orders", [{"$sample": {"size": 25}}], None)

# accumulators
_D = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"
_round = lambda *cs: lambda d: d.withColumns({c: F.round(c, 4) for c in cs})
_agg("acc_sum", "lineitem", [{"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "n": {"$sum": 1}, "lines": {"$sum": "$l_linenumber"}}}], "SELECT l_returnflag AS _id, sum(l_quantity) AS qty, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1")
_agg("acc_avg", "lineitem", [{"$match": {"l_quantity": {"$gte": 25}}}, {"$group": {"_id": "$l_returnflag", "n": {"$sum": 1}, "avg_qty": {"$avg": "$l_quantity"}}}, {"$sort": {"_id": 1}}], "SELECT l_returnflag AS _id, count(*) AS n, round(avg(l_quantity), 4) AS avg_qty FROM lineitem WHERE l_quantity >= 25 GROUP BY 1", _round("avg_qty"))
_agg("acc_min_max", "events", [{"$group": {"_id": "$event_type", "lo": {"$min": "$value"}, "hi": {"$max": "$value"}, "first_ts": {"$min": "$ts"}}}], "SELECT event_type AS _id, min(value) AS lo, max(value) AS hi, min(ts) AS first_ts FROM events GROUP BY 1")
_queries["acc_first_last"] = lambda spark, d: Collection.from_df(table(spark, d, "events").withColumn("_seq", F.col("event_id"))).aggregate([{"$group": {"_id": "$user_id", "first": {"$first": "$event_type"}, "last": {"$last": "$event_type"}}}])
_sql["acc_first_last"] = "SELECT user_id AS _id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1"
_queries["acc_push"] = lambda spark, d: Collection.from_df(table(spark, d, "events").withColumn("_seq", F.col("event_id"))).aggregate([{"$group": {"_id": "$user_id", "types": {"$push": "$event_type"}}}]).select("_id", F.array_join("types", ",").alias("types"))
_sql["acc_push"] = "SELECT user_id AS _id, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY 1"
_agg("acc_add_to_set", "events", [{"$group": {"_id": "$user_id", "types": {"$addToSet": "$event_type"}}}], "SELECT user_id AS _id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1", lambda d: d.select("_id", F.array_join(F.array_sort("types"), ",").alias("types")))
_agg("acc_stddev", "events", [{"$group": {"_id": "$event_type", "pop": {"$stdDevPop": "$value"}, "samp": {"$stdDevSamp": "$value"}}}], "SELECT event_type AS _id, round(stddev_pop(value), 4) AS pop, round(stddev_samp(value), 4) AS samp FROM events GROUP BY 1", _round("pop", "samp"))
_agg("acc_covariance", "events", [{"$group": {"_id": "$event_type", "pop": {"$covariancePop": ["$value", "$user_id"]}, "samp": {"$covarianceSamp": ["$value", "$user_id"]}}}], "SELECT event_type AS _id, round(covar_pop(value, user_id), 3) AS pop, round(covar_samp(value, user_id), 3) AS samp FROM events GROUP BY 1", lambda d: d.withColumns({c: F.round(c, 3) for c in ("pop", "samp")}))
_agg("acc_count", "customer", [{"$group": {"_id": "$c_mktsegment", "n": {"$count": {}}}}], "SELECT c_mktsegment AS _id, count(*) AS n FROM customer GROUP BY 1")
_queries["acc_merge_objects"] = lambda spark, d: Collection.from_df(table(spark, d, "events").withColumn("_seq", F.col("event_id"))).aggregate([{"$group": {"_id": "$user_id", "m": {"$mergeObjects": {"kind": "$event_type", "id": "$event_id"}}}}]).select("_id", "m.kind", "m.id")
_sql["acc_merge_objects"] = "SELECT user_id AS _id, arg_max(event_type, event_id) AS kind, max(event_id) AS id FROM events GROUP BY 1"
_agg("acc_top_n", "orders", [{"$group": {"_id": "$o_custkey", "best": {"$topN": {"n": 2, "sortBy": {"o_totalprice": -1, "o_orderkey": 1}, "output": "$o_orderkey"}}, "least": {"$minN": {"n": 2, "input": "$o_orderkey"}}}}], "SELECT o_custkey AS _id, array_to_string(list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:2], ',') AS best, array_to_string(list_sort(list(o_orderkey))[1:2], ',') AS least FROM orders GROUP BY 1", lambda d: d.select("_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("best", "least")]))
_agg("group_compound", "lineitem", [{"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "n": {"$sum": 1}}}], "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2", lambda d: d.select("_id.flag", "_id.status", "n"))
_agg("group_null", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "hi": {"$max": "$o_totalprice"}}}], "SELECT CAST(NULL AS VARCHAR) AS _id, count(*) AS n, max(o_totalprice) AS hi FROM orders")

# expressions
_expr("expr_arith", "lineitem", ["l_orderkey", "l_partkey"], {"net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, "half": {"$divide": ["$l_quantity", 2]}, "zero": {"$divide": ["$l_quantity", 0]}, "m": {"$mod": ["$l_partkey", 7]}, "a": {"$abs": {"$subtract": ["$l_discount", "$l_tax"]}}}, "l_extendedprice * (1 - l_discount) AS net, l_quantity / 2 AS half, CAST(NULL AS DOUBLE) AS zero, l_partkey % 7 AS m, abs(l_discount - l_tax) AS a")
_expr("expr_round", "orders", ["o_orderkey"], {"r": {"$round": [{"$divide": ["$o_totalprice", 1000]}, 0]}, "t": {"$trunc": ["$o_totalprice", 0]}, "c": {"$ceil": "$o_totalprice"}, "f": {"$floor": "$o_totalprice"}}, "round_even(o_totalprice / 1000, 0) AS r, trunc(o_totalprice) AS t, ceil(o_totalprice)::BIGINT AS c, floor(o_totalprice)::BIGINT AS f")
_expr("expr_compare", "lineitem", ["l_orderkey", "l_partkey"], {"eq": {"$eq": ["$l_returnflag", "R"]}, "ne": {"$ne": ["$l_returnflag", "R"]}, "gt": {"$gt": ["$l_quantity", 25]}, "lte": {"$lte": ["$l_tax", "$l_discount"]}, "cmp": {"$cmp": ["$l_tax", "$l_discount"]}, "kinds": {"$lt": ["$l_quantity", "text"]}}, "l_returnflag = 'R' AS eq, l_returnflag <> 'R' AS ne, l_quantity > 25 AS gt, l_tax <= l_discount AS lte, CASE WHEN l_tax = l_discount THEN 0 WHEN l_tax < l_discount THEN -1 ELSE 1 END AS cmp, true AS kinds")
_expr("expr_bool", "orders", ["o_orderkey"], {"a": {"$and": [{"$eq": ["$o_orderstatus", "F"]}, "$o_totalprice"]}, "o": {"$or": [None, {"$gt": ["$o_totalprice", 100000]}]}, "n": {"$not": [{"$eq": ["$o_orderstatus", "O"]}]}}, "o_orderstatus = 'F' AND o_totalprice <> 0 AS a, o_totalprice > 100000 AS o, o_orderstatus <> 'O' AS n")
_expr("expr_cond", "orders", ["o_orderkey"], {"size": {"$cond": {"if": {"$gte": ["$o_totalprice", 100000]}, "then": "big", "else": "small"}}}, "CASE WHEN o_totalprice >= 100000 THEN 'big' ELSE 'small' END AS size")
_expr("expr_switch", "orders", ["o_orderkey"], {"s": {"$switch": {"branches": [{"case": {"$eq": ["$o_orderstatus", "F"]}, "then": 1}, {"case": {"$eq": ["$o_orderstatus", "O"]}, "then": 2}], "default": 0}}}, "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS s")
_expr("expr_ifnull", "orders", ["o_orderkey"], {"x": {"$ifNull": [{"$cond": [{"$eq": ["$o_orderstatus", "F"]}, None, "$o_orderpriority"]}, "none"]}}, "CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderpriority END AS x")
_expr("expr_let", "orders", ["o_orderkey"], {"x": {"$let": {"vars": {"p": {"$multiply": ["$o_totalprice", 2]}}, "in": {"$add": ["$$p", "$$p"]}}}}, "o_totalprice * 2 + o_totalprice * 2 AS x")
_expr("expr_string", "customer", ["c_custkey"], {"j": {"$concat": ["$c_name", "/", "$c_mktsegment"]}, "l": {"$toLower": "$c_mktsegment"}, "u": {"$toUpper": "$c_name"}, "n": {"$strLenCP": "$c_name"}, "b": {"$strLenBytes": "$c_name"}, "at": {"$indexOfCP": ["$c_mktsegment", "I"]}, "same": {"$strcasecmp": ["$c_mktsegment", "building"]}, "all": {"$replaceAll": {"input": "$c_mktsegment", "find": "I", "replacement": "ii"}}, "one": {"$replaceOne": {"input": "$c_mktsegment", "find": "I", "replacement": "ii"}}}, "c_name || '/' || c_mktsegment AS j, lower(c_mktsegment) AS l, upper(c_name) AS u, length(c_name)::INT AS n, strlen(c_name)::INT AS b, (instr(c_mktsegment, 'I') - 1)::INT AS at, CASE WHEN upper(c_mktsegment) = 'BUILDING' THEN 0 WHEN upper(c_mktsegment) < 'BUILDING' THEN -1 ELSE 1 END AS same, replace(c_mktsegment, 'I', 'ii') AS \"all\", regexp_replace(c_mktsegment, 'I', 'ii') AS one")
_expr("expr_substr", "customer", ["c_custkey"], {"a": {"$substrCP": ["$c_name", 2, 5]}, "b": {"$substr": ["$c_name", 3, -1]}, "c": {"$substrBytes": ["$c_name", 0, 4]}}, "substr(c_name, 3, 5) AS a, substr(c_name, 4) AS b, substr(c_name, 1, 4) AS c")
_expr("expr_split", "pages", ["page_id"], {"host": {"$arrayElemAt": [{"$split": ["$url", "/"]}, 2]}, "last": {"$arrayElemAt": [{"$split": ["$url", "."]}, -1]}}, "string_split(url, '/')[3] AS host, string_split(url, '.')[-1] AS last")
_expr("expr_trim", "nation", ["n_nationkey"], {"t": {"$trim": {"input": {"$concat": ["  ", "$n_name", " "]}}}, "l": {"$ltrim": {"input": {"$concat": ["xx", "$n_name"]}, "chars": "x"}}, "r": {"$rtrim": {"input": {"$concat": ["$n_name", "--"]}, "chars": "-"}}}, "n_name AS t, n_name AS l, n_name AS r")
_expr("expr_regex", "pages", ["page_id"], {"secure": {"$regexMatch": {"input": "$url", "regex": "^https"}}, "id": {"$getField": {"field": "match", "input": {"$regexFind": {"input": "$url", "regex": "[0-9]+"}}}}, "n": {"$size": {"$regexFindAll": {"input": "$url", "regex": "/"}}}}, "starts_with(url, 'https') AS secure, nullif(regexp_extract(url, '[0-9]+'), '') AS id, (length(url) - length(replace(url, '/', '')))::INT AS n")
_expr("expr_date_parts", "events", ["event_id"], {"y": {"$year": "$ts"}, "mo": {"$month": "$ts"}, "d": {"$dayOfMonth": "$ts"}, "h": {"$hour": "$ts"}, "mi": {"$minute": "$ts"}, "s": {"$second": "$ts"}, "ms": {"$millisecond": "$ts"}, "doy": {"$dayOfYear": "$ts"}, "dow": {"$dayOfWeek": "$ts"}}, "year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s, (millisecond(ts) % 1000)::INT AS ms, dayofyear(ts)::INT AS doy, (dayofweek(ts) + 1)::INT AS dow")
_expr("expr_iso_week", "orders", ["o_orderkey"], {"w": {"$isoWeek": "$o_orderdate"}, "d": {"$isoDayOfWeek": "$o_orderdate"}, "y": {"$isoWeekYear": "$o_orderdate"}}, "weekofyear(o_orderdate)::INT AS w, isodow(o_orderdate)::INT AS d, isoyear(o_orderdate)::INT AS y")
_expr("expr_week", "orders", ["o_orderkey"], {"w": {"$week": "$o_orderdate"}}, "strftime(o_orderdate, '%U')::INT AS w")
_expr("expr_date_string", "orders", ["o_orderkey"], {"s": {"$dateToString": {"date": "$o_orderdate", "format": "%Y-%m-%d week %V"}}, "back": {"$dateToString": {"date": {"$dateFromString": {"dateString": {"$dateToString": {"date": "$o_orderdate", "format": "%d/%m/%Y"}}, "format": "%d/%m/%Y"}}, "format": "%Y%m%d"}}}, "strftime(o_orderdate, '%Y-%m-%d week %V') AS s, strftime(o_orderdate, '%Y%m%d') AS back")
_expr("expr_date_math", "orders", ["o_orderkey"], {"later": {"$dateAdd": {"startDate": "$o_orderdate", "unit": "month", "amount": 1}}, "before": {"$dateSubtract": {"startDate": "$o_orderdate", "unit": "day", "amount": 3}}, "month": {"$dateTrunc": {"date": "$o_orderdate", "unit": "month"}}, "plus": {"$add": ["$o_orderdate", 60000]}, "gap": {"$subtract": [{"$add": ["$o_orderdate", 60000]}, "$o_orderdate"]}, "months": {"$dateDiff": {"startDate": datetime.datetime(1990, 1, 15), "endDate": "$o_orderdate", "unit": "month"}}}, "o_orderdate + INTERVAL 1 MONTH AS later, o_orderdate - INTERVAL 3 DAY AS before, date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderdate + INTERVAL 60 SECOND AS plus, 60000::BIGINT AS gap, datediff('month', TIMESTAMP '1990-01-15', o_orderdate)::BIGINT AS months")
_text = lambda *cs: lambda d: d.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in cs})
_expr("expr_array", "nation", ["n_nationkey"], {"r": {"$range": [0, "$n_regionkey"]}, "rev": {"$reverseArray": {"$range": [0, 4]}}, "cat": {"$concatArrays": [["$n_nationkey"], [7, 8]]}, "sl": {"$slice": [{"$range": [0, 6]}, -2]}, "sl2": {"$slice": [{"$range": [0, 6]}, 1, 3]}, "has": {"$in": ["$n_regionkey", [1, 2]]}, "at": {"$indexOfArray": [[5, 3, 1], "$n_regionkey"]}, "n": {"$size": {"$range": [0, "$n_nationkey"]}}, "f": {"$first": [[9, 8]]}, "isa": {"$isArray": [["$n_name"]]}}, "array_to_string(range(0, n_regionkey), ',') AS r, '3,2,1,0' AS rev, n_nationkey || ',7,8' AS cat, '4,5' AS sl, '1,2,3' AS sl2, n_regionkey IN (1, 2) AS has, CASE n_regionkey WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE -1 END AS at, n_nationkey AS n, 9 AS f, true AS isa", _text("r", "rev", "cat", "sl", "sl2"))
_expr("expr_map_filter_reduce", "nation", ["n_nationkey"], {"m": {"$map": {"input": {"$range": [0, 4]}, "as": "x", "in": {"$multiply": ["$$x", "$n_regionkey"]}}}, "f": {"$filter": {"input": {"$range": [0, 8]}, "as": "x", "cond": {"$gt": ["$$x", "$n_regionkey"]}}}, "s": {"$reduce": {"input": {"$range": [0, "$n_nationkey"]}, "initialValue": 0, "in": {"$add": ["$$value", "$$this"]}}}}, "array_to_string([0, n_regionkey, 2 * n_regionkey, 3 * n_regionkey], ',') AS m, array_to_string(range(n_regionkey + 1, 8), ',') AS f, n_nationkey * (n_nationkey - 1) // 2 AS s", _text("m", "f"))
_expr("expr_zip", "nation", ["n_nationkey"], {"z": {"$map": {"input": {"$zip": {"inputs": [["$n_nationkey", 1], [10, 20, 30]]}}, "as": "p", "in": {"$add": [{"$arrayElemAt": ["$$p", 0]}, {"$arrayElemAt": ["$$p", 1]}]}}}}, "(n_nationkey + 10) || ',21' AS z", _text("z"))
_expr("expr_set", "nation", ["n_nationkey"], {"u": {"$setUnion": [["$n_regionkey"], [1, 2]]}, "i": {"$setIntersection": [["$n_regionkey", 2], [1, 2]]}, "d": {"$setDifference": [[1, 2, 3], ["$n_regionkey"]]}, "e": {"$setEquals": [["$n_regionkey", 1], [1, "$n_regionkey", 1]]}, "s": {"$setIsSubset": [["$n_regionkey"], [0, 1, 2]]}, "all": {"$allElementsTrue": [["$n_regionkey", 1]]}, "any": {"$anyElementTrue": [["$n_regionkey", 0]]}}, "array_to_string(list_sort(list_distinct([n_regionkey, 1, 2])), ',') AS u, CASE WHEN n_regionkey = 1 THEN '1,2' ELSE '2' END AS i, array_to_string(list_filter([1, 2, 3], lambda x: x <> n_regionkey), ',') AS d, true AS e, n_regionkey IN (0, 1, 2) AS s, n_regionkey <> 0 AS \"all\", n_regionkey <> 0 AS \"any\"", lambda d: _text("u", "i", "d")(d.withColumns({c: F.array_sort(c) for c in ("u", "i", "d")})))
_agg("expr_object", "nation", [{"$project": {"_id": 0, "n_nationkey": 1, "m": {"$mergeObjects": [{"a": "$n_regionkey", "b": 1}, {"b": 2}]}, "kv": {"$objectToArray": {"x": "$n_name", "y": "z"}}, "back": {"$arrayToObject": [[{"k": "name", "v": "$n_name"}]]}}}], "SELECT n_nationkey, n_regionkey AS a, 2 AS b, 'x=' || n_name || ',y=z' AS kv, n_name AS back FROM nation", lambda d: d.select("n_nationkey", "m.a", "m.b", F.array_join(F.transform("kv", lambda x: F.concat(x["k"], F.lit("="), x["v"])), ",").alias("kv"), F.col("back")["name"].alias("back")))
_expr("expr_type", "events", ["event_id"], {"t": {"$type": "$value"}, "num": {"$isNumber": "$event_type"}, "i": {"$toInt": "$value"}, "s": {"$toString": "$event_id"}, "d": {"$toDouble": "$event_type"}, "b": {"$toBool": "$user_id"}, "c": {"$convert": {"input": "$event_type", "to": "int", "onError": -1}}}, "'double' AS t, false AS num, trunc(value)::INT AS i, event_id::VARCHAR AS s, CAST(NULL AS DOUBLE) AS d, user_id <> 0 AS b, -1 AS c")
_expr("expr_trig", "customer", ["c_custkey"], {"s": {"$round": [{"$sin": "$c_acctbal"}, 6]}, "c": {"$round": [{"$add": [2, {"$cos": {"$degreesToRadians": "$c_custkey"}}]}, 6]}, "t": {"$round": [{"$atan2": ["$c_acctbal", 100]}, 6]}, "h": {"$round": [{"$tanh": {"$divide": ["$c_acctbal", 5000]}}, 6]}, "l": {"$round": [{"$log": [{"$add": ["$c_custkey", 1]}, 2]}, 6]}, "p": {"$pow": ["$c_nationkey", 2]}, "e": {"$round": [{"$sqrt": "$c_custkey"}, 6]}}, "round(sin(c_acctbal), 6) AS s, round(2 + cos(radians(c_custkey)), 6) AS c, round(atan2(c_acctbal, 100), 6) AS t, round(tanh(c_acctbal / 5000), 6) AS h, round(log2(c_custkey + 1), 6) AS l, pow(c_nationkey, 2) AS p, round(sqrt(c_custkey), 6) AS e")
_expr("expr_bitwise", "events", ["event_id"], {"a": {"$bitAnd": ["$event_id", "$user_id"]}, "o": {"$bitOr": ["$event_id", "$user_id"]}, "x": {"$bitXor": ["$event_id", "$user_id"]}}, "event_id & user_id AS a, event_id | user_id AS o, xor(event_id, user_id) AS x")

# updates
_C = "c_custkey, c_name, c_nationkey"
_update("update_set", "customer", {"c_mktsegment": "BUILDING"}, {"$set": {"c_mktsegment": "HOUSES", "note": "moved"}}, f"SELECT {_C}, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'moved' END AS note FROM customer")
_update("update_unset", "customer", {"c_acctbal": {"$lt": 0}}, {"$unset": {"c_acctbal": ""}}, f"SELECT {_C}, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
_update("update_inc", "customer", {"c_nationkey": {"$lte": 5}}, {"$inc": {"c_custkey": 1000000}}, "SELECT CASE WHEN c_nationkey <= 5 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
_update("update_mul", "part", {"p_size": {"$gt": 25}}, {"$mul": {"p_retailprice": 2}}, "SELECT p_partkey, p_name, p_brand, p_type, p_size, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice FROM part")
_update("update_min_max", "part", {}, {"$min": {"p_size": 20}, "$max": {"p_retailprice": 1000.0}}, "SELECT p_partkey, p_name, p_brand, p_type, least(p_size, 20) AS p_size, greatest(p_retailprice, 1000.0) AS p_retailprice FROM part")
_update("update_rename", "nation", {"n_regionkey": 1}, {"$rename": {"n_name": "title"}}, "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS n_name, n_regionkey, CASE WHEN n_regionkey = 1 THEN n_name END AS title FROM nation")
_update("update_push", "nation", {"n_regionkey": 2}, {"$push": {"tags": "x"}}, "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_regionkey = 2 THEN 'x' END AS tags FROM nation", lambda d: d.withColumn("tags", F.array_join("tags", ",")))

# joins, unions, windows
_agg("lookup_orders_customer", "customer", [{"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}}, {"$project": {"_id": 0, "c_custkey": 1, "n": {"$size": "$orders"}, "top": {"$reduce": {"input": "$orders.o_totalprice", "initialValue": 0.0, "in": {"$cond": [{"$gt": ["$$this", "$$value"]}, "$$this", "$$value"]}}}}}], "SELECT c_custkey, count(o_orderkey)::INT AS n, coalesce(max(o_totalprice), 0.0)::DOUBLE AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", None, ("orders",))
_agg("union_with", "nation", [{"$project": {"_id": 0, "name": "$n_name"}}, {"$unionWith": {"coll": "region", "pipeline": [{"$project": {"_id": 0, "name": "$r_name"}}]}}], "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region", None, ("region",))
_agg("window_rank", "orders", [{"$setWindowFields": {"partitionBy": "$o_custkey", "sortBy": {"o_orderkey": 1}, "output": {"n": {"$documentNumber": {}}, "r": {"$rank": {}}, "d": {"$denseRank": {}}}}}, {"$project": {"_id": 0, "o_orderkey": 1, "n": 1, "r": 1, "d": 1}}], "SELECT o_orderkey, (row_number() OVER w)::INT AS n, (rank() OVER w)::INT AS r, (dense_rank() OVER w)::INT AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_agg("window_running_sum", "events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"run": {"$sum": "$event_id", "window": {"documents": ["unbounded", "current"]}}, "near": {"$max": "$value", "window": {"documents": [-1, 1]}}}}}, {"$project": {"_id": 0, "event_id": 1, "run": 1, "near": 1}}], "SELECT event_id, (sum(event_id) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS run, max(value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
_agg("window_shift", "events", [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": {"prev": {"$shift": {"output": "$event_type", "by": -1, "default": "none"}}}}}, {"$project": {"_id": 0, "event_id": 1, "prev": 1}}], "SELECT event_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), 'none') AS prev FROM events")


# families of operators, each with all of its members
_find("find_bits_any", "events", {"event_id": {"$bitsAnySet": 5, "$bitsAllClear": [1, 3]}}, "event_id & 5 <> 0 AND event_id & 10 = 0", "event_id, user_id")
_find("find_eq_operator", "orders", {"o_orderstatus": {"$eq": "F"}, "o_orderpriority": re.compile("^[12]-")}, "o_orderstatus = 'F' AND regexp_matches(o_orderpriority, '^[12]-')", _O)
_find("find_negative_offset", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", "o_orderkey, o_totalprice", "ORDER BY o_orderkey DESC LIMIT 30", sort={"asc": "o_orderkey"}, offset=-30)
_X = {"$divide": ["$c_acctbal", 20000]}
_TRIG = {"$tan": "tan", "$asin": "asin", "$acos": "acos", "$atan": "atan", "$sinh": "sinh", "$cosh": "cosh", "$asinh": "asinh", "$atanh": "atanh", "$radiansToDegrees": "degrees", "$exp": "exp"}
_expr("expr_trig_all", "customer", ["c_custkey"], {f"f_{f}": {"$round": [{"$add": [2, {o: _X}]}, 6]} for o, f in _TRIG.items()}, ", ".join(f"round(2 + {f}(c_acctbal / 20000), 6) AS f_{f}" for f in _TRIG.values()))
_expr("expr_logs", "customer", ["c_custkey"], {"e": {"$round": [{"$ln": {"$add": ["$c_custkey", 1]}}, 6]}, "t": {"$round": [{"$log10": {"$add": ["$c_custkey", 1]}}, 6]}, "h": {"$round": [{"$acosh": {"$add": ["$c_custkey", 1]}}, 6]}}, "round(ln(c_custkey + 1), 6) AS e, round(log10(c_custkey + 1), 6) AS t, round(acosh(c_custkey + 1), 6) AS h")
_expr("expr_bit_not", "events", ["event_id"], {"x": {"$bitNot": "$event_id"}}, "~event_id AS x")
_expr("expr_convert_all", "events", ["event_id"], {"l": {"$toLong": {"$toString": "$event_id"}}, "d": {"$toDouble": {"$toDecimal": "$event_id"}}, "ms": {"$toLong": {"$toDate": {"$toLong": "$ts"}}}, "y": {"$year": {"$toDate": {"$toString": "$ts"}}}}, "event_id AS l, event_id::DOUBLE AS d, epoch_us(ts) // 1000 AS ms, year(ts)::INT AS y")
_expr("expr_set_field", "nation", ["n_nationkey"], {"a": {"$setField": {"field": "y", "input": {"x": "$n_name"}, "value": "$n_regionkey"}}, "b": {"$unsetField": {"field": "x", "input": {"x": "$n_name", "z": 1}}}}, "n_name AS x, n_regionkey AS y, 1 AS z", lambda d: d.select("n_nationkey", "a.x", "a.y", "b.z"))
_expr("expr_date_to_parts", "events", ["event_id"], {"p": {"$dateToParts": {"date": "$ts"}}, "m": {"$dateFromParts": {"year": {"$year": "$ts"}, "month": {"$month": "$ts"}, "day": 1}}}, "year(ts)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, hour(ts)::INT AS hour, date_trunc('month', ts)::TIMESTAMP AS m", lambda d: d.select("event_id", "p.year", "p.month", "p.day", "p.hour", d["m"].cast("timestamp_ntz").alias("m")))
_expr("expr_variables", "nation", ["n_nationkey"], {"r": "$$ROOT.n_name", "c": "$$CURRENT.n_regionkey", "later": {"$gt": ["$$NOW", datetime.datetime(2020, 1, 1)]}, "gone": {"$ifNull": ["$$REMOVE", "gone"]}, "lit": {"$literal": "$n_name"}}, "n_name AS r, n_regionkey AS c, true AS later, 'gone' AS gone, '$n_name' AS lit")
_NS = ["$n_nationkey", 3, "$n_regionkey", 9]
_expr("expr_array_n", "nation", ["n_nationkey"], {"l": {"$last": [_NS]}, "no": {"$nin": ["$n_nationkey", [1, 2, 3]]}, "f2": {"$firstN": {"n": 2, "input": _NS}}, "l2": {"$lastN": {"n": 2, "input": _NS}}, "hi": {"$maxN": {"n": 2, "input": _NS}}, "lo": {"$minN": {"n": 2, "input": _NS}}, "at": {"$indexOfBytes": ["$n_name", "_"]}},
      "9 AS l, n_nationkey NOT IN (1, 2, 3) AS no, n_nationkey || ',3' AS f2, n_regionkey || ',9' AS l2, array_to_string(list_reverse_sort([n_nationkey, 3, n_regionkey, 9])[1:2], ',') AS hi, array_to_string(list_sort([n_nationkey, 3, n_regionkey, 9])[1:2], ',') AS lo, instr(n_name, '_') - 1 AS at", _text("f2", "l2", "hi", "lo"))
_expr("expr_function", "nation", ["n_nationkey"], {"x": {"$function": {"body": lambda a, b: a * 10 + b, "args": ["$n_nationkey", "$n_regionkey"]}}, "r": {"$lt": [{"$rand": {}}, 1]}}, "n_nationkey * 10 + n_regionkey AS x, true AS r")
_seq_events = lambda spark, d: Collection.from_df(table(spark, d, "events").withColumn("_seq", F.col("event_id")))
_joined = lambda *cs: lambda d: d.select("_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in cs])
_queries["acc_first_n"] = lambda spark, d: _joined("f", "l", "hi")(_seq_events(spark, d).aggregate([{"$group": {"_id": "$user_id", "f": {"$firstN": {"n": 2, "input": "$event_id"}}, "l": {"$lastN": {"n": 2, "input": "$event_id"}}, "hi": {"$maxN": {"n": 2, "input": "$event_id"}}}}]))
_sql["acc_first_n"] = "SELECT user_id AS _id, array_to_string(list_sort(list(event_id))[1:2], ',') AS f, array_to_string(list_sort(list(event_id))[-2:], ',') AS l, array_to_string(list_reverse_sort(list(event_id))[1:2], ',') AS hi FROM events GROUP BY 1"
_BY = {"event_type": -1, "event_id": 1}
_queries["acc_top_bottom"] = lambda spark, d: _seq_events(spark, d).aggregate([{"$group": {"_id": "$user_id", "t": {"$top": {"sortBy": _BY, "output": "$event_id"}}, "b": {"$bottom": {"sortBy": _BY, "output": "$event_id"}}, "b2": {"$bottomN": {"n": 2, "sortBy": _BY, "output": "$event_id"}}}}]).withColumn("b2", F.array_join("b2", ","))
_sql["acc_top_bottom"] = "WITH g AS (SELECT user_id AS _id, list(event_id ORDER BY event_type DESC, event_id) AS x FROM events GROUP BY 1) SELECT _id, x[1] AS t, x[-1] AS b, array_to_string(x[-2:], ',') AS b2 FROM g"
_agg("acc_accumulator", "events", [{"$group": {"_id": "$event_type", "x": {"$accumulator": {"body": lambda c: F.sum(c * 2), "args": ["$event_id"]}}}}], "SELECT event_type AS _id, sum(event_id * 2)::BIGINT AS x FROM events GROUP BY 1")
_agg("stage_replace_with", "nation", [{"$replaceWith": {"key": "$n_nationkey", "name": "$n_name"}}, {"$set": {"twice": {"$multiply": ["$key", 2]}}}], "SELECT n_nationkey AS key, n_name AS name, n_nationkey * 2 AS twice FROM nation")
_GAPS = [{"$project": {"_id": 0, "event_id": 1, "user_id": 1, "v": {"$cond": [{"$eq": [{"$mod": ["$event_id", 3]}, 0]}, "$event_id", None]}}}]
_GAPS_SQL = "WITH g AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN event_id END AS v FROM events)"
_agg("stage_fill", "events", [*_GAPS, {"$fill": {"output": {"v": {"value": -1}}}}], f"{_GAPS_SQL} SELECT event_id, user_id, coalesce(v, -1) AS v FROM g")
_agg("stage_fill_locf", "events", [*_GAPS, {"$fill": {"partitionByFields": ["user_id"], "sortBy": {"event_id": 1}, "output": {"v": {"method": "locf"}}}}, {"$set": {"v": {"$toDouble": "$v"}}}], f"{_GAPS_SQL} SELECT event_id, user_id, (last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS v FROM g")
_agg("stage_fill_linear", "events", [*_GAPS, {"$fill": {"partitionByFields": ["user_id"], "sortBy": {"event_id": 1}, "output": {"v": {"method": "linear"}}}}, {"$set": {"v": {"$round": ["$v", 4]}}}],
     f"{_GAPS_SQL} SELECT event_id, user_id, CASE WHEN first_value(v IGNORE NULLS) OVER b IS NOT NULL AND last_value(v IGNORE NULLS) OVER a IS NOT NULL THEN event_id::DOUBLE END AS v FROM g WINDOW a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
_agg("stage_densify", "nation", [{"$match": {"n_nationkey": {"$mod": [4, 0]}}}, {"$project": {"_id": 0, "n_nationkey": 1, "n_name": 1}}, {"$densify": {"field": "n_nationkey", "range": {"step": 2, "bounds": "full"}}}], "SELECT k::INT AS n_nationkey, n_name FROM range(0, (SELECT max(n_nationkey) FROM nation WHERE n_nationkey % 4 = 0) + 1, 2) t(k) LEFT JOIN nation ON n_nationkey = k AND n_nationkey % 4 = 0", lambda d: d.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name"))
_agg("stage_project_slice", "lineitem", [*_QS, {"$project": {"qs": {"$slice": 2}}}], f"{_U} SELECT l_orderkey AS _id, array_to_string(qs[1:2], ',') AS qs FROM g", lambda d: d.withColumn("qs", F.array_join(F.transform("qs", lambda x: x.cast("string")), ",")))
_agg("stage_project_elem_match", "lineitem", [*_QS, {"$project": {"qs": {"$elemMatch": {"$gte": 30}}}}], f"{_U} SELECT l_orderkey AS _id, list_filter(qs, lambda x: x >= 30)[1] AS qs FROM g")
_agg("stage_redact_descend", "nation", [{"$project": {"_id": 0, "n_nationkey": 1, "level": {"$literal": 0}, "sub": {"level": "$n_regionkey", "name": "$n_name"}}}, {"$redact": {"$cond": [{"$gt": ["$level", 2]}, "$$PRUNE", "$$DESCEND"]}}], "SELECT n_nationkey, CASE WHEN n_regionkey <= 2 THEN n_name END AS name FROM nation", lambda d: d.select("n_nationkey", "sub.name"))
_W = "PARTITION BY user_id ORDER BY event_id"
_windowed = lambda out, *cs: [{"$setWindowFields": {"partitionBy": "$user_id", "sortBy": {"event_id": 1}, "output": out}}, {"$project": {"_id": 0, "event_id": 1, **{c: 1 for c in out}}}]
_near = {"window": {"documents": [-2, 1]}}
_agg("window_frames", "events", _windowed({"lo": {"$min": "$event_id", **_near}, "avg": {"$avg": "$event_id", **_near}, "f": {"$first": "$event_id", **_near}, "l": {"$last": "$event_id", **_near}, "n": {"$count": {}, **_near}, "r": {"$sum": "$event_id", "window": {"range": [-50, 50]}}}),
     f"SELECT event_id, min(event_id) OVER w AS lo, avg(event_id) OVER w AS avg, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, count(*) OVER w AS n, (sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING))::BIGINT AS r FROM events WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)")
_odd = {"$cond": [{"$eq": [{"$mod": ["$event_id", 2]}, 1]}, "$event_type", None]}
_agg("window_push", "events", _windowed({"p": {"$push": _odd, **_near}, "s": {"$addToSet": "$event_type", **_near}}), f"SELECT event_id, array_to_string(list_transform(list(CASE WHEN event_id % 2 = 1 THEN event_type END) OVER w, lambda x: coalesce(x, '-')), ',') AS p, array_to_string(list_sort(list_distinct(list(event_type) OVER w)), ',') AS s FROM events WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", lambda d: d.select("event_id", F.array_join("p", ",", "-").alias("p"), F.array_join("s", ",").alias("s")))
_agg("window_spread", "events", _windowed({"sd": {"$stdDevPop": "$value", **_near}, "ss": {"$stdDevSamp": "$event_id", **_near}, "cp": {"$covariancePop": ["$event_id", "$user_id"], **_near}, "cs": {"$covarianceSamp": ["$event_id", "$event_id"], **_near}}), f"SELECT event_id, round(stddev_pop(value) OVER w, 3) AS sd, round(stddev_samp(event_id) OVER w, 3) AS ss, round(covar_pop(event_id, user_id) OVER w, 3) + 0.0 AS cp, round(covar_samp(event_id, event_id) OVER w, 2) AS cs FROM events WINDOW w AS ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", lambda d: d.select("event_id", F.round("sd", 3).alias("sd"), F.round("ss", 3).alias("ss"), (F.round("cp", 3) + F.lit(0.0)).alias("cp"), F.round("cs", 2).alias("cs")))
_agg("window_slopes", "events", _windowed({"d": {"$derivative": {"input": "$user_id"}, "window": {"documents": [-1, 0]}}, "i": {"$integral": {"input": "$user_id"}, "window": {"documents": ["unbounded", "current"]}}}), f"SELECT event_id, CASE WHEN lag(event_id) OVER ({_W}) IS NOT NULL THEN 0.0::DOUBLE END AS d, (user_id * (event_id - min(event_id) OVER ({_W})))::DOUBLE AS i FROM events")
_queries["window_exp_moving_avg"] = lambda spark, d: Collection.from_df(table(spark, d, "nation")).aggregate([{"$setWindowFields": {"partitionBy": "$n_regionkey", "sortBy": {"n_nationkey": 1}, "output": {"e": {"$expMovingAvg": {"input": "$n_nationkey", "N": 3}}}}}]).select("n_nationkey", F.round("e", 6).alias("e"))
_sql["window_exp_moving_avg"] = """
WITH RECURSIVE o AS (SELECT n_nationkey AS k, n_regionkey AS r, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation),
e(r, i, k, x) AS (SELECT r, i, k, k::DOUBLE FROM o WHERE i = 1 UNION ALL SELECT o.r, o.i, o.k, 0.5 * o.k + 0.5 * e.x FROM e JOIN o ON o.r = e.r AND o.i = e.i + 1)
SELECT k AS n_nationkey, round(x, 6) AS e FROM e"""
_agg("lookup_array", "region", [{"$project": {"_id": 0, "r_regionkey": 1, "keys": ["$r_regionkey", {"$add": ["$r_regionkey", 10]}, "$r_regionkey"]}}, {"$lookup": {"from": "nation", "localField": "keys", "foreignField": "n_nationkey", "as": "ns"}}], "SELECT r_regionkey, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation WHERE n_nationkey IN (r_regionkey, r_regionkey + 10)) AS names FROM region", lambda d: d.select("r_regionkey", F.array_join(F.array_sort("ns.n_name"), ",").alias("names")), ("nation",))
_agg("graph_lookup", "nation", [{"$graphLookup": {"from": "nation", "startWith": "$n_regionkey", "connectFromField": "n_regionkey", "connectToField": "n_nationkey", "as": "up", "depthField": "depth"}}],
     "WITH RECURSIVE r(s, k, depth) AS (SELECT DISTINCT n_regionkey, n_regionkey, 0 FROM nation UNION SELECT r.s, n.n_regionkey, r.depth + 1 FROM r JOIN nation n ON n.n_nationkey = r.k WHERE r.depth < 30), f AS (SELECT s, k, min(depth) AS depth FROM r JOIN nation ON n_nationkey = k GROUP BY 1, 2) SELECT n_nationkey, (SELECT string_agg(k || ':' || depth, ',' ORDER BY k) FROM f WHERE s = n_regionkey) AS up FROM nation",
     lambda d: d.select("n_nationkey", F.array_join(F.transform(F.array_sort(F.transform("up", lambda x: F.struct(x["n_nationkey"].alias("k"), x["depth"].alias("d")))), lambda x: F.concat(x["k"].cast("string"), F.lit(":"), x["d"].cast("string"))), ",").alias("up")), ("nation",))


def _update_lists(name: str, delta: dict, sql: str) -> None:
    """Deltas of arrays and objects, over [n_regionkey, 1, 2] and a null object."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        made = table(spark, d, "nation").select("n_nationkey", "n_regionkey", F.array("n_regionkey", F.lit(1), F.lit(2)).alias("xs"), F.when(F.col("n_regionkey") > 1, F.struct(F.col("n_name").alias("a"), F.lit(1).alias("b"))).alias("o"))
        out = update(made, {"n_nationkey": {"$gte": 5}}, delta)
        return out.select("n_nationkey", F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("xs"), F.col("o.a").alias("a"), F.col("o.b").cast("double").alias("b"))

    _queries[name] = run
    _sql[name] = f"WITH t AS (SELECT *, [n_regionkey, 1, 2] AS xs, n_nationkey >= 5 AS m, CASE WHEN n_regionkey > 1 THEN n_name END AS a, CASE WHEN n_regionkey > 1 THEN 1 END AS b FROM nation) SELECT n_nationkey, array_to_string({sql}, ',') AS xs, a, ({'CASE WHEN m THEN 7 ELSE b END' if 'o.b' in str(delta) else 'b'})::DOUBLE AS b FROM t"


_update_lists("update_pull", {"$pull": {"xs": {"$gte": 2}}}, "CASE WHEN m THEN list_filter(xs, lambda x: x < 2) ELSE xs END")
_update_lists("update_pull_all", {"$pullAll": {"xs": [1, 3]}}, "CASE WHEN m THEN list_filter(xs, lambda x: x NOT IN (1, 3)) ELSE xs END")
_update_lists("update_pop", {"$pop": {"xs": 1}}, "CASE WHEN m THEN xs[1:2] ELSE xs END")
_update_lists("update_add_to_set", {"$addToSet": {"xs": {"$each": [1, 8]}}}, "CASE WHEN m THEN list_append(xs, 8) ELSE xs END")
_update_lists("update_dotted", {"$set": {"o.b": 7}}, "xs")
_queries["update_current_date"] = lambda spark, d: update(table(spark, d, "nation"), {"n_regionkey": 1}, {"$currentDate": {"at": True}}).select("n_nationkey", (F.col("at") > F.lit("2020-01-01").cast("timestamp")).alias("now"))
_sql["update_current_date"] = "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN true END AS now FROM nation"


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
