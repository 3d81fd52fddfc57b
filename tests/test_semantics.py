"""Nulls, arrays, nesting, dates and groups, which the driver's tables don't have."""

import datetime

import pytest

from docmill import Collection, QueryError
from docmill.functions.predicate import compile_query
from docmill.operators.update import update

ROWS = [(1, None, ["x", "y"], (1, [("s", 2)])), (2, 5, [], (2, [])), (3, 7, None, (None, None)), (4, 5, ["x", None], (9, [("t", 8), ("s", 1)]))]
SCHEMA = "id int, a int, tags array<string>, n struct<b: int, items: array<struct<sku: string, qty: int>>>"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("id", "_id").coalesce(1)


@pytest.mark.parametrize(
    ("query", "ids"),
    [
        ({"a": None}, [1]), ({"a": {"$ne": 5}}, [1, 3]), ({"a": {"$ne": None}}, [2, 3, 4]), ({"a": {"$nin": [5]}}, [1, 3]), ({"a": {"$in": [None, 7]}}, [1, 3]),
        ({"a": {"$not": {"$gt": 5}}}, [1, 2, 4]), ({"a": {"$exists": False}}, [1]), ({"a": "5"}, []), ({"a": {"$gte": "a"}}, []), ({"a": {"$mod": [2, 1]}}, [2, 3, 4]),
        ({"tags": "x"}, [1, 4]), ({"tags": {"$ne": "x"}}, [2, 3]), ({"tags": {"$all": ["x", "y"]}}, [1]), ({"tags": {"$size": 0}}, [2]), ({"tags": None}, [3, 4]),
        ({"tags": ["x", "y"]}, [1]), ({"tags": {"$regex": "^Y", "$options": "i"}}, [1]), ({"tags": {"$nin": ["y"]}}, [2, 3, 4]),
        ({"n.b": {"$gte": 2}}, [2, 4]), ({"n.items.qty": {"$gt": 1}}, [1, 4]), ({"n.items": {"$elemMatch": {"sku": "s", "qty": 1}}}, [4]), ({"n.items.0.sku": "t"}, [4]),
        ({"$or": [{"a": 7}, {"tags": "y"}]}, [1, 3]), ({"$nor": [{"a": 5}, {"a": 7}]}, [1]), ({"missing": None, "a": 7}, [3]), ({"missing": {"$gt": 1}}, []),
        ({"a": {"$type": "int"}}, [2, 3, 4]), ({"$expr": {"$gt": ["$a", 5]}}, [3]), ({"$where": "a > 5"}, [3]), ({}, [1, 2, 3, 4]),
    ],
)
def test_predicates(df, query, ids):
    assert [r["_id"] for r in df.filter(compile_query(df, query)).collect()] == ids


def test_unknown_operators(df):
    for q in ({"a": {"$near": 1}}, {"$maybe": []}):
        with pytest.raises(QueryError):
            compile_query(df, q)


def test_pushdown(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = t.filter(compile_query(t, {"k": {"$gte": 3, "$ne": 5}}))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,3)" in plan and "Not(EqualNullSafe(k,5))" in plan


def agg(df, *stages, **others):
    return [r.asDict(True) for r in Collection.from_df(df).aggregate(list(stages), others).collect()]


def test_groups(spark, df):
    (all_,) = agg(df, {"$group": {"_id": None, "n": {"$sum": 1}, "s": {"$sum": "$a"}, "l": {"$push": "$a"}, "f": {"$first": "$a"}, "e": {"$last": "$_id"}, "u": {"$addToSet": "$a"}, "t": {"$sum": "$tags"}}})
    assert all_ == {"_id": None, "n": 4, "s": 17, "l": [None, 5, 7, 5], "f": None, "e": 4, "u": [None, 5, 7], "t": 0.0}
    assert agg(df.limit(0), {"$group": {"_id": None, "n": {"$sum": 1}}}) == []
    assert agg(df.limit(0), {"$count": "n"}) == []


def test_sort_puts_null_lowest(df):
    assert [r["_id"] for r in agg(df, {"$sort": {"a": 1, "_id": -1}})] == [1, 4, 2, 3]
    assert [r["_id"] for r in agg(df, {"$sort": {"a": -1, "_id": 1}})] == [3, 2, 4, 1]
    found = Collection.from_df(df).find_many(sort=[{"asc": "a"}, {"asc": "_id"}]).rows.collect()
    assert [r["_id"] for r in found] == [2, 4, 3, 1]


def test_unwind(df):
    assert [(r["_id"], r["tags"]) for r in agg(df, {"$unwind": "$tags"})] == [(1, "x"), (1, "y"), (4, "x"), (4, None)]
    kept = agg(df, {"$unwind": {"path": "$tags", "preserveNullAndEmptyArrays": True, "includeArrayIndex": "i"}})
    assert [(r["_id"], r["tags"], r["i"]) for r in kept] == [(1, "x", 0), (1, "y", 1), (2, None, None), (3, None, None), (4, "x", 0), (4, None, 1)]


def test_project_and_paths(df):
    assert agg(df, {"$project": {"n.b": 1, "_id": 0}}, {"$limit": 1}) == [{"n": {"b": 1}}]
    assert set(agg(df, {"$project": {"n.items": 0, "tags": 0}})[0]["n"]) == {"b"}
    assert agg(df, {"$match": {"_id": 4}}, {"$project": {"n": {"items": {"sku": 1}}}}) == [{"_id": 4, "n": {"items": [{"sku": "t"}, {"sku": "s"}]}}]
    assert agg(df, {"$match": {"_id": 1}}, {"$set": {"n.b": {"$add": ["$n.b", 1]}}}, {"$project": {"_id": 0, "x": "$n.b"}}) == [{"x": 2}]


def test_array_projections(df):
    assert agg(df, {"$project": {"tags": {"$slice": 1}}})[0] == {"_id": 1, "tags": ["x"]}
    items = df.select("_id", df["n.items"].alias("items"))
    assert agg(items, {"$project": {"items": {"$elemMatch": {"qty": {"$lt": 5}}}}}, {"$match": {"_id": 4}}) == [{"_id": 4, "items": {"sku": "s", "qty": 1}}]
    assert agg(items, {"$unset": "items.qty"}, {"$limit": 1}) == [{"_id": 1, "items": [{"sku": "s"}]}]
    schema = {"properties": {"items": {"items": {"properties": {"qty": {"maximum": 5}}}}}}
    assert [r["_id"] for r in agg(items, {"$match": {"$jsonSchema": schema}})] == [1, 2, 3]


def test_bucket_raises_outside(df):
    with pytest.raises(Exception, match="outside of all boundaries"):
        agg(df.filter("a is not null"), {"$bucket": {"groupBy": "$a", "boundaries": [0, 6]}})


def test_facet_on_nothing(df):
    assert agg(df.limit(0), {"$facet": {"a": [{"$count": "n"}], "b": [{"$match": {}}]}}) == [{"a": [], "b": []}]


def one(spark, e, ts=datetime.datetime(2024, 12, 31, 23, 59, 58, 123000)):
    row = spark.createDataFrame([(ts, "héllo wörld", [3, 1, 2], 7)], "ts timestamp, s string, xs array<int>, n int")
    return agg(row, {"$project": {"_id": 0, "x": e}})[0]["x"]


@pytest.mark.parametrize(
    ("e", "want"),
    [
        ({"$isoWeek": "$ts"}, 1), ({"$week": "$ts"}, 52), ({"$isoWeekYear": "$ts"}, 2025), ({"$dayOfWeek": "$ts"}, 3), ({"$millisecond": "$ts"}, 123), ({"$dayOfYear": "$ts"}, 366),
        ({"$dateToString": {"date": "$ts", "format": "%Y-%m-%dT%H:%M:%S.%LZ"}}, "2024-12-31T23:59:58.123Z"), ({"$dateDiff": {"startDate": datetime.datetime(2024, 12, 30, 1), "endDate": "$ts", "unit": "day"}}, 1),
        ({"$strLenBytes": "$s"}, 13), ({"$strLenCP": "$s"}, 11), ({"$indexOfCP": ["$s", "o", 5]}, -1), ({"$indexOfBytes": ["$s", "w"]}, 7), ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]),
        ({"$substrCP": ["$s", 1, 3]}, "éll"), ({"$substrBytes": ["$s", 0, 3]}, "hé"), ({"$arrayElemAt": ["$xs", -1]}, 2), ({"$arrayElemAt": ["$xs", 9]}, None), ({"$slice": ["$xs", -2]}, [1, 2]), ({"$slice": ["$xs", -5, 2]}, [3, 1]),
        ({"$range": [5, 3]}, []), ({"$range": [5, 0, -2]}, [5, 3, 1]), ({"$sortArray": {"input": "$xs", "sortBy": -1}}, [3, 2, 1]), ({"$indexOfArray": ["$xs", 2]}, 2), ({"$in": [4, "$xs"]}, False),
        ({"$reduce": {"input": "$xs", "initialValue": 0, "in": {"$add": ["$$value", {"$multiply": ["$$this", "$n"]}]}}}, 42), ({"$map": {"input": "$xs", "as": "a", "in": {"$map": {"input": "$xs", "as": "b", "in": {"$add": ["$$a", "$$b"]}}}}}, [[6, 4, 5], [4, 2, 3], [5, 3, 4]]),
        ({"$filter": {"input": "$xs", "as": "a", "cond": {"$gte": ["$$a", 2]}}}, [3, 2]), ({"$zip": {"inputs": ["$xs", [9]], "useLongestLength": True, "defaults": [0, 0]}}, [[3, 9], [1, 0], [2, 0]]),
        ({"$cmp": [None, "$n"]}, -1), ({"$gt": ["$n", "$s"]}, False), ({"$cond": ["$missing", 1, 2]}, 2), ({"$divide": ["$n", 0]}, None), ({"$mod": [-7, 3]}, -1), ({"$round": [2.5, 0]}, 2.0), ({"$trunc": [-2.7, 0]}, -2.0),
        ({"$mergeObjects": [{"a": 1, "b": 2}, {"b": 3}]}, {"a": 1, "b": 3}), ({"$type": "$xs"}, "array"), ({"$toInt": "2.9"}, None), ({"$toString": "$n"}, "7"), ({"$ifNull": [None, "$n"]}, 7), ({"$literal": "$n"}, "$n"),
        ({"$regexFind": {"input": "$s", "regex": "(w)(ö)"}}, {"match": "wö", "idx": 6, "captures": ["w", "ö"]}), ({"$dateFromParts": {"year": 2024, "month": 13, "day": 1}}, datetime.datetime(2025, 1, 1)), ({"$allElementsTrue": [[1, 0]]}, False),
        ({"$let": {"vars": {"a": 2}, "in": {"$multiply": ["$$a", "$n"]}}}, 14), ({"$switch": {"branches": [{"case": {"$eq": ["$n", 7]}, "then": "seven"}], "default": "?"}}, "seven"), ({"$objectToArray": {"a": 1}}, [{"k": "a", "v": 1}]),
    ],
)
def test_expressions(spark, e, want):
    assert one(spark, e) == want


def test_updates(spark, df):
    def after(q, delta, *cols):
        return [tuple(r) for r in update(df, q, delta).orderBy("_id").select(*cols).collect()]

    assert after({"a": 5}, {"$inc": {"a": 2}, "$set": {"new": "v"}}, "a", "new") == [(None, None), (7, "v"), (7, None), (7, "v")]
    assert after({}, {"$inc": {"a": 1}}, "a") == [(1,), (6,), (8,), (6,)]
    assert after({"_id": {"$lte": 3}}, {"$push": {"tags": "z"}}, "tags") == [(["x", "y", "z"],), (["z"],), (["z"],), (["x", None],)]
    assert after({"_id": 1}, {"$addToSet": {"tags": "x"}}, "tags")[0] == (["x", "y"],)
    assert after({"_id": 1}, {"$pull": {"tags": "x"}}, "tags")[0] == (["y"],)
    assert after({"_id": 1}, {"$pop": {"tags": 1}}, "tags")[0] == (["x"],)
    assert after({"_id": 2}, {"$set": {"n.b": 77}}, "n.b") == [(1,), (77,), (None,), (9,)]
    assert after({"_id": 2}, {"$rename": {"a": "z"}}, "a", "z") == [(None, None), (None, 5), (7, None), (5, None)]
    assert after({"_id": 2}, {"$unset": {"a": ""}}, "a")[1] == (None,)


def test_redact(spark):
    docs = spark.createDataFrame([(1, "open", ("secret", 5)), (2, "secret", ("open", 6))], "_id int, level string, sub struct<level: string, x: int>")
    out = agg(docs, {"$redact": {"$cond": [{"$eq": ["$level", "secret"]}, "$$PRUNE", "$$DESCEND"]}})
    assert out == [{"_id": 1, "level": "open", "sub": None}]


def test_lookup_and_union(spark, df):
    other = spark.createDataFrame([(5, "five"), (5, "fünf")], "k int, w string").coalesce(1)
    out = agg(df, {"$lookup": {"from": "o", "localField": "a", "foreignField": "k", "as": "ws"}}, {"$sort": {"_id": 1}}, o=other)
    assert [[x["w"] for x in r["ws"]] for r in out] == [[], ["five", "fünf"], [], ["five", "fünf"]]
    assert len(agg(df, {"$unionWith": "o"}, o=other)) == 6


def test_streaming_matches_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from docmill.streaming.tail import follow, windowed

    src = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", m) for m in range(20)], "ts timestamp, kind string, v int")
    src.write.parquet(str(tmp_path / "in"))
    out = windowed(follow(spark, str(tmp_path / "in"), src.schema), {"kind": "a"}, time="ts", length="10 minutes", late="0 minutes", by=["kind"], n=F.count("*"))
    q = out.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [5, 5]


def test_writes_below_a_missing_object(spark):
    rows = spark.createDataFrame([(1, None, [(1,), (2,)]), (2, (5,), None)], "_id int, n struct<b: int>, xs array<struct<q: int>>")
    after = lambda q, d: [r.asDict(True) for r in update(rows, q, d).orderBy("_id").collect()]
    assert [r["n"] for r in after({}, {"$set": {"n.b": 7}})] == [{"b": 7}, {"b": 7}]
    assert [r["n"] for r in after({"_id": 2}, {"$set": {"n.b": 7}})] == [None, {"b": 7}]
    assert [r["n"] for r in after({"_id": 1}, {"$set": {"n.c.d": 7}})] == [{"b": None, "c": {"d": 7}}, {"b": 5, "c": {"d": None}}]
    assert [r["xs"] for r in after({}, {"$set": {"xs.q": 9}})] == [[{"q": 9}, {"q": 9}], None]
    assert after({"_id": 1}, {"$set": {"xs.1.q": 5}})[0]["xs"] == [{"q": 1}, {"q": 5}]
    assert [r["n"] for r in sorted(agg(rows, {"$set": {"n.b": "$_id"}}), key=lambda r: r["_id"])] == [{"b": 1}, {"b": 2}]


def test_window_lists_keep_nulls(df):
    w = {"$setWindowFields": {"sortBy": {"_id": 1}, "output": {"l": {"$push": "$a", "window": {"documents": ["unbounded", "current"]}}, "s": {"$addToSet": "$a", "window": {"documents": ["unbounded", "unbounded"]}}}}}
    out = agg(df, w)
    assert [r["l"] for r in out][-1] == [None, 5, 7, 5] and out[0]["s"] == [None, 5, 7]


def test_order_keys_of_strings(df):
    (r,) = agg(df, {"$unwind": "$n.items"}, {"$group": {"_id": None, "t": {"$topN": {"n": 2, "sortBy": {"n.items.sku": -1}, "output": "$n.items.qty"}}, "b": {"$bottom": {"sortBy": {"n.items.sku": -1}, "output": "$_id"}}}})
    assert r["t"] == [8, 2] and r["b"] == 4


def test_lookups(spark, df):
    right = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "k string, v int").coalesce(1)
    out = agg(df, {"$lookup": {"from": "r", "localField": "tags", "foreignField": "k", "as": "found"}}, r=right)
    assert {r["_id"]: sorted(x["v"] for x in r["found"]) for r in out} == {1: [1, 2, 3], 2: [], 3: [], 4: [1, 3]}
    with pytest.raises(QueryError):
        agg(df, {"$lookup": {"from": "r", "let": {"a": "$a"}, "pipeline": [], "as": "x"}}, r=right)
    edges = spark.createDataFrame([(1, [2, 3]), (2, [4]), (3, [1]), (4, None)], "id int, next array<int>").coalesce(1)
    walk = {"from": "e", "startWith": "$_id", "connectFromField": "next", "connectToField": "id", "as": "up", "depthField": "d"}
    got = {r["_id"]: {x["id"]: x["d"] for x in r["up"]} for r in agg(df, {"$graphLookup": walk}, e=edges)}
    assert got == {1: {1: 0, 2: 1, 3: 1, 4: 2}, 2: {2: 0, 4: 1}, 3: {3: 0, 1: 1, 2: 2, 4: 3}, 4: {4: 0}}
    got = {r["_id"]: sorted(x["id"] for x in r["up"]) for r in agg(df, {"$graphLookup": walk | {"maxDepth": 1, "restrictSearchWithMatch": {"id": {"$ne": 2}}}}, e=edges)}
    assert got == {1: [1, 3], 2: [], 3: [1, 3], 4: [4]}


def test_pages_counted_from_the_end(spark):
    c = Collection.from_df(spark.range(10))
    page = lambda **o: [r["id"] for r in c.find_many({}, sort={"asc": "id"}, **o).rows.collect()]
    assert page(offset=-3) == [7, 8, 9] and page(offset=-3, limit=2) == [7, 8] and page(limit=-8) == [0, 1] and page(offset=4, limit=-5) == [4] and page(offset=-20) == list(range(10)) and page(limit=-10) == []


def test_fill_and_averages(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, None), (4, 7.0), (5, None)], "_id int, v double").coalesce(1)
    assert [r["v"] for r in agg(rows, {"$fill": {"sortBy": {"_id": 1}, "output": {"v": {"method": "linear"}}}})] == [1.0, 3.0, 7.0, None]
    (out,) = [r["i"] for r in agg(rows, {"$fill": {"output": {"v": {"value": 0}}}}, {"$setWindowFields": {"sortBy": {"_id": 1}, "output": {"i": {"$integral": {"input": "$v"}, "window": {"documents": ["unbounded", "current"]}}}}}) if r["_id"] == 5]
    assert out == 0.5 + 7.0 + 3.5


def test_ranked_accumulators(spark):
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", None if i % 4 == 0 else (i * 37) % 11) for i in range(200)] + [(200, "nulls", None), (201, "nulls", None)]
    df = spark.createDataFrame(rows, "_id int, g string, v int").coalesce(1)
    by = {"sortBy": {"v": -1}, "output": "$_id"}
    spec = {"f": {"$firstN": {"n": 3, "input": "$v"}}, "l": {"$lastN": {"n": 3, "input": "$v"}}, "lo": {"$minN": {"n": 2, "input": "$v"}}, "hi": {"$maxN": {"n": 2, "input": "$v"}}}
    spec |= {"t": {"$top": by}, "b": {"$bottom": by}, "tn": {"$topN": {"n": 4, **by}}, "bn": {"$bottomN": {"n": 4, **by}}, "k": {"$sum": 1}}
    got = {r["_id"]: r for r in agg(df, {"$group": {"_id": "$g", **spec}})}
    groups = {g: [(i, v) for i, h, v in rows if h == g] for g in {r[1] for r in rows}}
    assert set(got) == set(groups)
    for g, mine in groups.items():
        values, some = [v for _, v in mine], sorted(v for _, v in mine if v is not None)
        ranked = [i for i, v in sorted(mine, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))]
        want = {"f": values[:3], "l": values[-3:], "lo": some[:2], "hi": some[::-1][:2], "t": ranked[0], "b": ranked[-1], "tn": ranked[:4], "bn": ranked[-4:], "k": len(mine)}
        assert {k: got[g][k] for k in want} == want, g
    for name in spec.keys() - {"k"}:
        assert {r["_id"]: r[name] for r in agg(df, {"$group": {"_id": "$g", name: spec[name]}})} == {g: r[name] for g, r in got.items()}
    plan = Collection.from_df(df).aggregate([{"$group": {"_id": "$g", "tn": spec["tn"]}}])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
