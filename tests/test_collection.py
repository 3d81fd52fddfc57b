"""The public API: golden cases of find, update and aggregate, and the store."""

import threading

import pytest

from docmill import Collection, Database, DestroyedError, QueryError

AB = [{"id": 1, "value": "A"}, {"id": 2, "value": "B"}, {"id": 3, "value": "A"}]
ABC = [{"id": 1, "value": "A"}, {"id": 2, "value": "B"}, {"id": 3, "value": "C"}]
COLORS = [{"color": c, "value": c[0]} for c in ("red", "green", "blue", "cyan", "magenta", "yellow", "black")]


@pytest.fixture(params=["fs", "inmemory"])
def db(spark, tmp_path, request):
    return Database(spark, str(tmp_path), request.param)


def filled(db, rows, name="c", **kw):
    c = db.init_collection(name, **kw)
    c.insert_many(rows)
    return c


def pairs(df):
    return [(r["id"], r["value"]) for r in df.collect()]


@pytest.mark.parametrize(
    ("rows", "query", "options", "total", "want"),
    [
        (AB, {"value": "A"}, {"limit": 1, "offset": 1, "sort": [{"asc": "id"}]}, 2, [(3, "A")]),
        ([ABC[2], *ABC[:2]], {}, {"sort": [{"asc": "value"}]}, 3, [(1, "A"), (2, "B"), (3, "C")]),
        (ABC, {}, {"offset": 1}, 3, [(2, "B"), (3, "C")]),
        (ABC, {}, {"limit": 2}, 3, [(1, "A"), (2, "B")]),
        (AB, {"value": "A"}, {"limit": 5, "sort": [{"asc": "id"}]}, 2, [(1, "A"), (3, "A")]),
        (ABC, {}, {"limit": 0, "offset": 0}, 3, [(1, "A"), (2, "B"), (3, "C")]),
        (ABC, {}, {"offset": -1}, 3, [(3, "C")]),
        (ABC, {}, {"limit": -1}, 3, [(1, "A"), (2, "B")]),
        (ABC, {}, {"sort": {"desc": lambda f: f("id")}, "limit": 1}, 3, [(3, "C")]),
    ],
)
def test_find(db, rows, query, options, total, want):
    found = filled(db, rows).find_many(query, **options)
    assert (found.total_count, found.count, pairs(found.rows)) == (total, len(want), want)


def test_find_without_arguments_on_nothing(db):
    found = db.init_collection("empty").find_many()
    assert (found.total_count, found.count, found.rows.collect()) == (0, 0, [])


def test_update_keeps_order(db):
    c = filled(db, AB)
    c.update_many({"value": "A"}, {"$set": {"value": "Updated"}})
    assert pairs(c.find_many().rows) == [(1, "Updated"), (2, "B"), (3, "Updated")]
    c.update_many({"id": 99}, {"$set": {"value": "R"}})
    assert pairs(c.find_many().rows)[0] == (1, "Updated")
    with pytest.raises(QueryError):
        c.update_many({}, {"value": "no operator"})


def test_aggregate_keeps_stored_order(db):
    out = filled(db, COLORS).aggregate([{"$match": {"color": {"$in": ["blue", "green", "cyan"]}}}])
    assert [r["color"] for r in out.collect()] == ["green", "blue", "cyan"]
    assert filled(db, COLORS, "d").aggregate([]).count() == 7


def test_demo_with_mixed_ids(db):
    c = db.init_collection("demo", columns=[{"title": "date", "type": "date"}])
    c.insert_one({"_id": "test", "name": "t"})
    c.insert_many([{"_id": i, "name": f"n{i}", "date": "2024-01-01T00:00:00Z"} for i in range(200)])
    found = c.find_many({"_id": {"$gte": 100}}, sort=[{"desc": "_id"}], offset=10, limit=20)
    assert (found.total_count, found.count) == (100, 20)
    assert [r["name"] for r in found.rows.collect()] == [f"n{i}" for i in range(189, 169, -1)]
    assert c.find_many({"_id": 3}).count == 1
    c.update_many({"_id": 3}, {"$set": {"note": "seen"}})
    assert [r["name"] for r in c.find_many({"_id": {"$in": [3, 2]}}).rows.collect()] == ["n2", "n3"]
    (row,) = c.aggregate([{"$match": {"_id": 3}}]).collect()
    assert row["note"] == "seen"
    assert c.find_many({"note": {"$exists": True}}).count == 1
    assert c.find_many({"_id": "test", "date": None}).count == 1


def test_reopen_and_destroy(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    filled(db, ABC)
    again = db.init_collection("c")
    assert pairs(again.find_many().rows) == [(1, "A"), (2, "B"), (3, "C")]
    again.destroy()
    for call in (again.find_many, lambda: again.insert_one({"a": 1}), lambda: again.update_many({}, {"$set": {"a": 1}}), lambda: again.aggregate([])):
        with pytest.raises(DestroyedError):
            call()
    assert db.init_collection("c").find_many().count == 0


def test_unknown_adapter(spark):
    with pytest.raises(ValueError, match="Unknown adapter type: x"):
        Database(spark, None, "x")


def test_concurrent_inserts_lose_nothing(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    handles = [db.init_collection("c") for _ in range(4)]
    threads = [threading.Thread(target=h.insert_many, args=([{"n": i}],)) for i, h in enumerate(handles)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["n"] for r in db.init_collection("c").find_many().rows.collect()) == [0, 1, 2, 3]


def test_from_df(spark):
    assert Collection.from_df(spark.range(5)).find_many({"id": {"$lt": 2}}).count == 2


def test_many_small_inserts_are_compacted(spark, tmp_path, monkeypatch):
    from docmill.sources.store import ParquetStore

    monkeypatch.setattr(ParquetStore, "MOST", 3)
    c = Database(spark, f"file://{tmp_path}").init_collection("c")
    for i in range(9):
        c.insert_one({"_id": i} | ({"x": i} if i % 2 else {}))
    assert len(c._store.manifest()["segments"]) <= 3
    assert [r["_id"] for r in c.aggregate([]).collect()] == list(range(9))
    assert c.find_many({"x": {"$gte": 5}}).count == 2
