from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.operators import documents as docs

ROWS = [(n, f"name{n % 3}", n * 10 if n != 4 else None) for n in range(1, 8)]


@pytest.fixture
def base(spark):
    return spark.createDataFrame(ROWS, "_id long, name string, size long")


def ids(rows):
    return sorted(r._id for r in rows.collect())


def test_find(base):
    assert docs.find(base, limit=0).count() == 7
    page = docs.find(base, F.col("size") > 10, ["name"], [F.desc("_id")], skip=1, limit=2)
    assert page.columns == ["_id", "name"]
    assert [r._id for r in page.collect()] == [6, 5]
    assert docs.find_one(base, F.col("name") == "name0")._id == 3
    assert docs.find_one(base, F.col("name") == "x") is None


def test_pages_cover_everything_once(base):
    seen, cursor = [], None
    for _ in range(10):
        rows = docs.page_after(base, 3, cursor, F.col("_id") != 2).collect()
        seen += [r._id for r in rows]
        if not rows[0].has_more:
            assert rows[0].next_cursor is None
            break
        cursor = rows[0].next_cursor
    assert seen == [1, 3, 4, 5, 6, 7]
    with pytest.raises(ValueError):
        docs.page_after(base, sort="name")


def test_count_and_aggregate(base):
    assert docs.count(base, F.col("size") > 30).first().n == 3
    assert docs.count(base).first().n == 7
    groups = docs.aggregate(base, ["name"], {"n": F.count(F.lit(1))}, F.col("_id") > 1)
    assert {r.name: r.n for r in groups.collect()} == {"name0": 2, "name1": 2, "name2": 2}


def test_insert(base, spark):
    new = spark.createDataFrame([(8, "a", 1), (9, "b", 2)], base.schema)
    assert docs.insert(base, new).count() == 9
    for clash in ([(7, "a", 1)], [(8, "a", 1), (8, "b", 1)]):
        with pytest.raises(docs.DuplicateKeyError):
            docs.insert(base, spark.createDataFrame(clash, base.schema))
    both = docs.colliding_keys(base, spark.createDataFrame([(7, "a", 1), (8, "a", 1), (8, "b", 1)], base.schema))
    assert {(r._id, r.copies, r.stored) for r in both.collect()} == {(7, 1, True), (8, 2, False)}
    with pytest.raises(docs.DuplicateKeyError):
        docs.insert(base, spark.createDataFrame([(20, "name1", 1)], base.schema), ["name"])


def test_updates(base, spark):
    change = {"size": F.col("size") + 1, "seen": F.lit(True)}
    many = docs.update_many(base, F.col("size") >= 50, change)
    assert {r._id: (r.size, r.seen) for r in many.where("seen").collect()} == {
        5: (51, True),
        6: (61, True),
        7: (71, True),
    }
    counts = docs.update_counts(base, F.col("_id") <= 2, {"name": F.lit("name1")}).first()
    assert tuple(counts) == (2, 1)
    one = docs.update_one(base, F.col("size") >= 50, {"name": F.lit("x")})
    assert ids(one.where("name = 'x'")) == [5]
    extra = spark.createDataFrame([(99, "new", 0)], base.schema)
    assert docs.update_one(base, F.col("size") > 50, {"name": F.lit("x")}, extra).count() == 7
    added = docs.update_one(base, F.col("size") > 5000, {"name": F.lit("x")}, extra)
    assert added.count() == 8 and added.where("name = 'x'").isEmpty()


def test_replace(base, spark):
    new = spark.createDataFrame([(1, None, None), (50, "n", 5)], base.schema)
    assert ids(docs.replace(base, new)) == [1, 2, 3, 4, 5, 6, 7]
    merged = docs.replace(base, new, upsert=True)
    assert ids(merged) == [1, 2, 3, 4, 5, 6, 7, 50]
    assert merged.where("_id = 1").first().name is None


def test_delete(base):
    assert ids(docs.delete_many(base, F.col("size") > 30)) == [1, 2, 3, 4]
    assert ids(docs.delete_one(base, F.col("size") > 30)) == [1, 2, 3, 4, 6, 7]
    assert docs.delete_one(base, F.col("size") > 3000).count() == 7
