"""Two writers of one catalog, and what rests on snapshots: the query cache, checks and inserts of DataFrames."""

import json
import time

import pytest
from pyspark.sql import functions as F

from keyloom.errors import DuplicateError, IntegrityError
from keyloom.operators import Relation
from keyloom.sources.catalog import Catalog
from keyloom.sources.sql import QueryCache
from keyloom.sources.tables import FreeTable, Manual, Schema
from keyloom.streaming import Computed


@pytest.fixture
def writers(spark, tmp_path):
    """The same table, a child and a catalog each, of two writers who have both seen the first rows only."""
    first = Catalog(spark, str(tmp_path / "shared"))
    schema = Schema(first, "lab")

    class Item(Manual):
        definition = """
        item : int32
        ---
        value = null : float64
        """

    class Child(Manual):
        definition = """
        -> Item
        """

    schema(Item)
    schema(Child, context={"Item": Item})
    Item().insert([(1, 1.0), (2, 2.0)])
    second = Catalog(spark, str(tmp_path / "shared"))
    return FreeTable(first, "lab.item"), FreeTable(second, "lab.item"), FreeTable(second, "lab.child")


def items(table):
    table.catalog.refresh()
    return sorted((r["item"], r["value"]) for r in table.to_dicts())


def test_no_writer_loses_rows_or_repeats_keys(writers):
    a, b, _ = writers
    a.insert([(3, 3.0)])
    with pytest.raises(DuplicateError):
        b.insert([(3, 9.0)])
    a.insert([(4, 4.0)])
    b.insert([(2, 20.0)], replace=True)
    a.insert([(5, 5.0)])
    b.update1({"item": 1, "value": 10.0})
    a.insert([(6, 6.0)])
    (b & {"item": 4}).delete_quick()
    a.insert([(7, 7.0)])
    (b & {"item": 5}).delete()
    a.insert([(8, 8.0)])
    b.insert([(8, 0.0), (9, 9.0)], skip_duplicates=True)
    assert items(a) == items(b) == [(1, 10.0), (2, 20.0), (3, 3.0), (6, 6.0), (7, 7.0), (8, 8.0), (9, 9.0)]
    b.alter("item : int32\n---\nvalue = null : float64\nnote = 'x' : varchar(3)")
    a.insert([(10, 10.0, "y")])
    a.catalog.refresh()
    assert len(a) == 8 and {r["note"] for r in a.to_dicts()} == {"x", "y"}


def test_a_change_is_tried_again_when_another_was_faster(writers, monkeypatch):
    a, b, _ = writers
    write, done = Catalog.stage, []

    def slow(self, table, df):
        place = write(self, table, df)
        if self is b.catalog and not done:  # the other commits between this one's read and its commit
            done.append(1)
            a.insert([(3, 3.0)])
        return place

    monkeypatch.setattr(Catalog, "stage", slow)
    b.insert([(4, 4.0)])
    done.clear()
    with pytest.raises(DuplicateError):  # checked again, on what the other has committed
        monkeypatch.setattr(Catalog, "stage", lambda self, table, df: (write(self, table, df), done or (done.append(1), a.insert([(5, 5.0)])))[0] if self is b.catalog else write(self, table, df))
        b.insert([(5, 0.0)])
    assert items(a) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0), (5, 5.0)]


def test_delete_quick_leaves_no_orphans(writers):
    a, b, child = writers
    child.insert([(1,)])
    a.catalog.refresh()
    with pytest.raises(IntegrityError):
        (a & {"item": 1}).delete_quick()
    assert (a & {"item": 2}).delete_quick() == 1 and (a & {"item": 1}).delete() == 1 and len(a) == 0


def test_the_cache_tells_queries_apart(spark, catalog, tmp_path):
    df = spark.createDataFrame([(k, f"Brand#{10 + k % 3}", k * 1.5) for k in range(200)], "k long, brand string, v double")
    df.write.parquet(str(tmp_path / "a"))
    df.filter("k > 150").write.parquet(str(tmp_path / "b"))
    a, b = (Relation.of(spark.read.parquet(str(tmp_path / n)), ["k"]) for n in "ab")
    cache = QueryCache(catalog)
    for some in (a & "brand = 'Brand#11'", a & "brand = 'Brand#12'", a & "k < 9", a & [{"k": k} for k in range(100, 160)], a & [{"k": k} for k in range(60)], a - b.proj(), b - a.proj(), a.proj(x="v + 1"), a.proj(x="v + 2")):
        for _ in range(2):
            assert sorted(map(str, cache.get(some).df.collect())) == sorted(map(str, some.df.collect()))
    assert cache.key(a & "k < 9") == cache.key(a & "k < 9") is not None and cache.key(a & [{"k": k} for k in range(60)]) is None and cache.key(a.proj(x="rand()")) is None


def test_a_frame_is_stored_as_rows_are(spark, catalog):
    schema = Schema(catalog, "lab")

    @schema
    class Reading(Manual):
        definition = """
        reading : int64 auto_increment
        ---
        value = null : float64
        name = null : uuid
        more = null : json
        """

    name = "0e6d3a52-9c5f-4c0b-8a3e-6a1d2f3b4c5d"
    Reading().insert([{"value": float("nan"), "name": name}])
    Reading().insert(spark.createDataFrame([(float("nan"), name.upper(), '{"a": 1}'), (0.5, None, None)], "value double, name string, more string"))
    rows = Reading().to_dicts()
    assert len({r["reading"] for r in rows}) == 3 and [r["value"] for r in rows if r["name"]] == [None, None] and {r["name"] for r in rows} == {name, None}
    for bad in ("name", "more"):
        with pytest.raises(IntegrityError):
            Reading().insert(spark.createDataFrame([("no such {",)], f"{bad} string"))
    assert len(Reading()) == 3


def test_a_source_that_changes_is_checked_as_written(spark, catalog):
    schema = Schema(catalog, "lab")

    @schema
    class Item(Manual):
        definition = """
        item : int32
        """

    for _ in range(3):  # each evaluation would give other rows; what is checked is what is stored
        try:
            Item().insert(spark.range(40).select(F.floor(F.rand() * 400).cast("int").alias("item")))
        except DuplicateError:
            pass
    keys = [r["item"] for r in Item().to_dicts()]
    assert len(keys) == len(set(keys))


def test_len_counts_entities(table, spark):
    items = Relation.of(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string"), ["k"])
    assert len(items) == 2 and len(items & "k = 1") == 1 and len(table("region")) == 5


def test_a_dead_owner_blocks_no_job(spark, catalog):
    schema = Schema(catalog, "lab")

    @schema
    class Source(Manual):
        definition = """
        item : int32
        """

    @schema
    class Result(Computed):
        definition = """
        -> Source
        ---
        twice : int32
        """

        def make(self, key):
            self.insert1({**key, "twice": 2 * key["item"]})

    Source().insert([(1,), (2,)])
    jobs = Result().jobs
    jobs.refresh()
    name = jobs._name({"item": 1})
    claim = f"{jobs.folder}/{name}.claim"
    assert catalog.store.publish(claim, json.dumps({"time": time.time()}).encode()) and not jobs.reserve({"item": 1})
    catalog.store.write(claim, json.dumps({"time": time.time() - 3600}).encode())
    assert jobs.reserve({"item": 1}) and not jobs.reserve({"item": 1})
