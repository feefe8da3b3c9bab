import pytest

from keyloom.errors import KeyloomError
from keyloom.sources import sql
from keyloom.sources.copying import backup, compare_frames, compare_tables, copy_table, restore
from keyloom.sources.tables import Manual, Schema


@pytest.fixture
def two(catalog):
    schema = Schema(catalog, "cp")

    def make(name):
        return schema(type(name, (Manual,), {"definition": "k : int32\n---\nx = null : float64\ns = null : varchar(9)"}))

    a, b = make("Left"), make("Right")
    a().insert([(1, 1.0, "a"), (2, 2.0, None), (3, None, "c")])
    return a, b


def test_copy_and_compare(catalog, two, tmp_path):
    a, b = two
    assert copy_table(catalog, "cp.left", "cp.right") == 3 and copy_table(catalog, "cp.left", "cp.right") == 0
    assert compare_tables(catalog, "cp.left", "cp.right")
    b().update1({"k": 1, "x": 1.0 + 1e-12})
    assert compare_tables(catalog, "cp.left", "cp.right")
    b().update1({"k": 3, "x": 0.0})
    b().update1({"k": 2, "s": "z"})
    b().insert1((4, 0.0, "n"))
    (a & "k=1").delete()
    found = compare_tables(catalog, "cp.left", "cp.right")
    assert not found and (found.only_left, found.only_right, found.changed) == (0, 2, {"x": 1, "s": 1})
    assert backup(catalog, "cp", str(tmp_path / "bk")) == ["cp.left", "cp.right"]
    b().delete_quick()
    restore(catalog, "cp", str(tmp_path / "bk"))
    assert len(b()) == 4
    assert compare_frames(a.df, a.df, ["k"])


def test_sql(catalog, two):
    assert sql.query(catalog, "select count(*) from cp.left where s <> 'cp.left {x}' or s is null") == [(3,)]
    assert sql.query(catalog, "select k from `cp.left` where k > :low order by k", {"low": 1}, as_dict=True) == [{"k": 2}, {"k": 3}]
    with pytest.raises(KeyloomError):
        sql.query(catalog, "drop table cp.left")


def test_cache(catalog, two):
    a, _ = two
    cache = sql.QueryCache(catalog)
    r = (a & "k > 1").as_relation()
    assert len(cache.get(r)) == 2 and cache.key(r) == cache.key((a & "k > 1").as_relation()) != cache.key((a & "k > 2").as_relation())
    a().insert1((9, None, None))
    assert len(cache.get((a & "k > 1").as_relation())) == 3
    cache.clear()
    assert not catalog.store.exists("cache")
