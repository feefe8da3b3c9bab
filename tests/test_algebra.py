import datetime
import uuid

import numpy as np
import pandas as pd
import pytest

from keyloom.errors import KeyloomError, LineageError, UnknownAttributeError
from keyloom.operators import AndList, Not, Relation, Top, U


def rel(spark, rows, schema, key, origin=None, **lineage):
    return Relation.of(spark.createDataFrame(rows, schema), key, origin, lineage)


@pytest.fixture
def a(spark):
    return rel(spark, [(i, int(i % 4 > i % 3)) for i in range(10)], "id_a int, cond int", ["id_a"], "s.a")


@pytest.fixture
def long(spark):
    return rel(spark, [(i, int(i % 3 >= i % 5)) for i in range(30)], "id_l int, cond_in_l int", ["id_l"], "s.l")


def test_restriction_truth_table(a):
    assert len(a & "cond=1") == 4 and len(a - "cond=1") == 6
    assert len(a & {}) == 10 and len(a - {}) == 0
    assert len(a & []) == 0 and len(a - []) == 10 and len(a & [[]]) == 0
    assert len(a & AndList()) == 10 and len(a & True) == 10 and len(a & False) == 0
    assert len(a & {"typo": 1}) == 10 and len(a - {"typo": 1}) == 0
    assert len(a & [{"id_a": 3}, {"id_a": 6}, "id_a=9"]) == 3
    assert len(a & AndList(["id_a>2", "id_a<5"])) == 2 and len(a & ("id_a=1", "id_a=2")) == 2
    assert len(a & Not(Not("id_a=1"))) == 1
    assert len(a & ["id_a=1", AndList(["id_a>7", Not("id_a=9")])]) == 2
    assert len(a & np.array([(3,)], dtype=[("id_a", "i4")])[0]) == 1
    assert len(a & pd.DataFrame({"id_a": [1, 2, 77]})) == 2
    assert {"id_a": 3} in a and {"id_a": 30} not in a
    with pytest.raises(KeyloomError):
        a & None
    with pytest.raises(KeyloomError):
        a & [Top(1)]
    with pytest.raises(UnknownAttributeError):
        a & "nope=1"


def test_restriction_by_relations(spark, a):
    b = rel(spark, [(1, 1), (1, 2), (3, 1), (77, 1)], "id_a int, id_b int", ["id_a", "id_b"], None, id_a="s.a.id_a", id_b="s.b.id_b")
    assert {r["id_a"] for r in a & b} == {1, 3} and len(a - b) == 8
    assert len(a & b) + len(a - b) == len(a)
    assert {r["id_a"] for r in a & [b, "id_a=9"]} == {1, 3, 9}
    assert len(a & U("id_a")) == 10
    lone = rel(spark, [(1,)], "k int", ["k"], "s.k")
    assert len(a & lone) == 10 and len(a - lone) == 0 and len(a & (lone & "k=2")) == 0 and len(a - (lone & "k=2")) == 10
    many = [{"id_a": i} for i in range(3, 200)]
    assert len(a & many) == 7 and len(a - many) == 3
    assert "LeftSemi" in (a & many).df._jdf.queryExecution().toString()


def test_not_in_with_nulls(spark):
    left = rel(spark, [(1, 1, 1), (2, 1, 2), (3, 2, None), (4, 3, 3)], "k int, a int, b int", ["k"])
    right = rel(spark, [(1, 1, 1), (2, 3, None)], "j int, a int, b int", ["j"])
    assert sorted(r["k"] for r in left - right.proj("a", "b")) == [2, 3]
    one = rel(spark, [(1, 1), (2, None)], "j int, b int", ["j"])
    assert len(left - one) == 0 and sorted(r["k"] for r in left - (one & "b is not null")) == [2, 4]
    assert len(left - (one & "j>5")) == 4


def test_projection(a):
    assert a.proj().heading.names == ["id_a"] and a.proj("cond").heading.names == ["id_a", "cond"]
    assert a.proj(...).heading.names == ["id_a", "cond"] and a.proj(..., "-cond").heading.names == ["id_a"]
    r = a.proj(new="id_a", twice="2*cond", same="(cond)")
    assert r.primary_key == ["new"] and r.heading.names == ["new", "same", "twice"] or r.heading.names == ["new", "twice", "same"]
    assert r.heading["new"].lineage == "s.a.id_a" and r.heading["twice"].lineage is None
    assert a.proj(copy="(id_a)").primary_key == ["id_a", "copy"]
    assert a.proj(three="3", nothing="NULL").fetch("three")[0] == 3
    for bad in (lambda: a.proj("nope"), lambda: a.proj("-id_a"), lambda: a.proj(x="typo"), lambda: a.proj("cond", cond="id_a"), lambda: a.proj("cond", x="cond")):
        with pytest.raises(KeyloomError):
            bad()


def test_joins(spark, a, long):
    assert len(a * long) == 300 and (a * long).primary_key == ["id_a", "id_l"]
    pairs = a * a.proj(other="id_a", other_cond="cond") & "id_a < other"
    assert len(pairs) == 45
    b = rel(spark, [(i, i % 5) for i in range(20)], "id_b int, id_a int", ["id_b"], "s.b", id_a="s.a.id_a")
    assert (b * a).primary_key == ["id_b"] and len(b * a) == 20
    c = rel(spark, [(i, i + 3) for i in range(5)], "id_c int, id_a int", ["id_c"], "s.c", id_a="s.a.id_a")
    e = c.extend(a & "id_a<6")
    assert len(e) == 5 and sum(r["cond"] is None for r in e) == 2
    with pytest.raises(KeyloomError):
        a.extend(b)
    with pytest.raises(KeyloomError):
        a * U("id_a")
    assert len(a.join(b, left=True, allow_nullable_pk=True)) == 25


def test_lineage(spark, a):
    other = rel(spark, [(1,)], "id_a int", ["id_a"], "t.x")
    with pytest.raises(LineageError):
        a * other
    with pytest.raises(LineageError):
        a & other
    assert len(a.join(other, semantic_check=False)) == 1 and len(a.restrict(other, semantic_check=False)) == 1
    assert len(a * other.proj(id_x="id_a")) == 10
    plain = rel(spark, [(1,)], "id_a int", ["id_a"])
    assert len(a * plain) == 1


def test_aggregation(spark, a):
    b = rel(spark, [(1, 1, 2.0), (1, 2, None), (3, 1, 5.0)], "id_a int, id_b int, v double", ["id_a", "id_b"], None, id_a="s.a.id_a", id_b="s.b.id_b")
    q = a.aggr(b, n="count(id_b)", top="max(v)")
    assert len(q) == 10 and sum(r["n"] for r in q) == 3 and len(q & "n>0") == 2
    assert len(a.aggr(b, n="count(*)", exclude_nonmatching=True)) == 2
    assert len(a.aggr(b & "v>4", n="count(id_b)")) == 10  # the group's restriction doesn't drop entities
    assert a.aggr(b, ..., n="count(id_b)").heading.names == ["id_a", "cond", "n"]
    assert U("cond").aggr(q * a, total="sum(n)").to_dicts(order_by="cond")[0]["cond"] == 0
    assert U().aggr(a, n="count(*)").fetch1("n") == 10 and len(U().aggr(a, n="count(*)") & "n>10") == 0
    assert a.aggr(b.proj(w="v*2"), m="max(w)").to_dicts(order_by="id_a")[3]["m"] == 10
    assert U("g").aggr(a.proj(g="cond+1", x="id_a*2"), m="max(x)").to_dicts(order_by="g")[1]["m"] == 18
    with pytest.raises(KeyloomError):
        b.aggr(a, n="count(*)")
    with pytest.raises(KeyloomError):
        U("zz").aggr(a, n="count(*)")
    assert U("cond").aggr(a, names="group_concat(id_a order by id_a separator '-')").to_dicts(order_by="cond")[1]["names"] == "3-6-7-9"
    assert U().aggr(a, n="sum(cond = 1)").fetch1("n") == 4


def test_union(spark):
    ij = rel(spark, [(i, j) for i in range(3) for j in range(3)], "i int, j int", ["i", "j"])
    ji = rel(spark, [(i, j) for i in range(1, 4) for j in range(2, 5)], "i int, j int", ["j", "i"])
    assert len(ij + ji) == 16 and len(ij & ji) == 2 and len(ij - ji) == 7
    x = rel(spark, [(1, "a"), (2, "b")], "k int, x string", ["k"])
    y = rel(spark, [(2, "c"), (3, "d")], "k int, y string", ["k"])
    assert sorted((r["k"], r["x"], r["y"]) for r in x + y) == [(1, "a", None), (2, "b", "c"), (3, None, "d")]
    with pytest.raises(KeyloomError):
        x + x
    with pytest.raises(KeyloomError):
        x + ij
    assert len(x & (x.proj() + y.proj())) == 2
    assert len(x * (ij + ji)) == 32


def test_top(long):
    assert [r["id_l"] for r in long & Top(5, "id_l desc", 4) & "cond_in_l=1"] == [25]
    assert [r["id_l"] for r in (long & "cond_in_l=1" & Top(5, "id_l desc", 4)).to_dicts()] == [16, 15, 11, 10, 5]
    merged = long & Top(10, "id_l desc", offset=2) & Top(3, None, offset=3)
    assert [r["id_l"] for r in merged.to_dicts()] == [24, 23, 22]
    assert len(long & Top(10) & Top(10, None, 5)) == 10 and len(long & Top(None, offset=25)) == 5
    assert [r["id_l"] for r in (long & Top(3, "KEY DESC")).to_dicts()] == [29, 28, 27]
    assert len((long & Top(2)) * long.proj(o="id_l", p="cond_in_l")) == 60
    assert "TakeOrderedAndProject" in (long & Top(5, "id_l desc")).df._jdf.queryExecution().toString()
    for bad in (lambda: Top("x"), lambda: Top(1, 2), lambda: Top(1, offset="x")):
        with pytest.raises(TypeError):
            bad()


def test_universal_set(spark):
    s = rel(spark, [(1, 1, 2), (2, 1, 2), (3, 3, 2)], "id int, contrast int, brightness int", ["id"])
    assert len(U("contrast", "brightness") & s) == 2 and (U("contrast") & s).primary_key == ["contrast"]
    assert len(U() & s) == 1 and len(U() & (s & "id>9")) == 0
    for bad in (lambda: U("a") - s, lambda: U("a") * s):
        with pytest.raises(KeyloomError):
            bad()


def test_fetching(spark, a):
    assert a.fetch1 and (a & "id_a=3").fetch1() == {"id_a": 3, "cond": 1} and (a & "id_a=3").fetch1("cond", "KEY") == (1, {"id_a": 3})
    with pytest.raises(KeyloomError):
        a.fetch1()
    assert [r["id_a"] for r in a.head(2)] == [0, 1] and [r["id_a"] for r in a.tail(2)] == [8, 9]
    assert a.to_pandas().index.name == "id_a" and a.to_arrow().num_rows == 10
    ids, conds = a.to_arrays("id_a", "cond", order_by="KEY")
    assert ids.tolist() == list(range(10)) and conds.sum() == 4
    assert a.to_arrays(order_by="id_a desc", limit=1)["id_a"].tolist() == [9]
    keys, c = a.to_arrays("cond", include_key=True)
    assert len(keys) == 10 and len(a.keys(limit=3)) == 3
    assert len(list(a)) == 10 and len(list(a.cursor())) == 10 and a.fetch("KEY", as_dict=True, order_by="KEY")[1] == {"id_a": 1}
    assert "..." in a.preview(2) and "<table>" in a._repr_html_()
    assert bool(a) and not bool(a & "id_a>99")
    nulls = rel(spark, [(None, 1), (None, 2), (1, 3)], "k int, v int", ["k"])
    assert len(Relation(nulls.df, nulls.heading, unique=False)) == 2
    with pytest.raises(KeyloomError):
        nulls.assert_unique_key()


def test_values(spark):
    u = uuid.uuid4()
    r = rel(spark, [(1, str(u), datetime.date(2020, 1, 2), "it's 100%", None)], "k int, u string, d date, s string, x double", ["k"])
    assert len(r & {"u": u}) == 1 and len(r & {"d": datetime.date(2020, 1, 2)}) == 1 and len(r & {"d": "2020-01-02"}) == 1
    assert len(r & {"s": "it's 100%"}) == 1 and len(r & {"x": None}) == 1 and len(r & 's like "%%100%%"') == 1
    assert len(r & "d > curdate() - interval 100 year") == 1


def test_json(spark):
    rows = [("e", '{"name": "Rever", "len": 20.5, "ok": true, "tire": [32, 31], "h": null}'), ("b", '{"name": "Chaching", "len": 100, "ok": false, "tire": [34, 30]}'), ("m", None)]
    t = rel(spark, rows, "name string, car string", ["name"])
    assert len(t & {"car.name": "Chaching"}) == 1 and len(t & {"car.len": "100"}) == 1 and len(t & {"car.len:float": 20.5}) == 1
    assert len(t & {"car.ok:unsigned": True}) == 1 and len(t & {"car.h": None}) == 3 and len(t & {"car.tire": [32, 31]}) == 1
    assert len(t & {"car.tire[0]:int": 34}) == 1
    p = t.proj(w="car.len:float", first="car.tire[0]", n="json_value(car, '$.name')", o="car->>'$.ok'").to_dicts(order_by="name")
    assert [x["w"] for x in p] == [100, 20.5, None] and p[0]["first"] == "34" and p[1]["n"] == "Rever" and p[0]["o"] == "false"
