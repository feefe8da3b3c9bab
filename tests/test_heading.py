import pytest
from pyspark.sql.types import IntegerType

from keyloom.errors import KeyloomError
from keyloom.plans.heading import Attribute, Heading


def heading(key, secondary=()):
    return Heading([*(Attribute(n, IntegerType(), in_key=True) for n in key), *(Attribute(n, IntegerType()) for n in secondary)])


@pytest.mark.parametrize(
    "a, b, expected",
    [
        ((["x", "y"], ["z"]), (["x"],), True),
        ((["x"], ["y"]), (["y"],), True),
        ((["x", "y"],), (["x", "z"],), False),
        ((["x"],), ([],), True),
    ],
)
def test_determines(a, b, expected):
    assert heading(*a).determines(heading(*b)) is expected


def test_join_keys_and_order():
    session, trial = heading(["s"], ["day"]), heading(["s", "t"], ["kind"])
    assert trial.join(session).primary_key == ["s", "t"] and trial.join(session).names == ["s", "t", "kind", "day"]
    assert session.join(trial).primary_key == ["s", "t"] and session.join(trial).names == ["s", "t", "kind", "day"]
    a, b = heading(["x", "y"], ["u"]), heading(["y", "z"], ["v"])
    assert a.join(b).primary_key == ["x", "y", "z"] and a.join(b).names == ["x", "y", "z", "u", "v"]
    both, other = heading(["x"], ["y"]), heading(["y"], ["x"])
    assert both.join(other).primary_key == ["x"]
    assert heading(["x"], ["k"]).join(heading(["y"]), keep_both=True).primary_key == ["x", "y"]


def test_hidden_attributes_are_left_out():
    h = Heading([Attribute("a", IntegerType(), in_key=True), Attribute("_b", IntegerType())])
    assert h.names == ["a"] and len(h.every) == 2


def test_unknown_key(spark):
    with pytest.raises(KeyloomError):
        Heading.of(spark.range(1).schema, ["nope"])
