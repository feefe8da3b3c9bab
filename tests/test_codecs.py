import datetime
import decimal
import uuid

import numpy as np
import pytest

from keyloom.errors import IntegrityError, KeyloomError, MissingError
from keyloom.sources import codecs
from keyloom.sources.gc import collect, scan
from keyloom.sources.store import Store
from keyloom.sources.tables import Manual, Schema


def same(a, b):
    if isinstance(a, np.ndarray):
        return isinstance(b, np.ndarray) and a.dtype == b.dtype and a.shape == b.shape and all(same(x, y) for x, y in zip(a.ravel().tolist(), b.ravel().tolist(), strict=True))
    if isinstance(a, (list, tuple)):
        return type(a) is type(b) and len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


@pytest.mark.parametrize(
    "value",
    [
        None, True, 3, -(1 << 80), 2.5, 1 + 2j, "é\ud800", b"\0x", [1, (2, "x"), {"a": None}], {1, 2}, decimal.Decimal("1.20"), uuid.UUID(int=5),
        datetime.datetime(2020, 1, 2, 3, 4, 5, 6), datetime.date(2020, 1, 2), datetime.time(3, 4), datetime.timedelta(days=-1, seconds=3),
        np.arange(6).reshape(2, 3), np.float32(2.5), np.array([], dtype="i2"), np.array(["a", None, [1]], dtype=object), np.array([(1, 2.5)], dtype=[("a", "i4"), ("b", "f8")]),
        np.array(["2020-01-01"], dtype="datetime64[D]"), "x" * 5000,
    ],
)
def test_blob_round_trip(value):
    blob = codecs.codec("blob")
    assert same(value, blob.decode(blob.encode(value)))


def test_blob_refuses():
    with pytest.raises(KeyloomError):
        codecs.pack(object())


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "objects"))
    codecs.add_store("default", s)
    codecs.add_store("main", s)
    return s


def test_columns(catalog, store, tmp_path):
    class Graph(codecs.Codec):
        name = "graph_of_test"

        def storage(self, in_store):
            return "<blob>"

        def encode(self, value, store=None, key=None):
            return sorted(value)

        def decode(self, stored, key=None):
            return set(map(tuple, stored))

    schema = Schema(catalog, "c")

    @schema
    class Thing(Manual):
        definition = """
        k : int32
        ---
        a = null : <blob>
        b = null : <blob@main>
        g = null : <graph_of_test>
        n = null : <npy@>
        f = null : <attach>
        o = null : <object@main>
        p = null : <filepath@>
        """

    (tmp_path / "x.txt").write_text("hello")
    store.write("given/y.bin", b"123")
    codecs.AttachCodec.folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    Thing().insert1({"k": 1, "a": {"x": [1, 2]}, "b": np.arange(5), "g": {(1, 2), (0, 1)}, "n": np.eye(3), "f": str(tmp_path / "x.txt"), "o": b"obj", "p": "given/y.bin"})
    row = Thing().fetch1()
    assert row["a"] == {"x": [1, 2]} and row["b"].tolist() == [0, 1, 2, 3, 4] and row["g"] == {(1, 2), (0, 1)}
    assert row["n"].shape == (3, 3) and np.asarray(row["n"]).trace() == 3 and row["o"].read() == b"obj" and row["p"].size == 3
    assert open(row["f"]).read() == "hello"
    Thing().insert1({"k": 2, "b": np.arange(5)})
    hashed = [n for n in store.files("_hash")]
    assert len(hashed) == 1  # stored once
    assert len(Thing.to_dicts()) == 2 and Thing.to_arrays("b", order_by="k")[1].tolist() == [0, 1, 2, 3, 4]
    assert "=BLOB=" in Thing.preview()
    for bad in ({"k": 3, "n": [1]}, {"k": 3, "p": "nope"}, {"k": 3, "f": "/nope"}):
        with pytest.raises((KeyloomError, MissingError)):
            Thing().insert1(bad)
    (Thing & "k=1").delete()
    found = scan(catalog, "main")
    assert found.unused and not (set(hashed) & set(found.unused))
    assert collect(catalog, "main", dry_run=True).deleted == [] and store.files("c.thing")
    collect(catalog, "main", dry_run=False)
    assert not store.files("c.thing") and len(store.files("_hash")) == 1 and store.exists("given/y.bin")
    store.write(hashed[0], b"other")
    with pytest.raises(IntegrityError):
        Thing().fetch1("b")


def test_staged(catalog, store):
    schema = Schema(catalog, "st")

    @schema
    class Recording(Manual):
        definition = """
        k : int32
        ---
        data : <filepath@>
        """

    with Recording().staged_insert1() as stage:
        stage.rec["k"] = 1
        stage.write("data", "raw/1.bin", b"abc")
    assert Recording().fetch1("data").read() == b"abc"
    with pytest.raises(RuntimeError), Recording().staged_insert1() as stage:
        stage.write("data", "raw/2.bin", b"abc")
        raise RuntimeError
    assert not store.exists("raw/2.bin") and len(Recording()) == 1


def test_registry():
    assert {"blob", "attach", "hash", "object", "npy", "filepath"} <= set(codecs.registered())
    with pytest.raises(MissingError):
        codecs.codec("nope")
    with pytest.raises(KeyloomError):
        type("Other", (codecs.Codec,), {"name": "blob", "storage": None, "encode": None, "decode": None})
    type("LoopA", (codecs.Codec,), {"name": "loop_a", "storage": lambda s, i: "<loop_b>", "encode": None, "decode": None, "__abstractmethods__": frozenset()})
    type("LoopB", (codecs.Codec,), {"name": "loop_b", "storage": lambda s, i: "<loop_a>", "encode": lambda *a: 0, "decode": lambda *a: 0})
    with pytest.raises(KeyloomError):
        codecs.chain("loop_a", False)
