import pytest

from keyloom.errors import KeyloomError, MissingError
from keyloom.plans.graph import Graph
from keyloom.sources.protocols import open_store, protocol
from keyloom.sources.tables import Manual, Schema
from keyloom.streaming import Computed
from keyloom.streaming.follow import follow


def test_follow(spark, catalog, tmp_path):
    schema = Schema(catalog, "f")

    @schema
    class Event(Manual):
        definition = "k : int64\n---\nv = null : float64"

    @schema
    class Double(Computed):
        definition = "-> Event\n---\nx : float64"

        def make_frame(self, keys):
            return keys.join(Event.df, "k").selectExpr("k", "v * 2 as x")

    folder = str(tmp_path / "in")
    rows = lambda a, z: spark.range(a, z).selectExpr("id as k", "cast(id as double) as v", "'x' as extra")
    for a in (0, 3):
        rows(a, a + 5).write.mode("append").parquet(folder)  # 3 and 4 come twice
        follow(spark, folder, rows(0, 1).schema, Event(), str(tmp_path / "cp"), [Double()]).awaitTermination()
    assert len(Event()) == 8 and len(Double()) == 8 and (Double & "k=7").fetch1("x") == 14
    g = Graph(catalog)
    assert g.mermaid(collapse=True) == "flowchart TB\n  f[f]"
    assert Graph.from_sequence([Graph(catalog, ["f.event"]), Graph(catalog, ["f.double"])]).tables == g.tables


def test_protocols(spark, tmp_path):
    store = open_store(spark, {"protocol": "file", "location": str(tmp_path)}, "of_test")
    store.write("a/b", b"1")
    assert store.read("a/b") == b"1" and store.files("a") == {"a/b": 1} and store.publish("a/c", b"2") and not store.publish("a/c", b"3") and store.read("a/c") == b"2"
    assert protocol("s3").uri({"bucket": "b", "location": "/x/"}) == "s3a://b/x"
    assert protocol("s3").settings({"bucket": "b", "location": "x", "access_key": "k", "secure": False}) == {"fs.s3a.bucket.b.access.key": "k", "fs.s3a.bucket.b.connection.ssl.enabled": "false"}
    assert protocol("azure").uri({"account": "a", "container": "c", "location": "x"}).startswith("abfss://c@a.") and protocol("gcs").uri({"bucket": "b", "location": "x"}) == "gs://b/x"
    for spec, kind in (({"protocol": "s3", "location": "x"}, KeyloomError), ({"protocol": "file", "location": "x", "odd": 1}, KeyloomError), ({"protocol": "ftp"}, MissingError)):
        with pytest.raises(kind):
            open_store(spark, spec)
    with pytest.raises(MissingError):
        store.read("nope")
