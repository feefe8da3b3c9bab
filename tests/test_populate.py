import pytest

from keyloom.errors import KeyloomError
from keyloom.sources.tables import Manual, Part, Schema
from keyloom.streaming import Computed


@pytest.fixture
def tables(catalog):
    schema = Schema(catalog, "p")

    @schema
    class Sensor(Manual):
        definition = """
        sensor : int32
        ---
        value : float64
        """

    @schema
    class Result(Computed):
        definition = """
        -> Sensor
        ---
        value : float64
        """

        class Detail(Part):
            definition = """
            -> master
            k : int8
            """

        def make(self, key, factor=2):
            if key["sensor"] == 13:
                raise ValueError("unlucky" * 1000)
            x = (Sensor & key).fetch1("value")
            assert len(self.upstream["p.sensor"]) == 1
            self.insert1(key | {"value": factor * x})
            Result.Detail().insert([key | {"k": i} for i in range(2)])

    Sensor().insert([(i, i / 2) for i in (1, 2, 13)])
    return schema, Sensor, Result


def test_populate(tables):
    _, Sensor, Result = tables
    assert Result().progress() == (3, 3) and len(Result().todo()) == 3
    with pytest.raises(KeyloomError):
        Result().insert1({"sensor": 1, "value": 0})
    done = Result().populate(suppress_errors=True, make_kwargs={"factor": 4})
    assert done["success_count"] == 2 and done["error_list"][0][0] == {"sensor": 13}
    assert Result().progress() == (1, 3) and len(Result.Detail()) == 4 and (Result & "sensor=2").fetch1("value") == 4
    with pytest.raises(ValueError):
        Result().populate()
    assert Result().populate("sensor<5")["success_count"] == 0
    Sensor().insert1((3, 1.0))
    assert Result().populate({"sensor": 3}, max_calls=1)["success_count"] == 1
    for call in (lambda: (Result & "sensor=1").populate(), lambda: Result().populate(order="odd"), lambda: Result().upstream):
        with pytest.raises(KeyloomError):
            call()


def test_jobs(tables):
    _, Sensor, Result = tables
    jobs = Result().jobs
    assert jobs.refresh(priority=3)["added"] == 3 and jobs.refresh()["added"] == 0
    assert jobs.reserve({"sensor": 1}) and not jobs.reserve({"sensor": 1})
    jobs.ignore({"sensor": 2})
    done = Result().populate(reserve_jobs=True, suppress_errors=True)
    assert done["success_count"] == 0 and len(done["error_list"]) == 1
    assert jobs.progress() == {"pending": 0, "reserved": 1, "success": 0, "error": 1, "ignore": 1, "total": 3}
    assert len(jobs.all("error")[0]["error"]) == 2047 and jobs.all("error")[0]["error"].endswith("...truncated")
    assert jobs.refresh(orphan_timeout=1e-6)["orphaned"] == 1
    assert Result().populate(reserve_jobs=True, keep_completed=True)["success_count"] == 1 and len(jobs.all("success")) == 1
    (Result & "sensor=1").delete()
    assert jobs.refresh(keep_completed=True)["re_pended"] == 1
    jobs.clear()
    assert jobs.progress()["total"] == 0


def test_three_part_make(tables):
    schema, Sensor, _ = tables
    seen = []

    @schema
    class Slow(Computed):
        definition = """
        -> Sensor
        ---
        twice : float64
        """

        def make_fetch(self, key):
            return [(Sensor & key).fetch1("value")]

        def make_compute(self, key, value):
            seen.append(self.catalog.in_transaction)
            if key["sensor"] == 2:
                Sensor().update1({"sensor": 2, "value": 99})
            return [2 * value]

        def make_insert(self, key, twice):
            self.insert1(key | {"twice": twice})

    done = Slow().populate(suppress_errors=True)
    assert done["success_count"] == 2 and "changed" in done["error_list"][0][1] and not any(seen)


def test_make_frame_and_key_rule(tables):
    schema, Sensor, _ = tables

    @schema
    class Fast(Computed):
        definition = """
        -> Sensor
        ---
        x : float64
        """

        def make_frame(self, keys):
            return keys.join(Sensor.df, "sensor").selectExpr("sensor", "value * 3 as x")

    assert Fast().populate()["success_count"] == 3 and (Fast & "sensor=2").fetch1("x") == 3 and Fast().populate()["success_count"] == 0
    with pytest.raises(KeyloomError):
        schema(type("Own", (Computed,), {"definition": "-> Sensor\nn : int8"}))
