import datetime
import decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from keyloom.errors import DuplicateError, IntegrityError, KeyloomError, MissingError
from keyloom.plans.graph import Graph
from keyloom.sources.catalog import Catalog
from keyloom.sources.tables import Lookup, Manual, Part, Schema


@pytest.fixture
def lab(catalog):
    schema = Schema(catalog, "lab")

    @schema
    class Species(Lookup):
        definition = """
        # kinds of animals
        species : varchar(20)
        ---
        legs = 4 : int8  # number of legs
        """
        contents = [("mouse", 4), ("bird", 2)]

    @schema
    class Animal(Manual):
        definition = """
        animal_id : int32
        ---
        -> Species
        name = null : varchar(10)
        sex = 'U' : enum('F','M','U')
        born = CURRENT_TIMESTAMP : datetime
        weight = null : float64
        unique index (name, species)
        """

    @schema
    class Session(Manual):
        definition = """
        -> Animal.proj(subject_id='animal_id')
        session : int16
        ---
        -> [nullable] Animal.proj(witness='animal_id')
        """

        class Trial(Part):
            definition = """
            -> master
            trial : int16
            ---
            score : decimal(5,2)
            """

    return schema, Species, Animal, Session


def test_declaration(lab, catalog, spark):
    schema, Species, Animal, Session = lab
    assert Species.primary_key == ["species"] and len(Species()) == 2
    assert Animal.heading["species"].lineage == "lab.species.species" and not Animal.heading["species"].in_key
    assert Session.heading["subject_id"].lineage == "lab.animal.animal_id"
    assert Session.Trial.primary_key == ["subject_id", "session", "trial"] and Session.Trial.heading["subject_id"].lineage == "lab.animal.animal_id"
    text = Animal().describe()
    assert "-> species" in text and "sex = 'U' : enum('F','M','U')" in text and "unique index (name, species)" in text
    assert Session().parents() == ["lab.animal"] and Animal().children() == ["lab.session"]
    assert Session().parts() == ["lab.session__trial"]
    assert [t for t in Graph(catalog).sorted()] == ["lab.species", "lab.animal", "lab.session", "lab.session__trial"]
    again = Catalog(spark, catalog.store.root)
    assert again.tables("lab") == catalog.tables("lab") and again.definition("lab.animal").heading["sex"].enum == ("F", "M", "U")
    assert set(schema.classes()) == {"Species", "Animal", "Session", "SessionTrial"}


def test_bad_declarations(catalog):
    schema = Schema(catalog, "bad")

    def declare(text):
        return schema(type("Thing", (Manual,), {"definition": text}))

    for text in ("a = null : int32", "a : nonsense", "a int32", "-> Nowhere", "a : int32\na : int32", "a : int32\n---\nindex (zz)", "a : json"):
        with pytest.raises((KeyloomError, MissingError)):
            declare(text)
    one = declare("---\nvalue : int32")
    one().insert1({"value": 3})
    with pytest.raises(DuplicateError):
        one().insert1({"value": 4})
    assert one().fetch1() == {"value": 3} and len(one()) == 1 and one.primary_key == []


def test_inserts(lab):
    _, Species, Animal, Session = lab
    Animal().insert1({"animal_id": 1, "species": "mouse", "name": "a"})
    row = (Animal & {"animal_id": 1}).fetch1()
    assert row["sex"] == "U" and isinstance(row["born"], datetime.datetime) and row["weight"] is None
    Animal().insert([{"animal_id": 2, "species": "bird", "weight": float("nan")}])
    assert (Animal & "animal_id=2").fetch1("weight") is None
    for row, kind in [
        ({"animal_id": 1, "species": "mouse"}, DuplicateError),
        ({"animal_id": 3, "species": "fish"}, IntegrityError),
        ({"animal_id": 3, "species": "mouse", "name": "a"}, DuplicateError),
        ({"animal_id": 3, "species": "mouse", "sex": "X"}, KeyloomError),
        ({"animal_id": 3, "species": "mouse", "name": "much too long"}, KeyloomError),
        ({"animal_id": 3, "species": "mouse", "colour": 1}, KeyloomError),
        ({"animal_id": 3}, IntegrityError),
        ({"animal_id": 1 << 40, "species": "mouse"}, KeyloomError),
    ]:
        with pytest.raises(kind):
            Animal().insert1(row)
    with pytest.raises(DuplicateError):
        Animal().insert([{"animal_id": 9, "species": "mouse"}] * 2)
    Animal().insert1({"animal_id": 3, "species": "mouse", "colour": 1}, ignore_extra_fields=True)
    Animal().insert([{"animal_id": 3, "species": "mouse"}, {"animal_id": 4, "species": "mouse"}], skip_duplicates=True)
    with pytest.raises(DuplicateError):
        Animal().insert1({"animal_id": 5, "species": "mouse", "name": "a"}, skip_duplicates=True)
    assert len(Animal()) == 4
    Animal().insert([{"animal_id": 4, "species": "bird"}], replace=True)
    assert (Animal & "animal_id=4").fetch1("species") == "bird" and len(Animal()) == 4
    Animal().insert([{"animal_id": i, "species": "bird"} for i in range(10, 15)], chunk_size=2)
    assert len(Animal()) == 9
    with pytest.raises(KeyloomError):
        Animal().insert({"animal_id": 1})


def test_sources(lab, spark, tmp_path):
    _, Species, Animal, Session = lab
    Species().insert(pd.DataFrame({"species": ["cat"], "legs": [4]}))
    Species().insert(pa.table({"species": ["ant"], "legs": [6]}))
    Species().insert(np.array([("eel", 0)], dtype=[("species", "U20"), ("legs", "i4")]))
    Species().insert_dataframe(pd.DataFrame({"legs": [8]}, index=pd.Index(["spider"], name="species")))
    (tmp_path / "x.csv").write_text('species,legs\n"a\nb",3\nemu,2\n')
    Species().insert(tmp_path / "x.csv")
    Species().insert(spark.createDataFrame([("bat", 2)], "species string, legs int"))
    assert len(Species()) == 9 and (Species & {"species": "a\nb"}).fetch1("legs") == 3
    Animal().insert(spark.range(5).selectExpr("id as animal_id", "'bat' as species"))
    assert len(Animal()) == 5 and (Animal & "animal_id=1").fetch1("sex") == "U"
    Session().insert([(1, 1, None), (1, 2, 2)])
    Session().insert(Animal.proj("species", subject_id="animal_id").proj(session="7"))  # the common attributes of a query
    assert len(Session & "session=7") == 5
    with pytest.raises(KeyloomError):
        Species().insert(spark.createDataFrame([("x", 2, 1)], "species string, legs int, extra int"))
    with pytest.raises(KeyloomError):
        Species().insert_dataframe(pd.DataFrame({"legs": [8]}, index=pd.Index(["z"], name="other")), index_as_pk=True)
    assert not Species().validate([{"species": "x", "legs": "many"}]) and Species().validate([{"species": "x", "legs": 1}])


def test_updates(lab):
    _, Species, Animal, Session = lab
    Animal().insert([{"animal_id": 1, "species": "mouse", "weight": 3.5}, {"animal_id": 2, "species": "mouse", "weight": None}])
    Animal().update1({"animal_id": 1, "weight": 4.5, "sex": "F"})
    assert (Animal & "animal_id=1").fetch1("weight", "sex") == (4.5, "F") and len(Animal()) == 2
    Animal().update1({"animal_id": 1, "sex": None})
    assert (Animal & "animal_id=1").fetch1("sex") == "U"
    for call in (
        lambda: Animal().update1({"weight": 1}),
        lambda: Animal().update1({"animal_id": 7, "weight": 1}),
        lambda: Animal().update1({"animal_id": 1, "nope": 1}),
        lambda: (Animal & "animal_id=1").update1({"animal_id": 1, "weight": 1}),
        lambda: Animal().update1({"animal_id": 1, "species": "fish"}),
    ):
        with pytest.raises(KeyloomError):
            call()


def fill(lab):
    _, Species, Animal, Session = lab
    Animal().insert([{"animal_id": i, "species": "mouse"} for i in (1, 2, 3)])
    Session().insert([(1, 1, None), (1, 2, 2), (2, 1, None), (3, 1, 1)])
    Session.Trial().insert([(a, s, t, "1.5") for a, s in ((1, 1), (2, 1), (3, 1)) for t in (1, 2)])


def test_cascade(lab, catalog):
    _, Species, Animal, Session = lab
    fill(lab)
    assert (Session.Trial & "trial=1").to_arrays("score").tolist() == [decimal.Decimal("1.50")] * 3
    graph = Graph(catalog)
    assert graph.cascade("lab.animal", {"animal_id": 1}).counts() == {"lab.animal": 1, "lab.session": 3, "lab.session__trial": 4}
    assert graph.restrict("lab.animal", {"animal_id": 1}).counts()["lab.session"] == 0  # subject and witness
    with pytest.raises(IntegrityError):
        (Session.Trial & "trial=1").delete()
    with pytest.raises(IntegrityError):
        Animal().drop_quick()
    assert (Session.Trial & {"subject_id": 2, "trial": 1}).delete(part_integrity="ignore") == 1
    assert len(Session.Trial()) == 5
    assert (Animal & {"animal_id": 1}).delete(prompt=lambda counts: False) == 0 and len(Animal()) == 3
    before = catalog.state["version"]
    assert (Animal & {"animal_id": 1}).delete() == 1
    assert catalog.state["version"] == before + 1  # one commit
    assert len(Animal()) == 2 and len(Session()) == 1 and len(Session.Trial()) == 1
    assert (Session.Trial & {"subject_id": 2}).delete(part_integrity="cascade") == 1 and len(Session()) == 0
    assert catalog.vacuum()


def test_trace(lab, catalog):
    _, Species, Animal, Session = lab
    fill(lab)
    up = (Session & {"subject_id": 1, "session": 2}).trace()
    assert sorted(r["animal_id"] for r in up["lab.animal"]) == [1, 2]  # either way
    assert up.counts()["lab.species"] == 1 and "lab.session__trial" not in up
    assert len((Session.Trial & {"subject_id": 3}).trace()["lab.animal"]) == 2
    assert "n1 -. renamed .-> n2" in Graph(catalog).mermaid()
    g = Graph(catalog, ["lab.animal"])
    assert (g + 1).tables == {"lab.animal", "lab.session"} and (g - 1).tables == {"lab.animal", "lab.species"}
    assert (g + 1).add_parts().topological()[-1] == "lab.session__trial" and ((g + 1) * g).tables == g.tables and not ((g - g).tables)


def test_transactions(lab, catalog, spark):
    _, Species, Animal, Session = lab
    with pytest.raises(ZeroDivisionError):
        with catalog.transaction():
            Animal().insert1({"animal_id": 1, "species": "mouse"})
            assert len(Animal()) == 1
            1 / 0
    assert len(Animal()) == 0
    other = Catalog(spark, catalog.store.root)
    Animal().insert1({"animal_id": 1, "species": "mouse"})
    assert len(other.relation("lab.animal")) == 0
    with pytest.raises(IntegrityError), catalog.transaction():
        other.refresh()
        other.append("lab.animal", other.rows("lab.animal").selectExpr("animal_id + 1 as animal_id", "* except(animal_id)"))
        Animal().insert1({"animal_id": 5, "species": "mouse"})
    catalog.refresh()
    assert len(Animal()) == 2
    with pytest.raises(KeyloomError), catalog.transaction(), catalog.transaction():
        pass
    catalog.compact("lab.animal")
    assert len(catalog.info("lab.animal")["parts"]) == 1


def test_alter_and_drop(lab, catalog):
    _, Species, Animal, Session = lab
    Species().alter("""
    # changed
    species : varchar(20)
    ---
    n_legs = 4 : int16  # {legs} number of legs
    wings = 0 : int8
    """)
    assert (Species & "species='bird'").fetch1("n_legs", "wings") == (2, 0) and catalog.definition("lab.species").comment == "changed"
    with pytest.raises(KeyloomError):
        Species().alter("kind : varchar(20)")
    with pytest.raises(KeyloomError):
        (Species & "wings=0").drop()
    assert Animal().drop() == ["lab.animal", "lab.session", "lab.session__trial"] and catalog.tables() == ["lab.species"]


def test_class_operators(lab):
    _, Species, Animal, Session = lab
    fill(lab)
    assert len(Animal * Species) == 3 and len(Animal - Session.proj(animal_id="subject_id")) == 0 and len(Species & Animal) == 1
    assert len(Animal.aggr(Session.proj(animal_id="subject_id", s="session"), n="count(*)") & "n>1") == 1
    assert {"animal_id": 1} in Animal and len(Animal.fetch("KEY")) == 3 and "animal_id" in repr(Animal())
