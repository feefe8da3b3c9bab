import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def catalog(spark, tmp_path):
    from keyloom.sources.catalog import Catalog

    return Catalog(spark, str(tmp_path / "catalog"))


SF = "/root/testdata/sf0.001"
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"]}
FOREIGN = {"nation": {"n_regionkey": "region.r_regionkey"}, "customer": {"c_nationkey": "nation.n_nationkey"}, "orders": {"o_custkey": "customer.c_custkey"}}


@pytest.fixture
def table(spark):
    from keyloom.operators import Relation

    return lambda name: Relation.of(spark.read.parquet(f"{SF}/{name}.parquet"), KEYS[name], name, FOREIGN.get(name))
