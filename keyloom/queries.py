"""Queries over the synthetic star schema, one for each operator, with the SQL that they must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import AndList, Not, Relation, Top, U
from .plans.graph import Graph
from .sources.catalog import Catalog, Mounted
from .sources.definition import Definition, ForeignKey
from .sources.tables import Manual, Part, Schema
from .streaming.populate import Computed

KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"],
}
ORIGINS = {
    "nation": {"n_regionkey": "region.r_regionkey"},
    "customer": {"c_nationkey": "nation.n_nationkey"},
    "supplier": {"s_nationkey": "nation.n_nationkey"},
    "orders": {"o_custkey": "customer.c_custkey"},
    "lineitem": {"l_orderkey": "orders.o_orderkey", "l_partkey": "part.p_partkey", "l_suppkey": "supplier.s_suppkey"},
    "events": {"user_id": "customer.c_custkey"},
    "labels": {"doc_id": "documents.doc_id"},
}


class Tables:
    """The tables of a folder as relations, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Relation:
        # lineitem's key repeats in these tables
        return Relation.of(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"), KEYS[name], name, ORIGINS.get(name), unique=name != "lineitem")

    def catalog(self) -> Mounted:
        """The tables with their foreign keys, where they lie."""
        frames, definitions = {}, {}
        for name in KEYS:
            relation, references = getattr(self, name), {}
            for column, origin in ORIGINS.get(name, {}).items():
                parent, key = origin.split(".")
                references[column] = ForeignKey(f"sf.{parent}", {column: key}, primary=column in KEYS[name])
            frames[f"sf.{name}"] = relation.df
            definitions[f"sf.{name}"] = Definition("", relation.heading, list(references.values()))
        return Mounted(self.spark, frames, definitions, {"sf.labels": "computed"})

    def scratch(self) -> Schema:
        """An empty catalog of its own, in the shared warehouse."""
        return Schema(Catalog(self.spark, f"{self.spark.conf.get('spark.sql.warehouse.dir')}/scratch/{uuid.uuid4().hex}"), "scratch")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Tables], Relation | DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Relation) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


CENTS = "cast(round(o_totalprice * 100) as bigint)"


@query("""SELECT c_custkey, c_nationkey, count(o_orderkey) AS n, sum(cast(round(o_totalprice * 100) as bigint))::BIGINT AS cents, n_name AS nation
FROM customer LEFT JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY c_custkey, c_nationkey, n_name""")
def flagship(t):
    spent = t.customer.aggr(t.orders.proj(c_custkey="o_custkey", cents=CENTS), "c_nationkey", n="count(o_orderkey)", cents="sum(cents)")
    return spent * t.nation.proj(c_nationkey="n_nationkey", nation="n_name")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment LIKE 'B%'")
def restrict_str(t):
    return t.customer & 'c_acctbal > 5000 and c_mktsegment like "B%%"'


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def restrict_dict(t):
    return (t.orders & {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "unknown": 3}).proj("o_orderstatus")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_nationkey = 7 OR c_acctbal < 0")
def restrict_or_list(t):
    return (t.customer & [{"c_nationkey": 3}, {"c_nationkey": 7}, "c_acctbal < 0"]).proj()


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 1 AND 30 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#22', 'Brand#33')""")
def restrict_many_keys(t):
    return (t.part & [{"p_size": s, "p_brand": f"Brand#{b}"} for s in range(1, 31) for b in (11, 12, 22, 33)]).proj()


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 10 AND p_size < 30 AND (p_brand = 'Brand#11' OR p_retailprice > 1000)")
def restrict_andlist(t):
    return (t.part & AndList(["p_size > 10", "p_size < 30", ["p_brand = 'Brand#11'", "p_retailprice > 1000"]])).proj("p_brand")


@query("SELECT p_partkey FROM part WHERE NOT (p_size > 10 OR p_brand = 'Brand#11')")
def restrict_not(t):
    return (t.part - ["p_size > 10", {"p_brand": "Brand#11"}]).proj()


@query("SELECT o_orderkey, priority FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS priority FROM orders) WHERE priority IS NULL")
def restrict_null(t):
    return t.orders.proj(priority="nullif(o_orderpriority, '5-LOW')") & {"priority": None}


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND event_type IN (SELECT min(event_type) FROM events)")
def restrict_relation_value(t):
    least = U().aggr(t.events, event_type="min(event_type)").proj("event_type")
    return t.events.restrict("ts >= timestamp '2024-01-01'").restrict(least, semantic_check=False).proj("event_type")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semijoin(t):
    return (t.orders & (t.lineitem & "l_quantity > 45").proj(o_orderkey="l_orderkey")).proj("o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def antijoin(t):
    return (t.orders - t.lineitem.proj(o_orderkey="l_orderkey")).proj("o_custkey")


@query("""SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)
WHERE k NOT IN (SELECT nullif(s_nationkey, 999) FROM supplier WHERE s_acctbal > 9000)""")
def anti_null_aware(t):
    rich = (t.supplier & "s_acctbal > 9000").proj(k="nullif(s_nationkey, 999)")
    return (t.customer.proj(k="nullif(c_nationkey, 3)").restrict(Not(rich), semantic_check=False)).proj()


@query("SELECT r_regionkey, r_name FROM region WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 9000)")
def semijoin_no_common(t):
    return t.region & (t.supplier & "s_acctbal > 9000")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') OR o_totalprice < 20000")
def semijoin_or(t):
    return (t.orders & [(t.lineitem & "l_returnflag = 'R'").proj(o_orderkey="l_orderkey"), "o_totalprice < 20000"]).proj()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem")
def proj_pk(t):
    return t.lineitem.proj()


@query("SELECT c_custkey AS customer, c_name AS name, c_nationkey FROM customer")
def proj_rename(t):
    return t.customer.proj("c_nationkey", customer="c_custkey", name="c_name")


@query("SELECT o_orderkey, o_orderkey AS same, o_custkey FROM orders")
def proj_dup(t):
    return t.orders.proj("o_custkey", same="(o_orderkey)")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, cast(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents FROM lineitem")
def proj_compute(t):
    return t.lineitem.proj(cents="cast(round(l_extendedprice * (1 - l_discount) * 100) as bigint)")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def proj_exclude(t):
    return t.customer.proj(..., "-c_nationkey", "-c_mktsegment")


@query("SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_natural(t):
    return t.nation * t.region.proj(..., n_regionkey="r_regionkey")


@query("SELECT r_regionkey, n_nationkey FROM region, nation")
def join_cross(t):
    return t.region.proj() * t.nation.proj()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_totalprice, o_custkey FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'O') ON l_orderkey = o_orderkey")
def join_left_extend(t):
    return t.lineitem.proj().extend((t.orders & {"o_orderstatus": "O"}).proj("o_totalprice", "o_custkey", l_orderkey="o_orderkey"))


@query("""SELECT a.s_suppkey AS s_suppkey, b.s_suppkey AS other, a.s_nationkey AS s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey""")
def join_self_pairing(t):
    return t.supplier.proj("s_nationkey") * t.supplier.proj("s_nationkey", other="s_suppkey") & "s_suppkey < other"


@query("SELECT o_orderkey, o_orderpriority, count(l_linenumber) AS n, max(l_quantity) AS most FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority")
def aggr_keep_all(t):
    return t.orders.aggr(t.lineitem.proj("l_quantity", o_orderkey="l_orderkey"), "o_orderpriority", n="count(l_linenumber)", most="max(l_quantity)")


@query("SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_tax > 0.04 GROUP BY o_orderkey")
def aggr_inner(t):
    return t.orders.aggr((t.lineitem & "l_tax > 0.04").proj(o_orderkey="l_orderkey"), n="count(*)", exclude_nonmatching=True)


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 12")
def aggr_having(t):
    return t.customer.aggr(t.orders.proj(c_custkey="o_custkey"), n="count(o_orderkey)") & "n > 12"


@query("""SELECT n_nationkey, max(n) AS most, count(*) AS customers FROM nation LEFT JOIN (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_nationkey) ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def aggr_nested(t):
    per_customer = t.customer.aggr(t.orders.proj(c_custkey="o_custkey"), "c_nationkey", n="count(o_orderkey)")
    return t.nation.aggr(per_customer.proj("n", n_nationkey="c_nationkey"), most="max(n)", customers="count(*)")


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def u_distinct(t):
    return U("c_nationkey", "c_mktsegment") & t.customer


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(cast(l_quantity AS BIGINT))::BIGINT AS quantity, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def u_aggr(t):
    shipped = t.lineitem & "l_shipdate <= timestamp '1998-09-02'"
    return U("l_returnflag", "l_linestatus").aggr(shipped, n="count(*)", quantity="sum(cast(l_quantity as bigint))", cents="sum(cast(round(l_extendedprice * 100) as bigint))")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first FROM events")
def u_total(t):
    return U().aggr(t.events, n="count(*)", users="count(distinct user_id)", first="min(ts)")


@query("SELECT count(*) AS n FROM events HAVING count(*) > 10")
def u_total_having(t):
    return U().aggr(t.events, n="count(*)") & "n > 10"


@query("SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def union_pk(t):
    rich = U("s_nationkey") & (t.supplier & "s_acctbal > 5000")
    return (t.nation & {"n_regionkey": 1}).proj() + rich.proj(n_nationkey="s_nationkey")


@query("""SELECT coalesce(a.k, b.k) AS c_custkey, a.n AS orders, b.n AS events FROM (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1) a
FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k""")
def union_keyed_full(t):
    a = U("o_custkey").aggr(t.orders & "o_totalprice > 100000", orders="count(*)").proj("orders", c_custkey="o_custkey")
    b = U("user_id").aggr(t.events, events="count(*)").proj("events", c_custkey="user_id")
    return a + b


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return (t.orders & Top(10, ["o_totalprice DESC", "KEY"])).proj("o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15")
def top_offset(t):
    return (t.orders & Top(10, ["o_totalprice DESC", "KEY"], offset=15)).proj("o_totalprice")


@query("SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 3 OFFSET 5")
def top_merge(t):
    return (t.part & Top(10, "KEY DESC", offset=2) & Top(3, None, offset=3)).proj()


@query("SELECT p_partkey, p_size FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) WHERE p_size > 20")
def top_then_restrict(t):
    return (t.part & Top(50, ["p_retailprice DESC", "KEY"]) & "p_size > 20").proj("p_size")


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def string_agg(t):
    return U("n_regionkey").aggr(t.nation, names="GROUP_CONCAT(n_name ORDER BY n_name SEPARATOR ';')")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_totalprice > 1e5) AS large FROM orders GROUP BY o_custkey")
def sum_condition(t):
    return U("o_custkey").aggr(t.orders, filled="sum(o_orderstatus = 'F')", large="sum(o_totalprice > 1e5)")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders")
def date_parts(t):
    return t.orders.proj(y="YEAR(o_orderdate)", m="MONTH(o_orderdate)", d="DAY(o_orderdate)")


@query("SELECT event_id, datediff('day', DATE '2020-01-01', ts::DATE) AS days FROM events")
def timestampdiff(t):
    return t.events.proj(days="timestampdiff(DAY, timestamp '2020-01-01 00:00:00', date(ts))")


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def json_path_text(t):
    return t.events.proj(k="props.k")


@query("SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT))::BIGINT AS total FROM events GROUP BY event_type")
def json_path_typed(t):
    return U("event_type").aggr(t.events.proj("event_type", k="props.k:bigint"), total="sum(k)")


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) = 7")
def json_restrict(t):
    return (t.events & {"props.k:int": 7}).proj()


class Labelled(Computed):
    """The table of labels, as one that is computed from documents."""

    def __init__(self, t: Tables):
        self.catalog, self.full_name = t.catalog(), "sf.labels"


@query("SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def populate_todo(t):
    return Labelled(t).todo(t.documents & {"lang": "en"})


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS remaining, count(*) AS total FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def progress(t):
    return t.spark.createDataFrame([Labelled(t).progress()], "remaining long, total long")


def _counted(found, names):
    out = None
    for n in names:
        one = found[f"sf.{n}"].df.agg(F.count("*").alias("n")).select(F.lit(n).alias("tab"), "n")
        out = one if out is None else out.union(one)
    return out


@query("""SELECT 'customer' AS tab, count(*) AS n FROM customer WHERE c_nationkey = 4 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 4)""")
def cascade_children(t):
    return _counted(Graph(t.catalog()).cascade("sf.nation", {"n_nationkey": 4}), ["customer", "orders", "lineitem"])


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity = 50 AND l_tax > 0.07)
OR n_nationkey IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_quantity = 50 AND l_tax > 0.07)""")
def trace_ancestors(t):
    catalog = t.catalog()
    return Graph(catalog).trace("sf.lineitem", catalog.relation("sf.lineitem") & "l_quantity = 50" & "l_tax > 0.07")["sf.nation"].proj("n_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 8))
AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 8)""")
def restrict_and_convergence(t):
    catalog = t.catalog()
    return Graph(catalog).restrict("sf.nation", catalog.relation("sf.nation") & "n_nationkey < 8")["sf.lineitem"].proj()


@query("""SELECT 'region' AS tab, count(DISTINCT n_regionkey) AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900)
UNION ALL SELECT 'nation', count(DISTINCT c_nationkey) FROM customer WHERE c_acctbal < -900""")
def trace_counts(t):
    catalog = t.catalog()
    return _counted(Graph(catalog).trace("sf.customer", catalog.relation("sf.customer") & "c_acctbal < -900"), ["region", "nation"])


@query("SELECT unnest(['sf.customer', 'sf.events', 'sf.lineitem', 'sf.nation', 'sf.orders', 'sf.supplier']) AS tab")
def descendants(t):
    return t.spark.createDataFrame([(x,) for x in Graph(t.catalog()).descendants("sf.nation")], "tab string")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def restrict_numpy_void(t):
    row = np.array([("F", "1-URGENT")], dtype=[("o_orderstatus", "U1"), ("o_orderpriority", "U15")])[0]
    return (t.orders & row).proj("o_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE (p_size, p_brand) IN ((1, 'Brand#11'), (7, 'Brand#22'), (9, 'Brand#33'))")
def restrict_dataframe(t):
    return (t.part & pd.DataFrame({"p_size": [1, 7, 9], "p_brand": ["Brand#11", "Brand#22", "Brand#33"]})).proj("p_size")


@query("SELECT r_regionkey, r_name FROM region")
def restrict_true_and_universal(t):
    return t.region & True & U("r_name")


@query("SELECT r_regionkey, r_name FROM region WHERE false")
def restrict_empty_list(t):
    return t.region & []


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 3)")
def restrict_by_u(t):
    return (t.nation & (U("n_regionkey") & (t.nation & "n_nationkey < 3"))).proj()


@query("SELECT c_custkey, 7 AS seven, 'x' AS letter, c_acctbal IS NULL AS unknown FROM customer")
def proj_constants(t):
    return t.customer.proj(seven="7", letter="'x'", unknown="c_acctbal is null")


@query("""SELECT n_nationkey, n_name, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name, n_regionkey""")
def aggr_all_attributes(t):
    return t.nation.aggr(t.customer.proj(n_nationkey="c_nationkey"), ..., n="count(c_custkey)")


@query("SELECT DISTINCT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal > 9500")
def aggr_key_only(t):
    return t.nation.aggr((t.customer & "c_acctbal > 9500").proj(n_nationkey="c_nationkey"), exclude_nonmatching=True)


@query("SELECT event_type, count(DISTINCT user_id) AS users, min(user_id) AS least FROM events GROUP BY event_type HAVING count(DISTINCT user_id) > 1")
def u_aggr_having(t):
    return U("event_type").aggr(t.events, users="count(distinct user_id)", least="min(user_id)") & "users > 1"


@query("SELECT event_id, props->>'$.k' AS k, CAST(props->>'$.k' AS BIGINT) + 1 AS next FROM events")
def json_functions(t):
    return t.events.proj(k="props->>'$.k'", next="json_value(props, '$.k' returning bigint) + 1")


@query("SELECT event_id FROM events WHERE props->>'$.missing' IS NULL")
def json_missing_is_null(t):
    return (t.events & {"props.missing": None}).proj()


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-15' - INTERVAL 30 DAY AND o_orderdate < TIMESTAMP '1995-03-15' + INTERVAL 1 MONTH")
def intervals(t):
    return (t.orders & "o_orderdate >= timestamp '1995-03-15' - INTERVAL '30 day' and o_orderdate < timestamp '1995-03-15' + INTERVAL 1 MONTH").proj()


@query("SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) AS code, abs(c_acctbal) AS size, c_nationkey % 5 AS rest, coalesce(nullif(c_nationkey, 3), -1) AS k FROM customer")
def scalar_functions(t):
    return t.customer.proj(code="upper(substr(c_mktsegment, 1, 3))", size="abs(c_acctbal)", rest="c_nationkey % 5", k="coalesce(nullif(c_nationkey, 3), -1)")


@query("SELECT c_custkey, c_acctbal::INT AS whole, 'q:' || c_mktsegment AS text FROM customer WHERE c_acctbal BETWEEN 100.5 AND 900.25 AND c_mktsegment IS NOT NULL")
def casts_and_between(t):
    # the SQL's cast takes halves of a double to the even number, as rint does; Spark's cast cuts, and its round takes them away from zero
    return (t.customer & "c_acctbal between 100.5 and 900.25" & "c_mktsegment is not null").proj(whole="cast(rint(c_acctbal) as int)", text="'q:' || c_mktsegment")


@query("""SELECT c_custkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k, nullif(c_mktsegment, 'BUILDING') AS m FROM customer) c
WHERE (k, m) NOT IN (SELECT nullif(c_nationkey, 4), nullif(c_mktsegment, 'MACHINERY') FROM customer WHERE c_acctbal > 9900 AND c_nationkey <> 4 AND c_mktsegment <> 'MACHINERY')""")
def anti_several_nullable(t):
    rich = t.customer & "c_acctbal > 9900 and c_nationkey <> 4 and c_mktsegment <> 'MACHINERY'"
    other = U("k", "m") & rich.proj(k="nullif(c_nationkey, 4)", m="nullif(c_mktsegment, 'MACHINERY')")
    return t.customer.proj(k="nullif(c_nationkey, 3)", m="nullif(c_mktsegment, 'BUILDING')").restrict(Not(other), semantic_check=False).proj()


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 25")
def head(t):
    return t.spark.createDataFrame([(r["p_partkey"], r["p_name"]) for r in t.part.proj("p_name").head()], "p_partkey long, p_name string")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey DESC LIMIT 25")
def tail(t):
    return t.spark.createDataFrame([(r["p_partkey"], r["p_name"]) for r in t.part.proj("p_name").tail()], "p_partkey long, p_name string")


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS entities, (SELECT count(*) FROM region) AS regions, true AS there, false AS gone")
def sizes(t):
    few = Relation.of(t.lineitem.df, ["l_orderkey", "l_linenumber"])
    return t.spark.createDataFrame([(len(few), len(t.region), bool(t.region), bool(t.region & "false"))], "entities long, regions long, there boolean, gone boolean")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def fetched(t):
    """The ways of fetching agree."""
    some = (t.nation & {"n_regionkey": 1}).proj("n_name")
    key, names = some.to_arrays("n_nationkey", "n_name", order_by="KEY")
    dicts, frame, arrow = some.to_dicts(order_by="KEY"), some.to_pandas(order_by="KEY"), some.to_arrow(order_by="KEY")
    assert dicts == [{"n_nationkey": k, "n_name": n} for k, n in zip(key.tolist(), names.tolist(), strict=True)] == arrow.to_pylist() == frame.reset_index().to_dict("records")
    assert some.keys(order_by="KEY") == [{"n_nationkey": k} for k in key.tolist()] and sorted(map(str, some)) == sorted(map(str, dicts))
    return t.spark.createDataFrame(dicts, "n_nationkey int, n_name string")


def _nations(t: Tables) -> tuple[type[Manual], type[Manual]]:
    """Regions and nations in a catalog of their own."""
    schema = t.scratch()

    class Region(Manual):
        definition = """
        r_regionkey : int32
        ---
        r_name : varchar(40)
        """

    class Nation(Manual):
        definition = """
        n_nationkey : int32
        ---
        -> Region.proj(n_regionkey='r_regionkey')
        n_name : varchar(40)
        """

        class Letter(Part):
            definition = """
            -> master
            place : int32
            ---
            letter : varchar(1)
            """

    schema(Region, context={"Region": Region})
    schema(Nation, context={"Region": Region, "Nation": Nation})
    Region().insert(t.region.df.select("r_regionkey", "r_name"))
    Nation().insert(t.nation.df.select("n_nationkey", "n_regionkey", "n_name"))
    Nation.Letter().insert(t.nation.df.select("n_nationkey", F.posexplode(F.split("n_name", ""))).select("n_nationkey", F.col("pos").alias("place"), F.col("col").alias("letter")))
    return Region, Nation


@query("SELECT n_nationkey, n_regionkey, n_name FROM nation")
def insert_and_scan(t):
    return _nations(t)[1]().df


@query("SELECT n_nationkey, n_regionkey, CASE WHEN n_nationkey < 5 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation")
def insert_replace(t):
    nation = _nations(t)[1]()
    nation.insert((t.nation & "n_nationkey < 5").df.select("n_nationkey", "n_regionkey", F.concat(F.upper("n_name"), F.lit("!")).alias("n_name")), replace=True)
    return nation.df


@query("SELECT n_nationkey, n_regionkey, n_name FROM nation UNION ALL SELECT 1000, 0, 'NEW'")
def insert_skip_duplicates(t):
    nation = _nations(t)[1]()
    nation.insert([{"n_nationkey": k, "n_regionkey": 0, "n_name": "NEW"} for k in (1, 2, 1000)], skip_duplicates=True)
    return nation.df


@query("SELECT n_nationkey, n_regionkey, CASE n_nationkey WHEN 3 THEN 'three' ELSE n_name END AS n_name FROM nation")
def update_one(t):
    nation = _nations(t)[1]()
    nation.update1({"n_nationkey": 3, "n_name": "three"})
    return nation.df


@query("SELECT 'region' AS tab, count(*) AS n FROM region WHERE r_regionkey <> 1 UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'letter', sum(length(n_name))::BIGINT FROM nation WHERE n_regionkey <> 1")
def delete_cascades(t):
    region, nation = _nations(t)
    (region() & {"r_regionkey": 1}).delete()
    rows = [("region", len(region())), ("nation", len(nation())), ("letter", len(nation.Letter()))]
    return t.spark.createDataFrame(rows, "tab string, n long")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name NOT LIKE '%2%'")
def delete_part_with_master(t):
    nation = _nations(t)[1]
    (nation.Letter() & {"letter": "2"}).delete(part_integrity="cascade")
    return nation().proj("n_name").df


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def raw_sql(t):
    from .sources.sql import frame

    catalog = t.catalog()
    return frame(catalog, "SELECT n_nationkey, n_name, r_name AS region FROM sf.nation JOIN sf.region ON r_regionkey = n_regionkey")


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate, rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate) AS place FROM lineitem")
def window_in_proj(t):
    return t.lineitem.proj(place="cast(rank() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_shipdate) as bigint)")


@query("""SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier JOIN (SELECT s_nationkey AS k, max(s_acctbal) AS most FROM supplier GROUP BY 1) ON k = s_nationkey AND most = s_acctbal""")
def argmax(t):
    most = U("s_nationkey").aggr(t.supplier, most="max(s_acctbal)")
    return (t.supplier * most & "s_acctbal = most").proj("s_nationkey", "s_acctbal")
