import datetime

import pytest

from keyloom.functions.dialect import translate
from keyloom.functions.json_path import parse


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a = 'it''s (x' AND b > 2", "a = 'it''s (x' AND b > 2"),
        ("x like '%%y%%'", "x like '%y%'"),
        ("GROUP_CONCAT(name)", "listagg(CAST(name AS STRING), ',')"),
        ("group_concat(distinct concat(a, '(', b) order by a desc separator ', ')", "listagg(DISTINCT CAST(concat(a, '(', b) AS STRING), ', ') WITHIN GROUP (ORDER BY a desc)"),
        ("STRING_AGG(x, ';')", "listagg(CAST(x AS STRING), ';')"),
        ("STRING_AGG(x, ';' ORDER BY y)", "listagg(CAST(x AS STRING), ';') WITHIN GROUP (ORDER BY y)"),
        ("sum(a = 'F') / count(*)", "SUM(CAST((a = 'F') AS INT)) / count(*)"),
        ("sum((a > 1 or b is null))", "SUM(CAST(((a > 1 or b is null)) AS INT))"),
        ("sum(case_price)", "sum(case_price)"),
        ("round(sum(if(a=1, b, 0)), 2)", "round(sum(if(a=1, b, 0)), 2)"),
        ("car->>'$.name'", "get_json_object(car, '$.name')"),
        ("json_value(car, '$.len' returning decimal(4,1)) > 3", "CAST(get_json_object(car, '$.len') AS decimal(4,1)) > 3"),
        ("(a + b)::text", "CAST((a + b) AS string)"),
        ("d - INTERVAL '3 days'", "d - INTERVAL 3 days"),
        ("CURRENT_TIMESTAMP(3)", "date_trunc('MILLISECOND', current_timestamp())"),
    ],
)
def test_translate(text, expected):
    assert translate(text) == expected


def test_unbalanced():
    with pytest.raises(ValueError):
        translate("f(a")


def test_runs(spark):
    df = spark.createDataFrame([(1, "x", datetime.date(2020, 3, 4)), (2, "y", None)], "k int, s string, d date")
    one = df.selectExpr(translate("group_concat(s order by k desc separator '+')"), translate("sum(s = 'x')"), translate("max(year(d))"), translate("min(d - interval '1 month')::text")).first()
    assert tuple(one) == ("y+x", 1, 2020, "2020-02-04")


@pytest.mark.parametrize("text, expected", [("a.b", ("a", "$.b", None)), ("a.b[0].c:decimal(3,1)", ("a", "$.b[0].c", "decimal(3,1)")), ("a", None), ("a.b + 1", None), ("a:int", None)])
def test_paths(text, expected):
    assert parse(text) == expected
