"""Quality limits follow their groups; positions and takings follow the schedules."""

import random

import pytest
from pyspark.sql import functions as F

from keyloom.llm.mixing import mix_sources, mixed_rows
from keyloom.llm.quality_rules import RULES, passing, quality_rules
from keyloom.llm.queries import op8_quality_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(8)
    word = lambda k: "".join(r.choices("abcdefghijklmnop", k=k))
    lines = [f"{word(4)} {word(5)}" for _ in range(25)]
    rows = []
    for i in range(300):
        rows.append((2 * i, " ".join(word(r.randint(4, 6)) for _ in range(60)), "en", "prose"))
        code = [word(r.randint(6, 18)) + "#" * r.randint(0, 3) for _ in range(60)]
        again = " ".join(code[:5])
        rows.append((2 * i + 1, " ".join(code) + "\n" + "\n".join(r.choices(lines, k=40)) + f"\n{again}", "en", "code"))
    rows.append((1000, " ".join(f"{word(5)}{'#' * (k % 4 == 0)}" for k in range(60)), "en", "prose"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return quality_rules(df, min_docs=10).toPandas().set_index("doc_id")


def test_every_limit_follows_its_group(judged):
    limits = judged.groupby("g_source")[[f"{m}_limit" for m in RULES]].first()
    assert all(limits.loc["code", c] != limits.loc["prose", c] for c in limits), limits.T


def test_no_fixed_cutoff_gives_these_verdicts(judged):
    odd, code = judged.loc[1000], judged[judged.g_source == "code"]
    assert not odd.kept and code.kept.mean() > 0.9 and (code[code.kept].symbol_pm > odd.symbol_pm).any()


def test_weight_of_the_own_sketch_grows_smoothly(spark):
    """One document more never makes a group's limit jump between its language's and its own."""
    many = [(i, " ".join(f"w{i}x{k}" for k in range(30)), "en", "large") for i in range(400)]
    seen = []
    for n in (1, 5, 25, 125):
        few = [(1000 + i, " ".join(f"w{i}y{k}#" for k in range(30)), "en", "small") for i in range(n)]
        got = quality_rules(spark.createDataFrame(many + few, "doc_id long, text string, lang string, source string"))
        seen.append(got.filter("g_source = 'small'").agg(F.max("symbol_pm_limit")).first()[0])
    assert seen == sorted(seen) and len(set(seen)) == 4


def test_a_language_keeps_its_own_length_of_words(spark):
    """A lone document without spaces in a language of its own isn't judged by others' words."""
    rows = [(i, " ".join(f"w{k}" for k in range(30)), "en", "s") for i in range(300)] + [(999, " ".join(f"{k}" + "字" * 90 for k in range(12)), "zh", "s")]
    assert passing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).filter("doc_id = 999").count() == 1


def test_labelled_junk_goes_and_clean_text_stays(spark):
    got = op8_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    share = {r["quality"]: r["kept"] for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] >= 0.95 and share[0] <= 0.05


def test_stages_keep_columns_of_any_name(spark, docs):
    extra = {c: F.lit("x") for c in ("row", "i", "h", "j", "k", "__text", "__w", "kept", "n_lines", "good", "at", "__range", "copies")}
    few = docs.filter("doc_id < 40 or doc_id > 999")
    for stage in (passing, mixed_rows):
        plain, wide = stage(few), stage(few.withColumns(extra))
        assert wide.columns == [*docs.columns, *extra]
        assert sorted(map(str, plain.select("doc_id", "text").collect())) == sorted(map(str, wide.select("doc_id", "text").collect()))


def test_schedules_decide_positions_and_takings(docs):
    end = {u: mix_sources(docs, until=u).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target")).collect() for u in (0.5, 1.0)}
    assert all(abs(r["n"] - r["target"]) <= 1 for r in end[1.0])
    names = sorted((r["source"] for r in end[0.5] if r["source"] is not None)) + [None]
    for r in end[0.5]:  # front-loaded sources have given more by then, back-loaded ones less
        share = {0: 0.625, 1: 0.5, 2: 0.375}[names.index(r["source"]) % 3]
        assert abs(r["n"] - share * r["target"]) <= 1
    rows = lambda **how: sorted(map(str, mix_sources(docs, **how).select("doc_id", "size", "first_position").collect()))
    assert rows() != rows(slopes=(0.0, 0.0, 0.0)) and rows() == rows(slopes=(-0.5, 0.0, 0.5))


def test_many_sources(spark):
    """Targets of 300 sources equal those of filling step by step."""
    r = random.Random(5)
    rows = [(i, "w " * r.randint(1, 40), f"s{i % 300:03d}" if i % 300 else None) for i in range(900)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("source", "source_size", "target").distinct().collect()
    size = {x["source"]: x["source_size"] for x in got}
    names = sorted(s for s in size if s) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), sum(size.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * size[s]}
        target |= {s: 3.0 * size[s] if over else level * weight[s] for s in over or free}
        left -= sum(3 * size[s] for s in over)
        free = free - over if over else set()
    assert all(abs(x["target"] - target[x["source"]]) < 1e-6 for x in got)


def test_repeated_rows_without_id(spark):
    """Rows of one null id stand in the line one after the other, and take their source's target together."""
    df = spark.createDataFrame([(None, "a b c", "s")] * 500 + [(1, "d " * 30, "t")], "doc_id long, text string, source string")
    got = mix_sources(df).groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("target"), F.count("*").alias("rows")).collect()
    assert all(abs(x["n"] - x["target"]) <= 1 for x in got) and sum(x["rows"] for x in got) == 501
