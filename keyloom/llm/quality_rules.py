"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets counts (words, symbols, repeated lines, repeated five-word windows) and from them integer metrics:
rates per thousand of what exceeds chance, which is c less 2 sqrt(c) of a count c, so that one stray symbol in a short text
is no rate yet; and the mean length of words. Per language and source, a mergeable quantile sketch of each metric is kept: a
log-linear histogram whose buckets hold integers to seven significant bits, so that two sketches merge by adding counts and a
quantile is exact to 1/64 of its value.

A group's limit is one of its quantiles plus a multiple of that quantile's distance from the group's median. Nothing is added
to it: where four fifths of a group have no symbols, the limit is none beyond chance, and where they have many, it is high. As few
documents tell little of a group, its limit is averaged with its language's, which counts for MIN_DOCS documents, and
the language's with that of all documents; so the weight of the own sketch grows smoothly with the group. The length of words isn't
shared between languages. Documents meet the limits in a join on language and source. Hot groups cost nothing: the sketches are
sums, which Spark adds up before it shuffles.

Defined results: null or empty text has no words and fails the base rules; null language or source is a group of its
own; every row is judged by itself, so repeated rows get equal verdicts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WHITE, saved

SYMBOLS = "#*$%&|<>"
#: Documents for which the limit of a group's language, and of all documents, counts beside the group's own.
MIN_DOCS = 100
#: metric: (side, quantile in hundredths, times, shared). A metric fails beyond the quantile plus so many times its distance from the
#: median. Shared: between languages. Symbols, which junk has and other text doesn't, take a quantile that holds while less than a
#: fifth of a group is junk; the others, of which every text has some now and then, take their tail.
RULES = {
    "symbol_pm": ("upper", 80, 3, True),
    "dup_line_pm": ("upper", 99, 1, True),
    "repeat_pm": ("upper", 99, 1, True),
    "word_len": ("upper", 80, 6, False),
    "short_word": ("lower", 20, 6, False),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.transform(F.array(value), body).getItem(0)


def _repeated(words: Column) -> Column:
    """Words in five-word windows that occur twice or more. Windows are told apart by 64-bit hashes."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))

    def marked(s: Column) -> Column:
        twin = F.transform(s, lambda e, i: F.when((e["x"] == F.get(s, i - 1)["x"]) | (e["x"] == F.get(s, i + 1)["x"]), e["i"]))
        start = F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("sum"))
        step = lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(5), p - a["last"])).alias("sum"))
        return F.aggregate(F.sort_array(F.filter(twin, lambda p: p.isNotNull())), start, step, lambda a: a["sum"])

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, marked))

    return F.when(n < 6, F.lit(0).cast("long")).otherwise(let(hashes, counted))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base counts (COUNTS, long) and n_lines, the lines with a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    of_words = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), _repeated(ws).alias("n_repeat_words")))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), F.size(F.array_distinct(ls)).cast("long").alias("d")))
    out = docs.select("*", of_words.alias("__w"), of_lines.alias("__l"), text.alias("__t"))
    return out.select(
        *docs.columns,
        F.col("__w.n_words").alias("n_words"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.col("__l.n") - F.col("__l.d")).alias("n_dup_lines"),
        F.col("__w.n_repeat_words").alias("n_repeat_words"),
        F.col("__l.n").alias("n_lines"),
    )


def _metrics() -> dict[str, Column]:
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    whole = lambda a, b: F.floor(a / b).cast("long")
    length = whole(100 * F.col("word_chars"), n)
    beyond = lambda c: F.greatest(F.col(c) - F.floor(2 * F.sqrt(c)), F.lit(0))
    return {
        "symbol_pm": whole(1000 * beyond("n_symbols"), n),
        "dup_line_pm": whole(1000 * beyond("n_dup_lines"), lines),
        "repeat_pm": whole(1000 * beyond("n_repeat_words"), n),
        "word_len": length,
        "short_word": length,
    }


def bucket(value: Column) -> Column:
    """The value's bucket: its seven highest bits."""
    shift = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Mergeable sketches: keys, metric, bucket, n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in RULES]))
    return measured.select(*keys, each.alias("e")).groupBy(*keys, "e.metric", "e.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, total and limit of each group's own sketch."""
    part = W.partitionBy(*keys, "metric")
    up = part.orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = sketch.select(*keys, "metric", "bucket", F.sum("n").over(up).alias("upto"), F.sum("n").over(part).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket"))).alias(f"q{q}")
    out = run.groupBy(*keys, "metric").agg(F.first("total").alias("total"), *[at(q) for q in sorted({50, *(r[1] for r in RULES.values())})])
    limit = F.lit(None).cast("long")
    for m, (_, q, times, _) in RULES.items():
        limit = F.when(F.col("metric") == m, F.col("q50") + (times + 1) * (F.col(f"q{q}") - F.col("q50"))).otherwise(limit)
    return out.select(*keys, "metric", "total", F.greatest(limit, F.lit(0)).alias("limit"))


def averaged(own: Column, n: Column, other: Column, weight: int) -> Column:
    """The mean of a limit from n documents and of another that counts for weight documents."""
    return F.floor((n * own + weight * other) / (n + weight)).cast("long")


def limits(by_source: DataFrame, weight: int = MIN_DOCS) -> DataFrame:
    """From sketches by g_lang and g_source: one row per group, with the columns <metric>_limit."""
    by_lang = merged(by_source, ["g_lang"])
    own = thresholds(by_source, ["g_lang", "g_source"])
    lang = thresholds(by_lang, ["g_lang"]).select(F.col("g_lang").alias("l"), F.col("metric").alias("m"), F.col("total").alias("n"), F.col("limit").alias("l_limit"))
    every = thresholds(merged(by_lang, []).withColumn("one", F.lit(1)), ["one"]).select(F.col("metric").alias("a"), F.col("limit").alias("a_limit"))
    every = F.broadcast(every)  # a row for each of RULES at most
    shared = F.col("m").isin([m for m, r in RULES.items() if r[3]])
    lang = lang.join(every, F.col("m") == F.col("a"))
    lang = lang.select("l", "m", F.when(shared, averaged(F.col("l_limit"), F.col("n"), F.col("a_limit"), weight)).otherwise(F.col("l_limit")).alias("l_limit"))
    met = own.join(lang, F.col("g_lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m")))
    met = met.select("g_lang", "g_source", "metric", averaged(F.col("limit"), F.col("total"), F.col("l_limit"), weight).alias("limit"))
    return met.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("metric") == m, F.col("limit"))).alias(f"{m}_limit") for m in RULES])


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """docs without text, language and source, with the base counts, metrics, limits, base_failed, kept, g_lang and g_source.
    Columns of docs that are named like one of these, or begin with two underscores, are left out."""
    made = {text_col, lang_col, source_col, *COUNTS, *RULES, *(f"{m}_limit" for m in RULES), "n_lines", "base_failed", "kept", "g_lang", "g_source"}
    others = [f"`{c}`" for c in docs.columns if c not in made and not c.startswith("__")]
    base = docs.select(*others, F.col(text_col).alias("__text"), F.col(lang_col).alias("g_lang"), F.col(source_col).alias("g_source"))
    counted = with_counts(base, "__text").drop("__text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = saved(counted.withColumns({**_metrics(), "base_failed": failed}))
    by_source = saved(sketches(counted.filter(~F.col("base_failed")), ["g_lang", "g_source"]))
    table = limits(by_source, min_docs).withColumnsRenamed({"g_lang": "__lang", "g_source": "__source"})
    met = counted.join(table, F.col("g_lang").eqNullSafe(F.col("__lang")) & F.col("g_source").eqNullSafe(F.col("__source")), "left")
    good = ~F.col("base_failed")
    for m, (side, *_) in RULES.items():
        seen = bucket(F.col(m))  # as exact as the limit is
        ok = seen <= F.col(f"{m}_limit") if side == "upper" else seen >= F.col(f"{m}_limit")
        good = good & F.coalesce(ok, F.lit(True))
    return met.drop("__lang", "__source").withColumn("kept", good)


def passing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows that the rules keep, with their own columns, whatever those are called. Rows meet their verdict by id and the
    text's hash, as one id may have several texts; its language and source decide too, so of several verdicts for one pair each
    row needs a good one. Null and empty texts go; repeated rows stay or go together; an empty table stays empty."""
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))
    judged = quality_rules(docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")), min_docs=min_docs)
    good = judged.groupBy(F.col("i").alias("j"), F.col("h").alias("k")).agg(F.min("kept").alias("good")).filter("good")
    return row.join(good, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("k")), "left_semi").select("row.*")
