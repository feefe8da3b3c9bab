"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words by weight; a target
stops at MAX_REPEAT times its source's words, and the excess is shared anew. That fixed point has a closed form: with
sources in the order of cap / weight, the water level is (words - caps below) / (weights above), found by running sums
over the table of sources, so no loop runs. The sums are taken within ranges of sources first, so that sources may be many.

Curriculum: each source has a weight schedule over training time t in 0..1, here linear from START to END times its
mean (FRONT, FLAT, BACK by turns). Its integral, times the target, is the source's cumulative demand D(t). Documents
line up by hash; the one whose words begin at c of the line trains at the t where D(t) = c, the root of a quadratic, and
each further epoch at D(t) = c + epoch * source size. What is taken are the words that the line has below D(until), the demand
integrated to the end of training, so a schedule decides how much of a source an earlier end has taken. Documents are then
range-sorted by position.

The running sum over a source is dealt in 4,096 lanes, ranges of the hash: lane totals are summed first, then rows within
a lane, so a source with a third of all rows spreads over thousands of tasks. Repeated rows (one id, source and text) are counted
before they are dealt, and stand in the line one after the other. No row is sampled or dropped before the sums.

Defined results: null or empty text has size 0 and takes 0; a null source is a source, the last; a null id hashes as
an empty one, with its text; repeated rows each take their share; an empty table gives an empty result; other columns are
ignored by mix_sources and kept by mixed_rows, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, saved

#: A lane is named by the first digits of a hash in hexadecimal.
WEIGHTS, MAX_REPEAT, LANE_DIGITS = (5, 2, 1), 3, 3
#: Slope of the schedule by rank: weight(t) = 1 + slope * (2 t - 1).
SLOPES = (-0.5, 0.0, 0.5)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of all rows before each in that order. Rows are dealt by range; a range's total is one row, so that
    only as many rows as there are ranges meet in one task."""
    dealt = df.select("*", *[c.alias(f"__{n}") for n, c in sums.items()]).repartitionByRange(*order)
    dealt = saved(dealt.withColumn("__range", F.spark_partition_id()))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    start = dealt.groupBy("__range").agg(*[F.sum(f"__{n}").alias(n) for n in sums])
    start = start.select("__range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__0{n}") for n in sums])
    inside = W.partitionBy("__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)).alias(f"__1{n}") for n in sums])
    return out.join(F.broadcast(start), "__range").select(*df.columns, *[(F.col(f"__0{n}") + F.col(f"__1{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame) -> DataFrame:
    """From (src, source_size): rank, weight, target. One row per source."""
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    out = running(sizes, [F.col("src").asc_nulls_last()], {"rank": F.lit(1).cast("long")})
    out = out.withColumn("weight", weight).withColumn("cap", MAX_REPEAT * F.col("source_size"))
    # cap / weight, compared exactly as integers: weights divide their product
    product = 1
    for w in WEIGHTS:
        product *= w
    out = out.withColumn("full", F.col("cap") * F.floor(F.lit(product) / F.col("weight")))
    out = running(out, [F.col("full"), F.col("rank")], {"low": F.col("cap"), "under": F.col("weight").cast("long")})
    whole = out.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights"))
    out = out.crossJoin(F.broadcast(whole))  # one row
    level = (F.col("all") - F.col("low")).cast("double") / (F.col("weights") - F.col("under"))
    out = saved(out.withColumn("level", level))
    # the first source in that order that doesn't reach its cap sets the level for itself and all after it
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    found = out.agg(F.min(F.when(fits, F.struct("low", "level"))).alias("found")).select(F.col("found.level").alias("found"))
    out = out.crossJoin(F.broadcast(found))  # one row
    share = F.col("found") * F.col("weight")
    return out.select("src", "rank", "weight", "source_size", F.when(F.col("found").isNull() | (share > F.col("cap")), F.col("cap").cast("double")).otherwise(share).alias("target"))


def integral(t: Column, slope: Column) -> Column:
    """The share of its target that a source has demanded by the moment t: the integral of its schedule."""
    return (1 - slope) * t + slope * t * t


def moment(demand: Column, slope: Column) -> Column:
    """The t in 0..1 with (1 - slope) t + slope t^2 = demand: the inverse of the integrated schedule."""
    b = 1 - slope
    return F.when(slope == 0, demand).otherwise((F.sqrt(F.greatest(b * b + 4 * slope * demand, F.lit(0.0))) - b) / (2 * slope))


def line_hash(id_col: str, text_col: str) -> Column:
    """Where a document stands in its source's line: a hash of its id and text."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", until: float = 1.0, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, positions (one for each epoch, of those it
    takes words in), first_position, part (words taken in the last epoch, if not all) and h, sorted by first_position. taken is what
    the curriculum takes up to the moment `until`; at 1 each source has given its target. slopes: of the schedules, by rank."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("src"), size.alias("size"), line_hash(id_col, text_col).alias("h"))
    rows = rows.withColumn("lane", F.substring("h", 1, LANE_DIGITS))
    rows = saved(rows.groupBy("doc_id", "src", "size", "h", "lane").agg(F.count("*").alias("copies")))
    lanes = rows.groupBy("src", "lane").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    plan = saved(targets(lanes.groupBy("src").agg(F.sum("words").alias("source_size"))))
    before = W.partitionBy("src").orderBy("lane").rowsBetween(W.unboundedPreceding, -1)
    starts = lanes.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.select(F.col("src").alias("s"), F.col("lane").alias("l"), "start")
    plan = plan.withColumnRenamed("src", "p")
    starts = starts.join(plan, F.col("s").eqNullSafe(F.col("p")))
    inside = W.partitionBy("src", "lane").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    met = rows.join(starts, F.col("src").eqNullSafe(F.col("s")) & (F.col("lane") == F.col("l")))
    met = met.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    slope = F.element_at(F.array(*[F.lit(float(x)) for x in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    at = F.col("start") + F.col("inside") + F.col("copy") * F.col("size")
    met = met.select("doc_id", "src", "size", "source_size", "target", "h", at.alias("at"), F.round("target").cast("long").alias("total"), slope.alias("slope"))
    # the demand at the end: how far the line, epoch after epoch, is taken
    met = met.withColumn("end", F.round(F.col("total") * integral(F.lit(float(until)), F.col("slope"))).cast("long"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("end") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    met = met.withColumn("epochs", epochs)
    rest = F.col("end") - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("at"), F.lit(0)), F.col("size"))
    met = met.withColumns({"part": part, "taken": (F.col("epochs") * F.col("size") + part).cast("long")})
    last = F.col("epochs") - F.when(F.col("part") > 0, 0).otherwise(1)
    where = F.transform(F.when((F.col("size") > 0) & (last >= 0), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>")),
                        lambda e: moment(F.least((e * F.col("source_size") + F.col("at")) / F.greatest("total", F.lit(1)), F.lit(1.0)), F.col("slope")))
    met = met.withColumn("positions", where)
    return met.select("doc_id", "size", "source_size", "target", "taken", F.col("src").alias("source"), "positions", F.get("positions", F.lit(0)).alias("first_position"), "part", "h").orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs in training order, each row as often as it is taken; the row at which a target ends counts whole if half of it or
    more is taken. Texts stay whole. Rows with one id and text are taken alike, by the first of them."""
    mix = mix_sources(docs, id_col, text_col, source_col)
    half = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")) & (2 * F.col("part") < F.col("size")), 1).otherwise(0)
    times = F.slice("positions", 1, F.greatest(F.size("positions") - half, F.lit(0)))
    mix = mix.withColumn("at", times).groupBy(F.col("doc_id").alias("j"), F.col("h").alias("k")).agg(F.min_by("at", "first_position").alias("at"))
    mix = mix.select("j", "k", F.explode("at").alias("at"))
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col(id_col).alias("i"), line_hash(id_col, text_col).alias("h"))
    joined = row.join(mix, F.col("i").eqNullSafe(F.col("j")) & (F.col("h") == F.col("k")))
    return joined.orderBy("at", "i").select("row.*")
