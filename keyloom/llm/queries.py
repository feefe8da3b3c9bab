"""The queries of the training-data operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_cnn import classify_quality
from .common import documents
from .context_tree import score_texts
from .exact_dedup import exact_dedup
from .jaccard_trie import jaccard_components
from .lang_id import detect_language
from .mixing import SLOPES, mix_sources
from .quality_rules import MIN_DOCS, RULES, quality_rules
from .sp_nbest import encode_nbest
from .suffix_dedup import remove_repeats
from .token_counts import token_counts


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.floor(F.col("first_position") * 1_000_000_000).cast("long")  # in parts of a thousand million of the training time
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", F.size("positions").cast("long").alias("n_positions"), place.alias("first_position"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_language(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op6_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_nbest(documents(spark, sf_dir), with_ids=False)
    return found.select("doc_id", "n_bytes", F.get("n_tokens", F.lit(0)).alias("n_pieces"), "n_tokens", "scores", "sha256", "round_trip")


def op7_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op10_jaccard_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_token_counts, op3_mix_sources, op4_language_id, op5_exact_dedup, op6_nbest_pieces, op7_quality_cnn, op8_quality_rules, op9_context_tree, op10_jaccard_trie)}

ORACLE: dict[str, str] = {}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op5_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""

ORACLE["op3_mix_sources"] = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5(concat(coalesce(doc_id::VARCHAR, ''), ':', md5(coalesce(text, '')))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, 3 * source_size AS cap, coalesce(sum(3 * source_size) OVER below, 0) AS low, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS high, sum(source_size) OVER () AS total
  FROM w WINDOW below AS (ORDER BY 3 * source_size * (10 // weight), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - low)::DOUBLE / high::DOUBLE AS level FROM o),
f AS (SELECT arg_min(level, low) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, rank, CASE WHEN f.level IS NULL OR f.level * weight > cap THEN cap::DOUBLE ELSE f.level * weight END AS target FROM l LEFT JOIN f ON true),
c AS (SELECT source, source_size, target, round(target)::BIGINT AS total, CASE rank % 3 WHEN 0 THEN {SLOPES[0]}::DOUBLE WHEN 1 THEN {SLOPES[1]}::DOUBLE ELSE {SLOPES[2]}::DOUBLE END AS slope FROM t),
p AS (SELECT d.doc_id, size, source_size, target, total, slope, round(total * ((1 - slope) * 1.0::DOUBLE + slope * 1.0::DOUBLE * 1.0::DOUBLE))::BIGINT AS words,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE words // source_size END AS epochs FROM p),
x AS (SELECT *, least(greatest(words - epochs * source_size - line, 0), size) AS part, least(line::DOUBLE / greatest(total, 1)::DOUBLE, 1.0::DOUBLE) AS demand FROM e),
n AS (SELECT *, CASE WHEN size > 0 THEN epochs + (part > 0)::INT ELSE 0 END::BIGINT AS n_positions,
  CASE WHEN slope = 0 THEN demand ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * demand, 0.0::DOUBLE)) - (1 - slope)) / (2 * slope) END AS moment FROM x)
SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken, n_positions, CASE WHEN n_positions > 0 THEN floor(moment * 1000000000)::BIGINT END AS first_position FROM n"""

ORACLE["op10_jaccard_trie"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i+2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id"""


def _rules_sql() -> str:
    value = lambda m: "word_len" if m == "short_word" else m
    held = lambda v: f"(({v} >> greatest(length(bin({v})) - 7, 0)) << greatest(length(bin({v})) - 7, 0))"
    each = ", ".join(f"{{'metric': '{m}', 'v': {value(m)}}}" for m in RULES)
    limit = " ".join(f"WHEN '{m}' THEN q50 + {times + 1} * (q{q} - q50)" for m, (_, q, times, _) in RULES.items())
    tests = " AND ".join(f"coalesce({held(value(m))} {'<=' if side == 'upper' else '>='} max(v) FILTER (metric = '{m}'), true)" for m, (side, *_) in RULES.items())
    at = ", ".join(f"min(bucket) FILTER (upto * 100 >= total * {q}) AS q{q}" for q in sorted({50, *(r[1] for r in RULES.values())}))
    beyond = lambda c, n: f"CAST(floor(1000 * greatest({c} - floor(2 * sqrt({c})), 0) / greatest({n}, 1)) AS BIGINT)"
    shared = ", ".join(f"'{m}'" for m, r in RULES.items() if r[3])
    mean = lambda own, n, other: f"CAST(floor(({n} * {own} + {MIN_DOCS} * {other}) / ({n} + {MIN_DOCS})) AS BIGINT)"

    def level(name: str, source: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""{name}_r AS (SELECT {by}metric, bucket, sum(sum(n)) OVER (PARTITION BY {by}metric ORDER BY bucket) AS upto, sum(sum(n)) OVER (PARTITION BY {by}metric) AS total FROM {source} GROUP BY {by}metric, bucket),
{name}_q AS (SELECT {by}metric, any_value(total) AS total, {at} FROM {name}_r GROUP BY {by}metric),
{name} AS (SELECT {by}metric, total, greatest(CASE metric {limit} END, 0) AS v FROM {name}_q)"""

    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, row_number() OVER () AS u FROM documents),
g AS (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS c FROM (SELECT u, unnest(range(1, len(w) - 3)) AS i, w[i:i+4] AS g FROM d)),
r AS (SELECT u, count(DISTINCT p) AS n_repeat_words FROM (SELECT u, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) GROUP BY u),
b AS (SELECT u, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines FROM d LEFT JOIN r USING (u)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {beyond("n_symbols", "n_words")} AS symbol_pm, {beyond("n_dup_lines", "n_lines")} AS dup_line_pm,
  {beyond("n_repeat_words", "n_words")} AS repeat_pm, 100 * word_chars // greatest(n_words, 1) AS word_len FROM b),
k AS (SELECT lang, source, x.metric AS metric, {held("x.v")} AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest([{each}]) AS x FROM m WHERE NOT base_failed) GROUP BY ALL),
{level("by_source", "k", "lang, source")},
{level("by_lang", "k", "lang")},
{level("by_all", "k", "")},
p AS (SELECT l.lang, l.metric, CASE WHEN l.metric IN ({shared}) THEN {mean("l.v", "l.total", "a.v")} ELSE l.v END AS v FROM by_lang l JOIN by_all a USING (metric)),
v AS (SELECT s.lang, s.source, s.metric, {mean("s.v", "s.total", "p.v")} AS v FROM by_source s JOIN p ON s.lang IS NOT DISTINCT FROM p.lang AND s.metric = p.metric)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {tests} AS kept
FROM m LEFT JOIN v ON m.lang IS NOT DISTINCT FROM v.lang AND m.source IS NOT DISTINCT FROM v.source
GROUP BY u, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, symbol_pm, dup_line_pm, repeat_pm, word_len"""


ORACLE["op8_quality_rules"] = _rules_sql()
