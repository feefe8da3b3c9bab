"""The pipeline against the operators' plain meanings, stage by stage."""

import collections

from keyloom.llm.queries import ORACLE, QUERIES

from tests.conftest import SF
from tests.test_queries import compare, duck  # noqa: F401


def test_stages(spark, tmp_path, docs, rows):
    import corpus_pipeline
    from tests.llm.test_operators import WHITE, brute_components

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram jaccard join", "source mixing", "sentencepiece"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, d, str(tmp_path))
        d.write.parquet(str(tmp_path / f"out{k}"))
        d = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert k == 4 or d.columns == docs.columns
        kept.append([tuple(r) for r in d.collect()])
    quality, exact, near, mixed, pieces = kept
    assert 0 < len(quality) < len(rows) and not any("### " in (r[1] or "") for r in quality)
    least = {}
    for r in quality:
        t = WHITE.sub(" ", r[1] or "")
        least[t] = min(least.get(t, 1 << 63), (1 << 63) - 1 if r[0] is None else r[0])
    assert len(exact) == len(least)
    assert sorted(r[0] for r in near) == sorted({r["component_id"] for r in brute_components(exact)})
    assert set(mixed) <= set(near) and max(collections.Counter(mixed).values()) <= 3
    assert collections.Counter(r[0] for r in pieces) == collections.Counter(r[0] for r in mixed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_queries_against_sql(spark, duck):  # noqa: F811
    for name, sql in ORACLE.items():
        assert compare(spark, duck, QUERIES[name], sql) == 200


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert SF
