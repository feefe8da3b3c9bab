"""The near-copy join when sets of one signature lie in one batch, in many, or in both."""

import random

import pytest

from keyloom.llm.jaccard_trie import jaccard_components, without_near_copies

from .test_operators import brute_components, dicts, multiset


def template(seed=4):
    """Variants of a few templates, exact copies among them, and rows of one id with several texts."""
    r = random.Random(seed)
    rows, i = [], 0
    for t in range(4):
        words = [f"t{t}w{k}" for k in range(r.choice([12, 40, 90]))]
        for _ in range(40):
            some = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                some[r.randrange(len(some))] = f"x{r.randrange(6)}"
            rows.append((i, " ".join(some)))
            i += 1
    rows += [(None, rows[3][1]), (None, rows[3][1]), (i, None), (i + 1, " \n"), (i + 2, "one two")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("gathered", [1, 60, 10**6])
@pytest.mark.parametrize("block", [250, 3])
def test_batches(spark, monkeypatch, gathered, block):
    monkeypatch.setattr("keyloom.llm.jaccard_trie.GATHERED", gathered)
    rows = template()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert multiset(dicts(jaccard_components(df, block=block))) == multiset(brute_components(rows))


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr("keyloom.llm.jaccard_trie.SHARE", 50)
    rows = template(5)
    assert multiset(dicts(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")))) == multiset(brute_components(rows))


def test_one_id_with_several_texts(spark):
    """Rows follow their own texts: a text stays although another text of its id goes."""
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (2, other)], "doc_id long, text string")
    assert sorted(r["text"] for r in without_near_copies(df, per=80).collect()) == sorted([text, other])


@pytest.mark.parametrize("per", [80, 90])
def test_linked_sets_share_a_signature(per):
    import numpy as np

    from keyloom.llm.jaccard_trie import Measure

    m, rng = Measure(per), np.random.default_rng(per)
    for n in (4, 5, 6, 8, 11, 15, 20, 33, 60, 100, 250, 700):
        for _ in range(150 if n < 200 else 30):
            s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            gone, new = rng.integers(0, n // 4 + 1), rng.integers(0, n // 4 + 1)
            t = np.unique(np.r_[rng.permutation(s)[gone:], rng.integers(0, 1 << 63, new).astype(np.uint64)])
            if m.linked(len(s), len(t), len(np.intersect1d(s, t))) and not np.array_equal(s, t):
                assert set(m.signatures(s).tolist()) & set(m.signatures(t).tolist()), (n, gone, new)
