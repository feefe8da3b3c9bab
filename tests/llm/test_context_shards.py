"""The distributed context tree against exact recursion, at several depths."""

import collections
import math

import numpy as np
import pytest
from keyloom.llm.context_tree import score_texts

from tests.llm.test_operators import dicts, remainder


def recursive(train, texts, depth):
    n = collections.defaultdict(lambda: [0, 0])
    walk = lambda t: [((raw := bytes([255]) * depth + t + bytes([255]))[k - depth : k], raw[k]) for k in range(depth, len(t) + depth + 1)]
    for t in train:
        for c, b in walk(t):
            for level in range(8):
                for d in range(depth + 1):
                    n[c[depth - d :], level, b >> (8 - level)][b >> (7 - level) & 1] += 1
    kt = lambda x: math.lgamma(x[0] + 0.5) + math.lgamma(x[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(x) + 1)
    below, weight = collections.defaultdict(float), {}
    for node in sorted(n, key=lambda x: -len(x[0])):
        c, level, p = node
        weight[node] = kt(n[node]) if len(c) == depth else np.logaddexp(kt(n[node]), below[node]) - math.log(2)
        below[c[1:], level, p] += weight[node] if c else 0
    out = []
    for t in texts:
        sum_ = 0.0
        for c, b in walk(t):
            for level in range(8):
                bit, p = b >> (7 - level) & 1, None
                for d in range(depth, -1, -1):
                    node = (c[depth - d :], level, b >> (8 - level))
                    x = n.get(node, [0, 0])
                    here = (x[bit] + 0.5) / (sum(x) + 1)
                    share = math.exp(kt(x) - weight[node] - math.log(2)) if node in n else 0.5
                    p = here if p is None else share * here + (1 - share) * p
                sum_ += math.log10(p)
        out.append(sum_)
    return out


@pytest.mark.parametrize("depth", [2, 4, 6])
def test_tree(spark, depth):
    texts = ["abracadabra abracadabra", "banana band banana", "", "abc", "zebra é", "abracadabra band", None, "banana bandana"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["score"] for r in dicts(score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), depth=depth))}
    raw = [(t or "").encode() for t in texts]
    expected = recursive([t for i, t in enumerate(raw) if remainder(i, 7) != 2], raw, depth)
    assert any(remainder(i, 7) == 2 for i in range(len(raw)))
    assert np.allclose([got[i] for i in range(len(raw))], expected, rtol=1e-5)


def test_contexts_beyond_two_bytes_count(spark):
    """What follows is told by the byte six before alone."""
    texts = [f"{a}-----{a}" for a in "qwert"] * 30
    found = dicts(score_texts(spark.createDataFrame([(i, t) for i, t in enumerate(texts + ["q-----w"])], "doc_id long, text string")))
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[0] > score[len(texts)] + 1
