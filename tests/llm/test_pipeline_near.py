"""The pipeline's stage of near copies: shingles of five words, similarity of 0.8 or more."""

import random

import corpus_pipeline


def brute(rows, width=5, per=80):
    """Smallest ids of the components; no text is empty."""
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for w in words]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= per * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted(least.values())


def test_near_copies_of_five_words(spark):
    r, rows = random.Random(5), []
    for n in (20, 48, 49, 50, 58, 59, 100, 100, 300):
        words = [f"w{r.random()}" for _ in range(n)]
        for edits in range(0, 8):
            some = list(words)
            for k in range(edits):
                some[(2 * k + 1) * n // 16] = f"x{r.random()}"
            rows.append((len(rows), " ".join(some)))
    # two words of a hundred replaced far apart: 86 of 106 shingles of five words are shared, and of three words 92 of 104
    base = [f"v{k}" for k in range(100)]
    rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join("new" + w if k in (30, 70) else w for k, w in enumerate(base)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(x["doc_id"] for x in corpus_pipeline.near_stage(spark, df, "").collect())
    assert kept == brute(rows) and kept != brute(rows, 3, 90)
    assert len(rows) - 2 in kept and len(rows) - 1 not in kept
