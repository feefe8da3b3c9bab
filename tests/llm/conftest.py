import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def corpus(seed=3, n=120):
    """Invented texts with exact and near copies, shared passages, junk, nulls, empties, repeated rows and one very long text."""
    r = random.Random(seed)
    vocabulary = {x: ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(300)] for x, syllables in (("en", ["the", "ing", "er", "th", "on"]), ("fr", ["eau", "ment", "é", "le", "ai"]))}
    prose = lambda lang, k: " ".join(r.choices(vocabulary[lang], k=k))
    passage = prose("en", 60)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "en", "fr"])
        text = prose(lang, r.choice([3, 20, 60, 120])) + r.choice(["", "\n", ".\n"]) + prose(lang, 20)
        if i % 9 == 0 and lang == "en":
            text = text[:50] + " " + passage + " " + text[50:]
        if i % 7 == 3:
            text, lang = rows[-1][1] or "", rows[-1][2]
        if i % 11 == 5 and rows[-2][1]:
            words, lang = rows[-2][1].split(" "), rows[-2][2]
            words[len(words) // 2] = "changed"
            text = "  ".join([" ".join(words[:5]), " ".join(words[5:])])
        if i % 29 == 1:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, lang, f"s{i % 4}" if i % 3 else "s0", 1))
    rows += [(1000, None, "en", None, None), (1001, "", None, "s1", 0), (1002, " \t\n ", "fr", "s1", 3), (None, "the ing er\u0000 th " * 9, "en", "s2", 1), (1003, "zz", "en", None, 2)]
    rows += [rows[4], rows[4], (1004, prose("en", 6000) + "\n" + "x" * 3000 + "\n" + "é 中 😀 ▁ ", None, "s0", 1), (1005, "a b\n" * 40, "en", "s2", 1), (1006, "THE Ing er.", "en", "s3", 1)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
