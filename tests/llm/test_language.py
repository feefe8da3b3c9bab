"""Word-first backoff against a plain computation, and the odd cases of the sample."""

import collections
import math
import unicodedata

import pytest

from keyloom.llm.lang_id import LONGEST, MIN_COUNT, detect_language, fit, words_of

from .test_operators import dicts, remainder


def plain_words(text):
    out, now = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and now):
            now += c
        else:
            out += [now] * bool(now)
            now = ""
    return out


def brute(rows, texts):
    """Language and posterior of each text, from the rows' counts held in dictionaries."""
    counts, total = collections.defaultdict(collections.Counter), collections.Counter()
    for i, text, lang in rows:
        if remainder(i, 4) != 2 and text is not None and lang is not None:
            for w in plain_words(text):
                padded = f"^{w}$"
                for g in [(0, w), *((k, padded[a : a + k]) for k in range(1, LONGEST + 1) for a in range(len(padded) - k + 1) if padded[a : a + k] not in "^$")]:
                    counts[g][lang] += 1
                    total[g[0], lang] += 1
    langs = sorted({x for _, x in total})
    known = lambda g: sum(counts[g].values()) >= MIN_COUNT if g in counts else False

    def value(g):
        logs = [math.log((counts[g][x] + 0.1) / (total[g[0], x] + 1)) for x in langs]
        return [v - sum(logs) / len(logs) for v in logs]

    def of_word(w):
        if known((0, w)):
            return value((0, w))
        padded = f"^{w}$"
        for k in range(LONGEST, 0, -1):
            hits = [value((k, padded[a : a + k])) for a in range(len(padded) - k + 1) if known((k, padded[a : a + k]))]
            if hits:
                return [sum(h[i] for h in hits) / len(hits) for i in range(len(langs))]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        words = plain_words(t or "")
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        each = [of_word(w) for w in words]
        sums = [sum(e[i] for e in each) for i in range(len(langs))]
        p = [math.exp((s - max(sums)) * min(1, 20 / len(words))) for s in sums]
        out.append((langs[sums.index(max(sums))], max(p) / sum(p)))
    return out


def test_backoff_against_a_plain_computation(spark):
    rows = [(0, "the cat sat on the mat", "en"), (1, "the dog and the catalogue", "en"), (3, "le chat et le chien", "fr"), (4, "la maison et le chat noir", "fr"), (5, "der Hund und die Katze", "de"), (6, "die Katze", "de")]
    rows += [(7, "हिन्दी में लिखा हिन्दी", "hi"), (8, "यह हिन्दी है", "hi"), (9, None, "en"), (10, "nothing", None)]
    odd = ["the cats", "chats noirs", "Hunde katzen", "हिन्दी", "qqq", "½ ① ②", "", None, "1234 !?", "x́ the", "catalog" * 30]
    rows += [(100 + k, t, None) for k, t in enumerate(odd)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in dicts(detect_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")))}
    for (i, *_), (lang, score) in zip(rows, brute(rows, [t for _, t, _ in rows]), strict=True):
        assert got[i][0] == lang or abs(score - 0.25) < 1e-6, (i, got[i], lang)  # even scores may go either way
        assert math.isclose(got[i][1], score, abs_tol=1e-3), (i, got[i], score)


@pytest.mark.parametrize("text", ["½ ① ②", "² ³", "Ⅷ", "१२३", "́", "!? 12"])
def test_no_letter_is_undetermined(spark, text):
    rows = [(1, "some text", "en"), (3, "ein Text", "de"), (4, text, "en")]
    assert [(r["lang_pred"], r["score"]) for r in dicts(detect_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) if r["doc_id"] == 4] == [("und", 0.0)]


def test_words_keep_their_marks():
    assert words_of().findall("हिन्दी में, naïve x́y ½ภาษาไทย_a1b") == ["हिन्दी", "में", "naïve", "x́y", "ภาษาไทย", "a", "b"]
    sample = "".join(chr(c) for c in range(0x20, 0x3000)) + "".join(chr(c) for c in range(0x10000, 0x10400))
    assert words_of().findall(sample.lower()) == plain_words(sample)


def test_no_language_is_lost_to_null_or_repeated_ids(spark):
    en = [(None, f"the cat number {k} sat on the mat", "en") for k in range(7000)]
    one = next(i for i in range(9) if remainder(i, 4) != 2)
    twice = [(one, "el gato negro duerme en la casa", "es")] * 7000
    fr = [(10 + k, "le chat dort sur le tapis", "fr") for k in range(49)]
    got = collections.Counter((r["doc_id"] if r["doc_id"] in (None, one) else "fr", r["lang_pred"]) for r in dicts(detect_language(spark.createDataFrame(en + twice + fr, "doc_id long, text string, lang string"))))
    assert got == {(None, "en"): 7000, (one, "es"): 7000, ("fr", "fr"): 49}


def test_the_model_is_bounded(spark):
    """A bound on cells keeps the most frequent words; the others fall back to n-grams."""
    rows = [(k, f"the cat sat here{k} " + "z" * 500, "en") for k in range(40)] + [(k + 40, f"le chat dort la{k}", "fr") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit(df, "doc_id", "text", "lang", cells=40)
    assert len(model.words) <= 10 and len(model.grams) <= 10 and all(len(w) <= 40 for w in model.words)
    assert model.predict("the cat")[0] == "en" and model.predict("le chat")[0] == "fr"
