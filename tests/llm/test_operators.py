"""Each operator against a plain computation over a small table with every odd case, and over an empty one."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm.byte_cnn import classify_quality
from keyloom.llm.context_tree import Tree, count_triples, log_gamma, score_texts
from keyloom.llm.exact_dedup import MergeIndex, exact_dedup, without_copies
from keyloom.llm.jaccard_trie import Measure, jaccard_components, shingle_set, without_near_copies
from keyloom.llm.lang_id import detect_language
from keyloom.llm.mixing import mix_sources, mixed_rows, moment
from keyloom.llm.pieces import default_path
from keyloom.llm.quality_rules import bucket, passing, quality_rules
from keyloom.llm.sp_nbest import Lattice, decode_ids, encode_nbest
from keyloom.llm.suffix_dedup import repeated, remove_repeats, two_stage_sort
from keyloom.llm.token_counts import Merger, token_counts

WORD, WHITE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]+")
LAST = (1 << 63) - 1
number = lambda i: LAST if i is None else i
key = lambda r: tuple(sorted((k, str(v)) for k, v in r.items()))


def multiset(rows):
    return collections.Counter(map(key, rows))


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def remainder(i, n):
    return 0 if i is None else zlib.crc32(str(i).encode()) % n


def low(text):
    return (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))


# ---- 1: repeated strings


def brute_repeats(rows, n=50):
    first = {}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - n + 1):
            w = raw[p : p + n]
            first[w] = min(first.get(w, LAST + 1), number(i))
    out = []
    for i, text, *_ in rows:
        raw = (text or "").encode()
        mark = bytearray(len(raw))
        for p in range(len(raw) - n + 1):
            if first[raw[p : p + n]] < number(i):
                mark[p : p + n] = b"\1" * n
        kept = bytes(x for x, m in zip(raw, mark, strict=True) if not m)
        out.append({"doc_id": i, "n_bytes": len(raw), "n_removed": sum(mark), "n_spans": len([x for x in bytes(mark).split(b"\0") if x]), "kept_sha256": hashlib.sha256(kept).hexdigest()})
    return out


def digest(df):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))
    return df.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def test_suffix_dedup(docs, rows):
    assert multiset(dicts(digest(remove_repeats(docs)))) == multiset(brute_repeats(rows))


def test_suffix_dedup_small_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr("keyloom.llm.suffix_dedup.BUCKET", 2000)
    assert multiset(dicts(digest(remove_repeats(docs, length=20)))) == multiset(brute_repeats(rows, 20))


def test_suffix_dedup_crowded_buckets(docs, rows, monkeypatch):
    """All buckets crowded: every window is dealt by its own hash."""
    monkeypatch.setattr("keyloom.llm.suffix_dedup.CROWDED", 0)
    assert multiset(dicts(digest(remove_repeats(docs)))) == multiset(brute_repeats(rows))


def test_suffix_dedup_one_id_with_several_texts(spark):
    a, b = "x" * 30 + "abc" * 20, "abc" * 20 + "tail"
    rows = [(5, a), (5, b), (7, b), (3, "none"), (5, a)]
    assert multiset(dicts(digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))) == multiset(brute_repeats(rows))


@pytest.mark.parametrize("several", [0, 500_000])
def test_suffix_dedup_ids_with_many_texts(spark, monkeypatch, several):
    """A third of the rows has a null id and a text each; ids with several texts are broadcast, or meet the texts in a join."""
    monkeypatch.setattr("keyloom.llm.suffix_dedup.SEVERAL", several)
    r = random.Random(6)
    shared = " ".join(f"s{r.random()}" for _ in range(8))
    texts = [" ".join(f"w{r.random()}" for _ in range(12)) + r.choice(["", f" {shared}"]) for _ in range(120)]
    rows = [(None if k % 3 == 0 else k // 4, t) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (7, rows[3][1]), (None, rows[1][1]), (None, None), (None, "")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert multiset(dicts(digest(remove_repeats(df)))) == multiset(brute_repeats(rows))


@pytest.mark.parametrize("text", [b"banana", b"mississippi", b"aaaaaaaaaa", b"abcabcabcabc", bytes(range(255, 0, -1)), b"a", b"ba" * 200 + b"a" * 50])
def test_two_stage_sort(text):
    order, _ = two_stage_sort(np.frombuffer(text, np.uint8), 50)
    assert sorted(order.tolist()) == list(range(len(text)))
    cut = [text[i : i + 50] for i in order.tolist()]
    assert cut == sorted(cut)


def test_repeated_random():
    rng = np.random.default_rng(1)
    for _ in range(30):
        parts = [rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8) for _ in range(12)]
        owner = rng.integers(0, 6, 12)
        seg, a, z = repeated(np.concatenate(parts), np.array([len(p) for p in parts]), owner, 6)
        got = {(s, x) for s, lo, hi in zip(seg.tolist(), a.tolist(), z.tolist(), strict=True) for x in range(lo, hi - 5)}
        first = collections.defaultdict(lambda: 99)
        for p, o in zip(parts, owner.tolist(), strict=True):
            for x in range(len(p) - 5):
                first[p[x : x + 6].tobytes()] = min(first[p[x : x + 6].tobytes()], o)
        expected = {(k, x) for k, p in enumerate(parts) for x in range(len(p) - 5) if first[p[x : x + 6].tobytes()] < owner[k]}
        assert got >= expected and all(len(parts[s]) < 6 or (s, x) in expected for s, x in got)


# ---- 2: token counts


def test_token_counts(docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_path())
    expected = [{"doc_id": i, "n_bytes": len((t or "").encode()), "n_tokens": (n := len(model.encode(t or ""))), "over_limit": n > 4096} for i, t, *_ in rows]
    assert multiset(dicts(token_counts(docs))) == multiset(expected)
    assert any(e["over_limit"] for e in expected)


def test_merging_odd_texts():
    import random

    import sentencepiece

    model, m, r = sentencepiece.SentencePieceProcessor(model_file=default_path()), Merger(default_path()), random.Random(2)
    texts = ["", " ", "  ", "   a  b ", "a\tb\n\nc", "▁x ▁▁", "中文　字 カナ", "<s> </s> <unk>", " " * 777, "a" * 3000, "ab" * 1500 + " " * 50, "\u0000é", "😀😀"]
    texts += ["".join(r.choices("aeionrst ▁é\n中", k=r.randint(1, 60))) for _ in range(500)]
    assert m.count(texts) == [len(x) for x in model.encode(texts)]


# ---- 3: mixing


def test_mixing(docs, rows):
    got = dicts(mix_sources(docs))
    sizes = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    source = collections.Counter()
    for (_, _, _, s, _), n in zip(rows, sizes, strict=True):
        source[s] += n
    names = sorted((s for s in source if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), sum(sizes), {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * source[s]]
        for s in over or free:
            target[s] = 3.0 * source[s] if over else level * weight[s]
        if not over:
            break
        free -= set(over)
        left -= sum(3 * source[s] for s in over)
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], n) for r, n in zip(rows, sizes, strict=True))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == source[r["source"]] and math.isclose(r["target"], target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["positions"] == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    places = [r["first_position"] for r in got if r["first_position"] is not None]
    assert places == sorted(places) and multiset(got) == multiset(dicts(mix_sources(docs.repartition(5))))


def test_schedule(spark):
    for slope in (-0.5, 0.0, 0.5):
        df = spark.range(11).select((F.col("id") / 10).alias("t"))
        demand = (1 - slope) * F.col("t") + slope * F.col("t") * F.col("t")
        assert all(math.isclose(r[0], r[1], abs_tol=1e-9) for r in df.select("t", moment(demand, F.lit(slope))).collect())


def test_mixed_rows(docs):
    out = mixed_rows(docs)
    assert out.columns == docs.columns and max(r["count"] for r in out.groupBy("doc_id", "text").count().collect()) <= 9


# ---- 4: language


def test_language(docs, rows):
    got = dicts(detect_language(docs))
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    lang = {i: x for i, t, x, *_ in rows if t and len(t) > 50}
    assert all(r["held_out"] == (remainder(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and lang.get(r["doc_id"])]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1000, 1001, 1002))
    assert {r["lang_pred"] for r in dicts(detect_language(docs.withColumn("lang", F.lit(None).cast("string"))))} == {"und"}


# ---- 5: exact dedup


def test_exact_dedup(docs, rows):
    norm = [WHITE.sub(" ", t or "") for _, t, *_ in rows]
    least, count = {}, collections.Counter(norm)
    for (i, *_), t in zip(rows, norm, strict=True):
        least[t] = min(least.get(t, LAST), number(i))
    got = dicts(exact_dedup(docs))
    show = lambda i: None if i == LAST else i
    expected = [{"doc_id": r[0], "keep_id": show(least[t]), "group_size": count[t], "text_sha256": hashlib.sha256(t.encode()).hexdigest()} for r, t in zip(rows, norm, strict=True)]
    assert multiset({k: v for k, v in r.items() if k != "kept"} for r in got) == multiset(expected)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(count) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = dicts(without_copies(docs))
    assert len(left) == len(count) and {WHITE.sub(" ", r["text"] or "") for r in left} == set(count)


def test_exact_dedup_spreads_hot_digests(docs, monkeypatch):
    expected = multiset(dicts(exact_dedup(docs)))
    monkeypatch.setattr("keyloom.llm.exact_dedup.HOT", 1)
    assert multiset(dicts(exact_dedup(docs))) == expected


def test_verification_parts_colliding_digests(docs):
    true, weak = dicts(exact_dedup(docs)), dicts(exact_dedup(docs, digest_bits=8))
    group = {(r["doc_id"], r["text_sha256"]): r["keep_id"] for r in true}
    sha = {r["doc_id"]: r["text_sha256"] for r in true}
    assert all(sha[r["keep_id"]] == r["text_sha256"] for r in weak)  # never joined with another text
    assert any(group[r["doc_id"], r["text_sha256"]] == r["keep_id"] for r in weak)


def test_merge_index():
    rng, index, expected = np.random.default_rng(4), MergeIndex(memtable=50, fanout=3), {}
    for _ in range(40):
        keys = np.array([hashlib.sha256(bytes([k])).digest() for k in rng.integers(0, 200, 30)], dtype="S32")
        ids = rng.integers(0, 10**6, 30)
        index.put(keys, ids, np.ones(30, np.int64))
        for k, i in zip(keys.tolist(), ids.tolist(), strict=True):
            n = expected.get(k, (i, 0))
            expected[k] = (min(n[0], i), n[1] + 1)
    run = index.entries()
    assert {k: (i, n) for k, i, n in zip(run.keys.tolist(), run.ids.tolist(), run.counts.tolist(), strict=True)} == expected and MergeIndex().entries() is None


# ---- 6: pieces


def test_nbest(docs, rows):
    got = encode_nbest(docs)
    for r in dicts(got):
        assert r["round_trip"] and r["scores"] == sorted(r["scores"], reverse=True) and len(r["ids"]) == r["n_tokens"][0]
    text = {(i, len((t or "").encode())): t or "" for i, t, *_ in rows}
    back = {(r["doc_id"], len(r["text"].encode())): r["text"] for r in dicts(decode_ids(got))}
    assert all(back[k] == t for k, t in text.items() if "▁" not in t)


def brute_segmentations(lattice, word):
    into = lattice.arcs(word)
    paths = {0: [(0.0, ())]}
    for j in range(1, len(word) + 1):
        paths[j] = [(s + a, p + b) for i, a, b in into[j] for s, p in paths[i]]
    return sorted(paths[len(word)], key=lambda x: -x[0])


def test_nbest_against_all_segmentations():
    m = Lattice(default_path())
    for text in ("the hello", "in the", "é中 a", "a\nb", "  x", "ter in"):
        words = ["▁" + w for w in __import__("keyloom.llm.pieces", fromlist=["pretokens"]).pretokens(text)]
        whole = [(0.0, ())]
        for w in words:
            whole = [(s + a, p + b) for s, p in whole for a, b in brute_segmentations(m, w)]
        best = sorted((s for s, _ in whole), reverse=True)[:5]
        found = m.encode(text, 5)
        assert [round(s, 3) for s, _ in found] == [round(s, 3) for s in best]
        assert len({tuple(p) for _, p in found}) == len(found) and all(m.decode(p) == text for _, p in found)
    words = ["▁the", "▁internationalisation", "▁x\ny", "▁", "▁▁a"]
    assert m.viterbi_batch(words) == [m.single(w[1:]) for w in words]


# ---- 7: quality classifier


def test_quality_classifier(spark, docs, rows):
    junk = {i: int("###" not in (t or "")) for i, t, *_ in rows if i is not None and i < 1000}
    labels = spark.createDataFrame([(i, y, 0) for i, y in junk.items()] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = dicts(classify_quality(docs, labels))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (remainder(r["doc_id"], 4) == 2) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in junk]
    good, bad = ([r["score"] for r in held if junk[r["doc_id"]] == y] for y in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)
    assert {r["score"] for r in dicts(classify_quality(docs, labels.limit(0)))} == {0.5}
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)


# ---- 8: quality rules


def counts(text):
    words = WORD.findall(text or "")
    places = collections.defaultdict(list)
    for k in range(len(words) - 4):
        places[tuple(words[k : k + 5])].append(k)
    covered = {x for p in places.values() if len(p) > 1 for k in p for x in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def test_quality_rules(docs, rows):
    got = dicts(quality_rules(docs, min_docs=20))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert multiset({n: r[n] for n in ["doc_id", *names]} for r in got) == multiset({"doc_id": i, **counts(t)} for i, t, *_ in rows)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"]) and any(r["kept"] for r in got)
    junk = {i for i, t, *_ in rows if "### " in (t or "")}
    assert not [r["doc_id"] for r in got if r["kept"] and r["doc_id"] in junk]
    stay = dicts(passing(docs, min_docs=20))
    assert len(stay) == sum(r["kept"] for r in got) and set(stay[0]) == set(docs.columns)


def test_buckets(spark):
    df = spark.createDataFrame([(v,) for v in [0, 1, 127, 128, 129, 1000, 123456]], "v long").select("v", bucket(F.col("v")).alias("b"))
    assert all(r["b"] <= r["v"] <= r["b"] * (1 + 1 / 64) for r in df.collect())


# ---- 9: context trees


def test_scores(docs, rows):
    got = dicts(score_texts(docs, head=20))
    lists = [[w for w in re.split(rb"[\x20\x09-\x0D]+", low(t)) if w] + [None] for _, t, *_ in rows]
    train = collections.Counter()
    for r, words in zip(rows, lists, strict=True):
        if remainder(r[0], 7) != 2:
            train.update(words)
    total, kinds = sum(train.values()), len(train)
    expected = collections.Counter()
    for r, words in zip(rows, lists, strict=True):
        base = sum(math.log10((train[w] + 1) / (total + kinds + 1)) for w in words)
        expected[(r[0], remainder(r[0], 7) == 2, len(words), sum(train[w] > 0 for w in words), total, round(base, 6))] += 1
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    again = {(r["doc_id"], r["n_bytes"]): r["base_score"] for r in dicts(score_texts(docs))}
    assert all(math.isclose(again[r["doc_id"], r["n_bytes"]], r["base_score"]) for r in got)  # with and without the join


def brute_tree(texts, score):
    """Context-tree weighting over two bytes of context with exact recursion, on tables of dictionaries."""
    n = collections.defaultdict(lambda: [0, 0])
    walk = lambda t: [((raw := bytes([255, 255]) + t + bytes([255]))[k - 2 : k], raw[k]) for k in range(2, len(t) + 3)]
    for t in texts:
        for c, b in walk(t):
            for level in range(8):
                for d in range(3):
                    n[c[2 - d :], level, b >> (8 - level)][b >> (7 - level) & 1] += 1
    kt = lambda x: (math.lgamma(x[0] + 0.5) + math.lgamma(x[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(x) + 1))
    kids = collections.defaultdict(list)
    for c, level, p in list(n):
        if c:
            kids[c[1:], level, p].append((c, level, p))
    weighted = {}

    def pw(node):
        if node not in weighted:
            own = kt(n[node])
            weighted[node] = own if len(node[0]) == 2 else np.logaddexp(own, sum(pw(k) for k in kids[node])) - math.log(2)
        return weighted[node]

    out = 0.0
    for c, b in walk(score):
        for level in range(8):
            bit, p = b >> (7 - level) & 1, None
            for d in (2, 1, 0):
                node = (c[2 - d :], level, b >> (8 - level))
                x = n.get(node, [0, 0])
                here = (x[bit] + 0.5) / (sum(x) + 1)
                if p is None:
                    p = here
                else:
                    share = math.exp(kt(x) - pw(node) - math.log(2)) if node in n else 0.5
                    p = share * here + (1 - share) * p
            out += math.log10(p)
    return out


def test_tree_against_recursion():
    import pyarrow as pa

    texts = [b"abracadabra", b"banana band", b"", b"abc"]
    found = list(count_triples(iter([pa.record_batch([pa.array(texts)], names=["t"])])))
    tree = Tree.build(found[0].column(0).to_numpy(), found[0].column(1).to_numpy())
    probe = [b"abra", b"band", b"", b"zebra", "é".encode()]
    assert np.allclose(tree.score(probe), [brute_tree(texts, t) for t in probe], rtol=1e-4)
    assert np.allclose((10.0 ** tree.table.astype(float)).sum(1), 1, atol=1e-4)  # proper in every context
    x = np.array([0.5, 1, 3.5, 100, 12345.5])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x])


# ---- 10: near copies


def brute_components(rows, per=90):
    sets = []
    for _, t, *_ in rows:
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", low(t)) if x]
        sets.append(frozenset(tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= per * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for a, r in enumerate(rows):
        least[find(a)] = min(least.get(find(a), LAST), number(r[0]))
    return [{"doc_id": r[0], "n_shingles": len(sets[a]), "component_id": None if least[find(a)] == LAST else least[find(a)]} for a, r in enumerate(rows)]


@pytest.mark.parametrize("block", [1000, 2])
def test_jaccard(docs, rows, block):
    assert multiset(dicts(jaccard_components(docs, block=block))) == multiset(brute_components(rows))


def test_jaccard_chain(spark):
    """Neighbours link, the ends don't; in tiny blocks no link is lost."""
    words = [f"w{k}" for k in range(130)]
    rows = [(k, " ".join(words[k : k + 80])) for k in range(40)] + [(100 + k, " ".join(words[60:125] + [f"v{k}"])) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1000, 3):
        assert multiset(dicts(jaccard_components(df, block=block))) == multiset(brute_components(rows))
    assert without_near_copies(df).count() == len({r["component_id"] for r in brute_components(rows)})


def test_signatures_meet():
    m, rng = Measure(90), np.random.default_rng(6)
    for n in (5, 9, 10, 11, 19, 20, 37, 100, 500, 3000):
        for _ in range(20):
            s = rng.integers(0, 1 << 63, n).astype(np.uint64)
            h = m.apart(2 * n)
            drop = rng.integers(0, h // 2 + 1)
            t = np.unique(np.r_[s[drop:], rng.integers(0, 1 << 63, drop).astype(np.uint64)])
            s = np.unique(s)
            same = len(np.intersect1d(s, t))
            if m.linked(len(s), len(t), same) and not np.array_equal(s, t):
                assert set(m.signatures(s).tolist()) & set(m.signatures(t).tolist())
    assert len(shingle_set(b"a b")) == 1 and len(shingle_set(b"A b c")) == 1 and np.array_equal(shingle_set(b"A b C d"), shingle_set(b"a\tb c  D"))


# ---- all


OPERATORS = {
    "repeats": lambda d: remove_repeats(d).select("doc_id", "n_bytes"),
    "tokens": token_counts,
    "mixing": lambda d: mix_sources(d).select("doc_id", "size", "taken"),
    "language": lambda d: detect_language(d).select("doc_id", "lang_pred"),
    "exact": lambda d: exact_dedup(d).select("doc_id", "keep_id", "group_size"),
    "pieces": lambda d: encode_nbest(d, with_ids=False).select("doc_id", "sha256"),
    "quality": lambda d: classify_quality(d, d.sparkSession.createDataFrame([(1, 1)], "doc_id long, quality int")).select("doc_id", "predicted"),
    "rules": lambda d: quality_rules(d).select("doc_id", "n_words", "kept"),
    "scores": lambda d: score_texts(d).select("doc_id", "n_tokens", F.round("base_score", 6).alias("base")),
    "jaccard": jaccard_components,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert dicts(OPERATORS[name](empty)) == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(docs, name):
    """Columns named like an operator's own, and other partitions, change nothing."""
    extra = {c: F.lit("x") for c in ("id", "t", "n", "w", "size", "kept", "src", "h", "keep", "digest", "key", "mark", "node", "rank", "z", "bucket", "total", "metric", "n_words", "g_lang", "e", "v", "u", "at")}
    few = docs.filter("doc_id < 40 or doc_id > 999")
    assert multiset(dicts(OPERATORS[name](few.withColumns(extra).repartition(7)))) == multiset(dicts(OPERATORS[name](few)))
