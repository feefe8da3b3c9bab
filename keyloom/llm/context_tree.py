"""LM scoring by context-tree weighting, and a word unigram score beside it.

The model predicts a text's UTF-8 bytes and then END, a byte that UTF-8 never uses and that also stands before the start. A
byte is eight binary decisions; each is predicted in the contexts of the last DEPTH, ..., 1, 0 bytes. Every node (context and
decisions so far) has the zeros and ones that followed it in the training texts, with the Krichevsky-Trofimov estimate; block
probabilities are weighted against the product of the children's, half each, from the deepest nodes to the root, and the
posterior weights mix the estimates of all depths in each prediction. Scores are proper: those of all texts sum to one.

Counts cover all training texts and stay distributed: context_shards deals the grams of DEPTH bytes and one to shards by their
last bytes, where they meet those of the documents. The model's tables grow with the training texts.

Base scores count every token of all training texts. The HEAD most frequent tokens go to the tasks as a table; every other
token of a document meets its count in a join on the token. Both ways give the same figures.

Defined results: null counts as empty: no words, one end, the bytes of END alone; a null id has the remainder 0; repeated rows
get equal scores and each counts in training; without training texts all base scores are 0 and every decision has 1/2; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, UPPER, bucket_of, saved, small_batches
from .context_shards import DEPTH, _sum_by, model, scored
from .quality_rules import bucket

END, HEAD = 0xFF, 300_000
#: White space besides the blank.
SPACES = "\t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes that are looked at together.
PART = 2_000_000


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """END END t1 END END t2 END END ..., and where the first byte of each text, or its END, is."""
    pad = bytes([END, END])
    raw = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 2
    return raw, np.r_[2, 2 + np.cumsum(sizes)[:-1]]


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte to predict, context and byte as c2 << 16 | c1 << 8 | b; and where each text begins among them."""
    raw, start = _joined(texts)
    wide = raw.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    keep = np.ones(len(code), dtype=bool)
    keep[start[1:] - 3] = False  # the second END between two texts
    keep[-1] = False
    return code[keep], start - 2 - np.arange(len(start))


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for b in batches:
        for texts in _parts(b.column(0).to_pylist()):
            k, n = np.unique(_symbols(texts)[0], return_counts=True)
            keys, counts = _sum_by(np.concatenate([keys, k]), np.concatenate([counts, n]))
    for a in range(0, len(keys), 1 << 16):
        yield pa.record_batch([pa.array(keys[a : a + (1 << 16)].astype(np.int32)), pa.array(counts[a : a + (1 << 16)])], names=["code", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series beyond 8, reached by the recurrence."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    z = x.copy()
    for _ in range(8):
        low = z < 8
        shift = shift + np.where(low, np.log(z), 0)
        z = np.where(low, z + 1, z)
    inv = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260 - shift


def block(n: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability of n[..., 0] zeros and n[..., 1] ones."""
    a, b = n[..., 0], n[..., 1]
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - math.log(math.pi) - log_gamma(a + b + 1)


#: log_gamma(k + 0.5) and log_gamma(k + 1) for small k.
SMALL = 4096
_HALF, _WHOLE = log_gamma(np.arange(SMALL) + 0.5), log_gamma(np.arange(SMALL) + 1.0)


def block_of_counts(n: np.ndarray) -> np.ndarray:
    """block() of whole numbers, most of them small."""
    total = n.sum(-1)
    small = total < SMALL
    at = np.where(small[..., None], n, 0).astype(np.int64)
    out = _HALF[at[..., 0]] + _HALF[at[..., 1]] - math.log(math.pi) - _WHOLE[at.sum(-1)]
    if not small.all():
        out[~small] = block(n[~small])
    return out


class Tree:
    """Predictions of the weighted tree over two bytes of context, held in one process; the tests hold it against recursion."""

    def __init__(self, rows: np.ndarray, table: np.ndarray):
        self.rows, self.table = rows, table  # context of two bytes -> row; row -> log10 probability of each byte

    @classmethod
    def build(cls, codes: np.ndarray, counts: np.ndarray) -> Tree:
        codes = codes.astype(np.int64)
        contexts, at = np.unique(codes >> 8, return_inverse=True)
        n = len(contexts)
        deep = np.zeros((n + 256, 256))
        deep[at, codes & 255] = counts  # after the n contexts seen: one without counts for each last byte
        last = np.r_[contexts & 255, np.arange(256)]
        middle = np.zeros((256, 256))
        np.add.at(middle, last, deep)
        out = np.zeros((n + 256, 256))
        symbols = np.arange(256)
        for level in range(8):
            split = lambda m: m.reshape(len(m), 1 << level, 2, -1).sum(-1)  # noqa: B023, E731
            n2, n1 = split(deep), split(middle)
            n0 = n1.sum(0, keepdims=True)
            kt = [(x + 0.5) / (x.sum(-1, keepdims=True) + 1) for x in (n0, n1, n2)]
            p2 = block(n2)
            below1 = np.zeros(n1.shape[:2])
            np.add.at(below1, last, p2)
            e1 = block(n1)
            w1 = np.logaddexp(e1, below1) - math.log(2)
            e0, below0 = block(n0), w1.sum(0, keepdims=True)
            w0 = np.logaddexp(e0, below0) - math.log(2)
            share1 = np.exp(e1 - w1 - math.log(2))[..., None]
            share0 = np.exp(e0 - w0 - math.log(2))[..., None]
            one = share1[last] * kt[1][last] + (1 - share1[last]) * kt[2]
            bit = share0 * kt[0] + (1 - share0) * one
            out += np.log10(bit)[:, symbols >> (8 - level), symbols >> (7 - level) & 1]
        rows = np.repeat(np.arange(n, n + 256)[None], 256, 0).ravel()  # c2 << 8 | c1
        rows[contexts] = np.arange(n)
        return cls(rows.astype(np.int32), out.astype(np.float32))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text."""
        out = []
        for some in _parts(texts):
            code, start = _symbols(some)
            each = self.table.ravel()[self.rows[code >> 8].astype(np.int64) * 256 + (code & 255)]
            out.append(np.add.reduceat(each.astype(np.float64), start))
        return np.concatenate(out) if out else np.zeros(0)


def tokens(raw: bytes) -> list[bytes]:
    """Lower-cased words; bytes.split() parts at exactly the six ASCII white spaces."""
    return raw.translate(_LOWER).split()


def words_of(texts: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """The lower-cased words of texts in UTF-8, one after the other, and where those of each text begin."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32).tobytes())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.StringArray.from_buffers(len(texts), ends, pa.py_buffer(b"".join(texts)))))
    found, number = lists.flatten(), lists.value_lengths().to_numpy()
    real = pc.binary_length(found).to_numpy() > 0
    before = np.r_[0, np.cumsum(real)][np.r_[0, np.cumsum(number)[:-1]]]
    return found.filter(pa.array(real)), before.astype(np.int64)


def frequent(counts: DataFrame, head: int) -> list[tuple[str, int]]:
    """The tokens with the greatest counts, `head` at most, as far as whole buckets of counts go. The bound is found on sums by
    bucket, of which there are a few thousand at most, so neither a task nor the driver gets more than the result."""
    sums = counts.groupBy(bucket(F.col("c")).alias("b")).agg(F.count("*").alias("n")).collect()
    held, least = 0, NO_ID
    for b, n in sorted((tuple(r) for r in sums), reverse=True):
        if held + n > head:
            break
        held, least = held + n, b
    top = counts.filter(F.col("c") >= least).toArrow()
    return list(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes,
    bits_per_byte (the model's code length, END's included, per byte of the text and END)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = bucket_of(id_col, 7) == 2
    train = small_batches(docs).filter(~held).select(text.alias("t"))
    word = F.explode(F.split(F.translate("t", UPPER + SPACES, LOWER + " " * len(SPACES)), " ")).alias("w")
    counts = saved(train.select(word).filter("w != ''").groupBy("w").agg(F.count("*").alias("c")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.encode(text, "UTF-8").alias("t"))
    asked, ends = model(rows, block_of_counts, saved, depth)  # one end for each training text
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = total + ends, kinds + (ends > 0)
    whole = total + 1 * (kinds + 1)
    top = frequent(counts, head)
    shared = spark.sparkContext.broadcast(([w for w, _ in top], np.log10((np.array([c for _, c in top], dtype=np.float64) + 1) / whole)))
    end_score = math.log10((ends + 1) / whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, logs = shared.value
        names, logs = pa.array(names, pa.string()), np.append(logs, 0.0)  # the last: of no token of the head
        for ids, marks, raw, score in scored(batches, depth):
            words, first = words_of(raw)
            at = pc.fill_null(pc.index_in(words, value_set=names), len(names)).to_numpy()
            missing = at == len(names)
            total_of = lambda x: np.add.reduceat(np.append(x, 0), first) * (ends_of > first)  # noqa: B023, E731
            ends_of = np.append(first[1:], len(words))
            n, base, hits = ends_of - first + 1, total_of(logs[at]) + end_score, total_of(~missing) + (ends > 0)
            cuts = np.r_[0, np.cumsum(total_of(missing))].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(cuts), words.filter(pa.array(missing)))
            sizes = [len(t) for t in raw]
            cols = [pa.array(ids, pa.int64()), pa.array(marks, pa.bool_()), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(sizes, pa.int64()), rest]
            yield pa.record_batch(cols, names=["doc_id", "held_out", "n_tokens", "n_head", "base_head", "score", "n_bytes", "rest"])

    first = asked.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_head long, base_head double, score double, n_bytes long, rest array<string>")
    first = saved(first.withColumn("uid", F.monotonically_increasing_id()))
    rest = first.select("uid", F.explode("rest").alias("x"))
    c = F.coalesce("c", F.lit(0))
    rest = rest.join(counts, F.col("x") == F.col("w"), "left").groupBy("uid").agg(F.sum(F.log10((c + 1) / F.lit(float(whole)))).alias("base_rest"), F.sum((c > 0).cast("long")).alias("n_rest"))
    out = first.drop("rest").join(rest, "uid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_head") + F.coalesce("n_rest", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_head") + F.coalesce("base_rest", F.lit(0.0))).alias("base_score"),
        "score", "n_bytes",
        (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
