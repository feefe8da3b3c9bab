"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover the whole document. Every byte has a learned vector;
learned filters of WIDTH bytes slide over a chunk, and each filter's greatest response in the chunk is pooled. A learned
layer turns a chunk's pooled responses into a logit, and a document's logit is the mean of its chunks', weighted by the bytes
that each adds.

The network is fitted on a bounded sample: up to `sample` labelled documents, and `sample_bytes` in all, in order of the
hash of their id. Whole documents are taken. Scores cover every row and every whole text.

Defined results: null counts as empty; an empty text is one chunk of padding and gets a score like any other; a null id goes
to the remainder 0; repeated rows get equal scores; without labels every score is 0.5; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, small_batches

SAMPLE, SAMPLE_BYTES = 3000, 12_000_000
CHUNK, STEP, WIDTH, STRIDE, DIM, FILTERS, PAD = 512, 480, 8, 4, 8, 32, 256
EPOCHS, BATCH, RATE = 12, 32, 0.008
SPOTS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all texts (n, CHUNK) as int16 with PAD beyond the end, each chunk's text, and its weight within the text."""
    parts, owner, weight = [], [], []
    for k, raw in enumerate(texts):
        n = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
        buf = np.full((n - 1) * STEP + CHUNK, PAD, dtype=np.int16)
        buf[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
        parts.append(np.lib.stride_tricks.sliding_window_view(buf, CHUNK)[::STEP])
        owner += [k] * n
        w = np.full(n, STEP, dtype=np.float32)
        w[-1] = max(1, len(raw) - (n - 1) * STEP)
        weight.append(w / w.sum())
    return np.concatenate(parts), np.array(owner), np.concatenate(weight)


class Net:
    def __init__(self, weights: list[np.ndarray] | None = None, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *s, by: (rng.standard_normal(s) * by).astype(np.float32)
        self.w = weights or [normal(PAD + 1, DIM, by=0.5), normal(WIDTH * DIM, FILTERS, by=0.18), np.zeros(FILTERS, np.float32), normal(FILTERS, by=0.2), np.zeros(1, np.float32)]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest responses (n, FILTERS), where they are, and the windows (n, SPOTS, WIDTH * DIM)."""
        table, filters, bias, _, _ = self.w
        vec = table[x].reshape(len(x), CHUNK * DIM)
        win = np.lib.stride_tricks.as_strided(vec, (len(x), SPOTS, WIDTH * DIM), (vec.strides[0], STRIDE * DIM * vec.itemsize, vec.itemsize))
        out = np.matmul(win, filters)
        at = out.argmax(axis=1)
        return np.maximum(np.take_along_axis(out, at[:, None, :], 1)[:, 0] + bias, 0), at, win

    def logits(self, x: np.ndarray) -> np.ndarray:
        table, filters, bias, w, b = self.w
        out = np.empty(len(x), dtype=np.float64)
        for a in range(0, len(x), 256):  # bounded memory
            vec = table[x[a : a + 256]].reshape(-1, CHUNK * DIM)
            win = np.lib.stride_tricks.as_strided(vec, (len(vec), SPOTS, WIDTH * DIM), (vec.strides[0], STRIDE * DIM * vec.itemsize, vec.itemsize))
            out[a : a + 256] = np.maximum(np.matmul(win, filters).max(axis=1) + bias, 0) @ w + b
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        start, held = 0, 0
        for k in range(len(texts) + 1):
            if k == len(texts) or held > 500_000:
                if k > start:
                    x, owner, weight = chunks(texts[start:k])
                    z = np.bincount(owner, self.logits(x) * weight, minlength=k - start)
                    out[start:k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                start, held = k, 0
            if k < len(texts):
                held += len(texts[k])
        return out

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Net:
        rng = np.random.default_rng(seed)
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        rounds = max(EPOCHS, 60 * BATCH // max(1, len(texts)))
        for r in range(rounds):
            order = rng.permutation(len(texts))
            for a in range(0, len(order), BATCH):
                some = order[a : a + BATCH]
                x, owner, weight = chunks([texts[i] for i in some])
                pool, at, win = self.pooled(x)
                z = np.bincount(owner, (pool @ self.w[3] + self.w[4]) * weight, minlength=len(some))
                miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
                each = (miss[owner] * weight).astype(np.float32)
                back = each[:, None] * self.w[3] * (pool > 0)
                rows = np.arange(len(x))[:, None]
                best = win[rows, at]  # (n, FILTERS, WIDTH * DIM)
                g_filters = np.einsum("nfk,nf->kf", best, back)
                g_vec = back[:, :, None] * self.w[1].T
                cells = at[:, :, None] * STRIDE + np.arange(WIDTH)
                codes = x[rows[:, :, None], cells]
                flat, values = codes.ravel(), g_vec.reshape(-1, DIM)
                g_table = np.stack([np.bincount(flat, values[:, d], minlength=PAD + 1) for d in range(DIM)], axis=1)
                grads = [g_table, g_filters, back.sum(0), pool.T @ each, np.array([each.sum()])]
                step += 1
                rate = RATE * (1 - 0.9 * r / rounds)
                for w, g, m, v in zip(self.w, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id: str, sample: int, sample_bytes: int) -> Net | None:
    """Learn from labelled rows whose remainder isn't 2. Of several labels of one id the greatest counts."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & (bucket_of(label_id, 4) != 2)).groupBy(F.col(label_id).alias("k")).agg(F.max(label_col).cast("double").alias("y"))
    # ids are chosen before texts are read, by rank of the hash: what goes to the driver is bounded by the sample
    few = marks.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(id_col).alias("i"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    rows = rows.join(F.broadcast(few), F.col("i") == F.col("k")).select("k", "y", "t", F.xxhash64("k").alias("h"), F.octet_length("t").alias("n"))
    # whole documents in order of the hash, as far as the bounds on rows and bytes go; none may take an eighth of the bytes
    texts, marks_, held = [], [], 0
    for r in rows.filter(F.col("n") <= sample_bytes // 8).orderBy("h", "k", "t").limit(sample).toLocalIterator():
        held += r["n"]
        if held > sample_bytes:
            break
        texts.append(bytes(r["t"]))
        marks_.append(r["y"])
    return Net().fit(texts, np.array(marks_)) if texts else None


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", threshold: float = 0.7, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    net = fit(docs, labels, id_col, text_col, label_col, label_id, sample, sample_bytes)
    weights = net.w if net else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = Net(weights).score([x.as_py() for x in b.column(2)]) if weights else np.full(b.num_rows, 0.5)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), (bucket_of(id_col, 4) == 2).alias("held_out"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("t"))
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
