"""Context-tree weighting over deep contexts, with counts that stay distributed.

A gram is a byte to predict and the DEPTH bytes before it. Tasks gather texts into bundles and send every shard the bundle's
distinct grams that belong to it, with their counts in the training texts: 0 for those of held-out texts alone. A shard has all
grams of the contexts (last byte, byte before it) that hash to it, so it weights the tree from the deepest nodes up to depth 2.
Depths 1 and 0 are sums over shards and of fixed size; the driver weights them. With these, each shard answers each bundle's
grams, and the bundle scores its texts. No context seen is left out, and the tables grow with the training texts; nothing that
grows with them is broadcast or sent to the driver. Grams without training counts are nodes with 1/2 in every decision, as in any
context tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

END, DEPTH = 0xFF, 6
#: Bytes of text that are looked at together, and that share a bundle's grams.
PART, BUNDLE = 2_000_000, 32_000_000
#: As shard: a row with texts, which stands after the answers to its bundle.
TEXTS = 1 << 30
#: Steps of a logarithm on its way back to the texts, as fine as those of a float.
STEPS = 1 << 20
BUNDLES = "bundle long, shard int, grams binary, counts binary, ids array<long>, held array<boolean>, sizes array<long>, texts binary, n_train long"
_NAMES = ["bundle", "shard", "grams", "counts", "ids", "held", "sizes", "texts", "n_train"]
_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.int64()]


def grams_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte to predict and every END, the context, its last byte first, and the byte; and where each text begins."""
    pad = bytes([END]) * depth
    raw = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    n = len(raw) - depth
    code = np.zeros(n, np.uint64)
    for k in (*range(1, depth + 1), 0):
        code <<= np.uint64(8)
        code |= raw[depth - k : depth - k + n]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + depth) - depth  # each text's END; the depth - 1 ENDs after it are context alone
    skip = (ends[:, None] + np.arange(1, depth)).ravel()
    keep = np.ones(n, bool)
    keep[skip[skip < n]] = False
    return code[keep], np.r_[0, np.cumsum(sizes + 1)[:-1]]


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Places:
    """Where each of many different numbers stands, by open addressing."""

    def __init__(self, codes: np.ndarray):
        self.codes, bits = codes, max(4, (3 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        rest, slot = np.arange(len(codes), dtype=np.int32), self._first(codes)
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]  # of several for one slot, one has it
            lost = self.slots[slot] != rest
            rest, slot = rest[lost], (slot[lost] + 1) & self.mask

    def _first(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The places of these, all of which must be there."""
        slot = self._first(codes)
        at = self.slots[slot]
        wrong = np.flatnonzero(self.codes[at] != codes)
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & self.mask
            here = self.slots[slot]
            at[wrong] = here
            still = self.codes[here] != codes[wrong]
            wrong, slot = wrong[still], slot[still]
        return at


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)


def gather(shards: int, depth: int, limit: int):
    """Rows (id, held, text) to rows of BUNDLES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bundle, size, found = TaskContext.get().partitionId() << 32, 0, []

        def settle() -> None:
            keys, counts = zip(*found, strict=True)
            found[:] = [_sum_by(np.concatenate(keys), np.concatenate(counts))]

        def answered() -> Iterator[pa.RecordBatch]:
            settle()
            codes, counts = found[0]
            at = shard_of(codes >> np.uint64(8 * depth - 8), shards)
            order = np.argsort(at, kind="stable")
            codes, counts, at = codes[order], counts[order], at[order]
            cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
            yield _batch([{"bundle": bundle, "shard": int(at[a]), "grams": packed(codes[a:b], True), "counts": packed(counts[a:b])} for a, b in zip(cut[:-1], cut[1:], strict=True)])

        def texts_of() -> Iterator[tuple[list, list, list]]:
            ids, held, texts, n = [], [], [], 0
            for b in batches:
                for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    ids.append(i)
                    held.append(h)
                    texts.append(t)
                    n += len(t)
                    if n > PART:
                        yield ids, held, texts
                        ids, held, texts, n = [], [], [], 0
            if texts:
                yield ids, held, texts

        for ids, held, texts in texts_of():
            for side in (False, True):
                some = [t for t, h in zip(texts, held, strict=True) if h is side]
                if some:
                    codes, n = np.unique(grams_of(some, depth)[0], return_counts=True)
                    found.append((codes, n.astype(np.int64) * (not side)))
            if sum(len(k) for k, _ in found) > 4_000_000:
                settle()
            sizes = [len(t) for t in texts]
            size += sum(sizes)
            yield _batch([{"bundle": bundle, "shard": TEXTS, "ids": ids, "held": held, "sizes": sizes, "texts": zstandard.ZstdCompressor(level=6).compress(b"".join(texts)), "n_train": held.count(False)}])
            if size > limit:
                yield from answered()
                bundle, size, found[:] = bundle + 1, 0, []
        if found:
            yield from answered()

    return run


class Weighted:
    """The tree of one shard: depths `depth` to 2."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, block):
        """codes in ascending order, each once."""
        self.codes, self.last = codes, (codes >> np.uint64(8 * depth)).astype(np.int64)
        entries, n, ups, sums = [codes.astype(np.int64)], [counts], [], []
        for _ in range(depth - 2):
            key, up = np.unique(entries[-1] >> 16 << 8 | entries[-1] & 255, return_inverse=True)
            n.append(np.bincount(up, n[-1], len(key)))
            entries.append(key)
            ups.append(up)
        self.deep = np.empty((8, len(codes)))  # of each gram's decisions: the probability by depth 2 and below
        for level in range(8):
            one, at, above = None, None, None
            for k, e in enumerate(entries):
                node = e >> (8 - level)
                first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                owner = np.cumsum(np.r_[False, node[1:] != node[:-1]])
                bit = e >> (7 - level) & 1
                total = np.add.reduceat(n[k], first)
                ones = np.add.reduceat(n[k] * bit, first)
                own = block(np.stack([total - ones, ones], 1))
                kt = (np.where(bit, ones[owner], (total - ones)[owner]) + 0.5) / (total[owner] + 1)
                if k == 0:
                    one, at, weight = kt, None, own
                else:
                    below = np.bincount(owner[ups[k - 1][above]], weight, len(first))
                    weight = np.logaddexp(own, below) - np.log(2)
                    share = np.exp(own - weight - np.log(2))[owner]
                    at = ups[0] if at is None else ups[k - 1][at]
                    one = share[at] * kt[at] + (1 - share[at]) * one
                above = first
            self.deep[level] = one
            # by last byte and decision: the sum of the weights of depth 2
            last = entries[-1][first] >> 16
            prefix = entries[-1][first] >> (8 - level) & ((1 << level) - 1)
            sums.append((last << 8 | 1 << level | prefix, weight))
        keys, inverse = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
        self.below = keys, np.bincount(inverse, np.concatenate([s[1] for s in sums]))
        keys, inverse = np.unique(entries[-1] >> 16 << 8 | entries[-1] & 255, return_inverse=True)
        self.counts = keys, np.bincount(inverse, n[-1])

    def logs(self, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """log10 of each gram's probability; top: what depths 1 and 0 add and what share they leave, by last byte and decision."""
        adds, leaves = top
        symbol = (self.codes & np.uint64(255)).astype(np.int64)
        out = np.zeros(len(self.codes))
        for level in range(8):
            at = 1 << level | symbol >> (8 - level)
            out += np.log10(adds[self.last, at, symbol >> (7 - level) & 1] + leaves[self.last, at] * self.deep[level])
        return out


def top_of(counts: np.ndarray, below: np.ndarray, block) -> tuple[np.ndarray, np.ndarray]:
    """counts: of bytes by last byte; below: sums of depth 2's weights by last byte and decision. See Weighted.logs()."""
    adds, leaves = np.zeros((256, 256, 2)), np.zeros((256, 256))
    for level in range(8):
        n1 = counts.reshape(256, 1 << level, 2, -1).sum(-1)
        n0 = n1.sum(0, keepdims=True)
        kt0, kt1 = ((x + 0.5) / (x.sum(-1, keepdims=True) + 1) for x in (n0, n1))
        at = slice(1 << level, 2 << level)
        e1 = block(n1)
        w1 = np.logaddexp(e1, below[:, at]) - np.log(2)
        e0 = block(n0)
        w0 = np.logaddexp(e0, w1.sum(0, keepdims=True)) - np.log(2)
        share1, share0 = np.exp(e1 - w1 - np.log(2)), np.exp(e0 - w0 - np.log(2))
        adds[:, at] = share0[..., None] * kt0 + ((1 - share0) * share1)[..., None] * kt1
        leaves[:, at] = (1 - share0) * (1 - share1)
    return adds, leaves


def _shards(batches: Iterator[pa.RecordBatch], depth: int, block) -> Iterator[tuple[Weighted, list[tuple[int, int, bytes]]]]:
    """The tree of each shard, and (bundle, shard, grams) of those who ask. Rows: shard, bundle, grams, counts, sorted by shard."""

    def tree() -> Weighted:
        total = _sum_by(np.concatenate([unpacked(g, np.uint64, True) for _, _, g in asked]), np.concatenate([unpacked(c, np.int64) for c in counts]))
        return Weighted(total[0], total[1].astype(np.float64), depth, block)

    asked, counts = [], []
    for b in batches:
        for shard, bundle, grams, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if asked and asked[-1][1] != shard:
                yield tree(), asked
                asked, counts = [], []
            asked.append((bundle, shard, grams))
            counts.append(n)
    if asked:
        yield tree(), asked


def sums_of(depth: int, block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, _ in _shards(batches, depth, block):
            for kind, (key, value) in enumerate((tree.counts, tree.below)):
                yield pa.record_batch([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int32)), pa.array(value.astype(np.float64))], names=["kind", "key", "value"])

    return run


def answers_of(depth: int, block, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, asked in _shards(batches, depth, block):
            logs = np.round(tree.logs(shared.value) * -STEPS).astype(np.uint32)
            for bundle, shard, grams in asked:
                at = np.searchsorted(tree.codes, unpacked(grams, np.uint64, True))
                yield _batch([{"bundle": bundle, "shard": shard, "grams": grams, "counts": packed(logs[at])}])

    return run


def scored(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[list, list, list[bytes], np.ndarray]]:
    """ids, held, texts and log10 probabilities, from rows of BUNDLES with logs as counts, sorted by bundle and shard."""
    now, held, codes, logs = None, [], None, None
    for b in batches:
        for k in range(b.num_rows):
            bundle, shard, grams, values, ids, marks, sizes, texts, _ = (c[k].as_py() for c in b.columns)
            if bundle != now:
                now, held, codes = bundle, [], None
            if shard != TEXTS:
                held.append((unpacked(grams, np.uint64, True), unpacked(values, np.uint32)))
                continue
            if codes is None:
                codes, logs = Places(np.concatenate([g for g, _ in held])), np.concatenate([v for _, v in held]) / -STEPS
                held = []
            raw, at = zstandard.ZstdDecompressor().decompress(texts), np.r_[0, np.cumsum(sizes)]
            each = [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
            code, start = grams_of(each, depth)
            yield ids, marks, each, np.add.reduceat(logs[codes.of(code)], start)


def model(rows: DataFrame, block, saved, depth: int = DEPTH, limit: int = BUNDLE) -> tuple[DataFrame, int]:
    """For rows (id, held, text): a frame for scored(), and the number of training texts."""
    spark = rows.sparkSession
    shards = max(64, 4 * rows.rdd.getNumPartitions())
    all_ = saved(rows.mapInArrow(gather(shards, depth, limit), BUNDLES))
    texts = all_.filter(F.col("shard") == TEXTS)
    train, bundles = texts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.countDistinct("bundle")).first()
    asked = all_.filter(F.col("shard") != TEXTS).select("shard", "bundle", "grams", "counts").repartition(shards, "shard").sortWithinPartitions("shard")
    sums = asked.mapInArrow(sums_of(depth, block), "kind int, key int, value double").groupBy("kind", "key").agg(F.sum("value").alias("value")).toArrow()
    kind, key, value = (c.to_numpy() for c in sums.columns)
    both = np.zeros((2, 65536))
    both[kind, key] = value
    shared = spark.sparkContext.broadcast(top_of(both[0].reshape(256, 256), both[1].reshape(256, 256), block))
    answers = asked.mapInArrow(answers_of(depth, block, shared), BUNDLES)
    return texts.union(answers).repartition(max(1, bundles), "bundle").sortWithinPartitions("bundle", "shard"), train
