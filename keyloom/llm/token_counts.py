"""Token counts by rank-synchronous merging of arrays.

Texts are split into pre-tokens that no piece of the vocabulary crosses. The pre-tokens that a task hasn't met are held
together as ragged arrays of symbols; in each round every sequence applies its pair of lowest rank (leftmost on ties), all
sequences at once, until no pair is left. Surviving symbols are the tokens; a character outside the vocabulary counts its
UTF-8 bytes. A pre-token of more than LONG characters goes through the same merges with a heap, as one merge a round
would take time with the square of its length.

Defined results: null counts as empty, with 0 bytes and 0 tokens; ids are passed on as they are, null too; repeated rows
get equal counts; an empty table gives an empty result; other columns are ignored. Texts are counted whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pieces import SPACE, default_path, pretokens, vocabulary

#: Characters of the longest pre-token merged in arrays; pre-tokens kept in a task's table; words merged at once.
LONG, KEPT, BATCH = 400, 400_000, 30_000
NEVER = np.iinfo(np.int32).max


class Merger:
    def __init__(self, path: str):
        vocab = vocabulary(path)
        self.ids = vocab.ids
        ranks = {s: r for r, s in enumerate(sorted({vocab.score[i] for i in vocab.ids.values()}, reverse=True))}
        self.base = vocab.size
        found: dict[int, tuple[int, int]] = {}
        for piece, i in vocab.ids.items():
            for k in range(1, len(piece)):
                a, b = vocab.ids.get(piece[:k]), vocab.ids.get(piece[k:])
                if a is not None and b is not None:
                    found[a * self.base + b] = (ranks[vocab.score[i]], i)
        self.pairs = found
        keys = np.array(sorted(found), dtype=np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.rank = np.array([found[k][0] for k in keys] + [NEVER], dtype=np.int32)
        self.into = np.array([found[k][1] for k in keys] + [0], dtype=np.int32)
        self.known: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NEVER), self.into[at]

    def count_batch(self, words: list[str]) -> np.ndarray:
        """Symbols that survive for each sequence."""
        ids = self.ids
        symbols = [[ids.get(c, -1) for c in w] for w in words]
        length = np.array([len(s) for s in symbols])
        extra = np.zeros(len(words), dtype=np.int64)
        for i, s in enumerate(symbols):
            if -1 in s:
                extra[i] = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c, x in zip(words[i], s, strict=True) if x < 0)
        sym = np.fromiter((x for s in symbols for x in s), dtype=np.int32, count=int(length.sum()))
        owner = np.repeat(np.arange(len(words)), length)
        left = length.astype(np.int64).copy()
        rank = np.full(len(sym), NEVER, dtype=np.int32)
        into = np.zeros(len(sym), dtype=np.int32)
        joint = np.flatnonzero(owner[1:] == owner[:-1])
        rank[joint], into[joint] = self.look_up(sym[joint], sym[joint + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            least_each = np.repeat(least, sizes)
            live = least_each < NEVER
            if not live.all():  # sequences that are done leave
                sym, owner, rank, into, least_each = sym[live], owner[live], rank[live], into[live], least_each[live]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == least_each)
            at = hits[np.r_[True, owner[hits][1:] != owner[hits][:-1]]]
            left[owner[at]] -= 1
            sym[at] = into[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # places after the removal: one symbol goes for each place before
            sym, owner, rank, into = sym[keep], owner[keep], rank[keep], into[keep]
            ends = np.append(owner[1:] != owner[:-1], True)
            rank[at] = NEVER
            redo = np.concatenate([at, at[at > 0] - 1])
            redo = redo[~ends[redo]]
            rank[redo], into[redo] = self.look_up(sym[redo], sym[redo + 1])
        return left + extra

    def count_long(self, word: str) -> int:
        """The same merges by a heap, for one long sequence."""
        sym = [self.ids.get(c, -1) for c in word]
        n = len(sym)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and sym[i] >= 0 and sym[j] >= 0 and (hit := self.pairs.get(sym[i] * self.base + sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j]))

        for i in range(n):
            offer(i)
        count = n + sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c, x in zip(word, sym, strict=True) if x < 0)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if not alive[i] or sym[i] != a or (j := after[i]) >= n or sym[j] != b:
                continue
            sym[i] = self.pairs[a * self.base + b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            count -= 1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return count

    def count(self, texts: list[str]) -> list[int]:
        known, each = self.known, [pretokens(t) for t in texts]
        if len(known) > KEPT:
            known.clear()
        fresh = list(set().union(*each) - known.keys()) if each else []
        short = [w for w in fresh if len(w) < LONG]
        for a in range(0, len(short), BATCH):
            some = short[a : a + BATCH]
            known.update(zip(some, self.count_batch([SPACE + w for w in some]).tolist(), strict=True))
        for w in fresh:
            if len(w) >= LONG:
                known[w] = self.count_long(SPACE + w)
        out = [sum(map(known.__getitem__, words)) for words in each]
        for w in fresh:
            if len(w) >= LONG:
                del known[w]
        return out


@cache
def merger(path: str) -> Merger:
    return Merger(path)


def slices(texts: list[str], chars: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch with a bounded number of characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    path = model or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [x for a, z in slices(texts) for x in m.count(texts[a:z])]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
