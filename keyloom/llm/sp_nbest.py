"""SentencePiece encoding and decoding with N-best segmentation.

Each pre-token is a lattice of pieces. Forward Viterbi gives the best score from the start to every position; these are
exact heuristics for an A-star search that walks back from the end, so complete paths leave its queue in order of their
score and the search stops at the n-th. As no piece crosses pre-tokens, a text's N best are merged from its pre-tokens'
lists, exactly: of two or more alternatives in different pre-tokens, only sums among the n best can be extended to one.

A character outside the vocabulary is written as its byte pieces, at the lowest piece score less PENALTY each. Ties are
broken by the ids from the end of the text backwards in the lattice, and by earlier alternatives first in the merge.

Defined results: null counts as empty; an empty text has one segmentation, without pieces, of score 0; ids are passed on,
null too; repeated rows get equal results; an empty table gives an empty result; other columns are ignored. decode() undoes
encode() for every text, but for U+2581, which is the space mark itself.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .pieces import SPACE, default_path, pretokens, vocabulary
from .token_counts import slices

PENALTY, KEPT, BATCH = 10.0, 250_000, 30_000
#: Pre-tokens of more characters aren't kept in a task's table.
LONG = 64


class Lattice:
    def __init__(self, path: str):
        self.vocab = v = vocabulary(path)
        plain = [v.score[i] for p, i in v.ids.items() if v.score[i] > -1e8]
        self.byte_score = (min(plain) if plain else 0.0) - PENALTY
        self.byte_of = v.byte_of
        #: For every beginning of a piece: the piece's score and ids, or nothing where it is no piece itself.
        self.begins: dict[str, tuple] = {p[:k]: () for p in v.ids for k in range(1, len(p))}
        self.begins |= {p: (v.score[i], (i,)) for p, i in v.ids.items()}
        #: Characters written as one byte piece, such as line ends, are pieces in all but name.
        self.single_bytes = {chr(b): v.byte_ids[b] for b in range(128) if chr(b) not in v.ids}
        self.begins |= {c: (self.byte_score, (i,)) for c, i in self.single_bytes.items()}
        self.characters = {p for p in v.ids if len(p) == 1} | self.single_bytes.keys()
        self.shown = [chr(v.byte_of[i]) if v.byte_of.get(i, 255) < 128 else t for i, t in enumerate(v.text)]
        self.high = {i for i, b in v.byte_of.items() if b > 127}
        # the same as numbers: keys are a state and the next character, and lead to the state of the key's place plus 1. Levels
        # follow each other, so parents have smaller numbers and all keys ascend.
        keys, pieces, number = [], [], {"": 0}
        for size in range(1, v.longest + 1):
            for key, p in sorted((number[p[:-1]] << 21 | ord(p[-1]), p) for p in self.begins if len(p) == size):
                keys.append(key)
                pieces.append(v.ids.get(p, self.single_bytes.get(p, -1)))
                number[p] = len(keys)
        self.trie_keys, self.trie_piece = np.array(keys, dtype=np.int64), np.array(pieces, dtype=np.int32)
        self.piece_score = np.array([self.byte_score if i in v.byte_of else x for i, x in enumerate(v.score)])
        self.known: dict[str, tuple[float, float, bytes]] = {}
        self.bad: set[str] = set()
        self.large: list[str] = []

    def arcs(self, word: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position, the arcs into it: (start, score, ids)."""
        ids, score, longest, n = self.vocab.ids, self.vocab.score, self.vocab.longest, len(word)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + longest) + 1):
                if (p := ids.get(word[i:j])) is not None:
                    into[j].append((i, score[p], (p,)))
            if word[i] not in ids:
                raw = word[i].encode("utf-8", "surrogatepass")
                into[i + 1].append((i, self.byte_score * len(raw), tuple(self.vocab.byte_ids[b] for b in raw)))
        return into

    def nbest(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one pre-token, best first."""
        into = self.arcs(word)
        best = [0.0] + [float("-inf")] * len(word)
        for j in range(1, len(word) + 1):
            best[j] = max(best[i] + s for i, s, _ in into[j])
        # (minus the score of the best complete path through here, tie, position, score from here to the end, link)
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], 0, len(word), 0.0, None)]
        out, turn, done = [], 0, [0] * (len(word) + 1)
        while queue and len(out) < n:
            _, _, at, tail, link = heapq.heappop(queue)
            done[at] += 1
            if done[at] > n:  # n better paths already pass through here
                continue
            if not at:
                path: list[int] = []
                while link:
                    path += link[0]
                    link = link[1]
                out.append((tail, tuple(path)))
                continue
            for i, s, p in into[at]:
                turn += 1
                heapq.heappush(queue, (-(best[i] + s + tail), turn, i, s + tail, (p, link)))
        return out

    def viterbi(self, word: str) -> tuple[float, float, tuple[int, ...]]:
        """Score of the best path, what the second best loses against it (infinity if there is none), and the best path."""
        n, begins, none = len(word), self.begins, float("-inf")
        one, two, start, piece = [none] * (n + 1), [none] * (n + 1), [0] * (n + 1), [()] * (n + 1)
        one[0] = 0.0
        for i in range(n):
            x, y, j = one[i], two[i], i + 1
            hit = begins.get(word[i:j])
            longer = hit is not None
            if not hit:  # no piece of one character: its bytes
                raw = word[i].encode("utf-8", "surrogatepass")
                hit = (self.byte_score * len(raw), tuple(self.vocab.byte_ids[b] for b in raw))
            while True:
                if hit:
                    s = hit[0]
                    z = x + s
                    if z > one[j]:
                        s += y
                        two[j] = one[j] if one[j] > s else s
                        one[j], start[j], piece[j] = z, i, hit[1]
                    elif z > two[j]:
                        two[j] = z
                if j == n or not longer:
                    break
                j += 1
                hit = begins.get(word[i:j])
                if hit is None:  # no piece begins like this
                    break
        path: list[tuple[int, ...]] = []
        at = n
        while at:
            path.append(piece[at])
            at = start[at]
        return one[n], one[n] - two[n], tuple(chain.from_iterable(reversed(path)))

    def viterbi_batch(self, words: list[str]) -> list[tuple[float, float, bytes]]:
        """viterbi() of many pre-tokens at once, all of whose characters are pieces. One node stands before each character and one
        at each end; pieces are found by walking the trie of their beginnings from all characters in step."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
        length = np.array([len(w) for w in words])
        last = np.cumsum(length)
        owner = np.repeat(np.arange(len(words)), length)
        room = last[owner] - np.arange(len(codes))  # characters to the word's end
        node = np.arange(len(codes)) + owner
        state, at, found = np.zeros(len(codes), np.int64), np.arange(len(codes)), []
        for step in range(1, self.vocab.longest + 1):
            key = state << 21 | codes[at + step - 1]
            hit = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            good = self.trie_keys[hit] == key
            state, at = hit[good] + 1, at[good]
            piece = self.trie_piece[state - 1]
            is_piece = piece >= 0
            found.append((at[is_piece], np.full(int(is_piece.sum()), step), piece[is_piece]))
            more = room[at] > step
            state, at = state[more], at[more]
            if not len(at):
                break
        # the longest first, so that of equal scores into one node the earliest start wins, as in viterbi()
        start, step, piece = (np.concatenate(x) for x in zip(*reversed(found), strict=True))
        ends = (start - (last - length)[owner[start]]) + step  # position within the word
        order = np.argsort(node[start] + step, kind="stable")
        order = order[np.argsort(ends[order].astype(np.uint16), kind="stable")]
        start, step, piece, ends = node[start[order]], step[order], piece[order], ends[order]
        into, gain = start + step, self.piece_score[piece]
        one = np.full(len(codes) + len(words), -np.inf)
        two, link, used = one.copy(), np.zeros(len(one), np.int64), np.zeros(len(one), np.int32)
        first = last - length + np.arange(len(words))
        one[first] = 0.0
        cuts = np.searchsorted(ends, np.arange(1, int(length.max()) + 2))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # arcs that end at one position of their words
            if a == z:
                continue
            st, e = start[a:z], into[a:z]
            group = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            best = one[st] + gain[a:z]
            top = np.maximum.reduceat(best, group)
            turn = np.repeat(np.arange(len(group)), np.diff(np.r_[group, z - a]))
            lead = np.flatnonzero(best == top[turn])
            lead = lead[np.r_[True, turn[lead][1:] != turn[lead][:-1]]]
            second = np.maximum.reduceat(two[st] + gain[a:z], group)
            best[lead] = -np.inf
            here = e[group]
            one[here], two[here] = top, np.maximum(second, np.maximum.reduceat(best, group))
            link[here], used[here] = st[lead], piece[a:z][lead]
        final = first + length
        walk, who, back = final.copy(), np.arange(len(words)), []
        while len(who):
            back.append((who, used[walk]))
            walk = link[walk]
            live = walk > first[who]
            who, walk = who[live], walk[live]
        names, ids = (np.concatenate(x) for x in zip(*reversed(back), strict=True))
        order = np.argsort(names, kind="stable")
        raw, bounds = ids[order].astype("<i4").tobytes(), 4 * np.searchsorted(names[order], np.arange(len(words) + 1))
        score, loss, bounds = one[final].tolist(), (one[final] - two[final]).tolist(), bounds.tolist()
        return [(score[k], loss[k], raw[bounds[k] : bounds[k + 1]]) for k in range(len(words))]

    def single(self, word: str) -> tuple[float, float, bytes]:
        score, loss, ids = self.viterbi(SPACE + word)
        return score, loss, np.array(ids, dtype="<i4").tobytes()

    def learn(self, words: Iterable[str]) -> dict[str, tuple[float, float, bytes]]:
        """The table of best paths, with these pre-tokens (without their space marks) added."""
        known, pieces = self.known, self.characters
        if len(known) > KEPT:
            known.clear()
        for w in self.large:
            known.pop(w, None)
        fresh = [w for w in words if w not in known]
        plain = [w for w in fresh if len(w) < LONG and (w.isascii() or pieces >= set(w))]
        for a in range(0, len(plain), BATCH):
            some = plain[a : a + BATCH]
            known.update(zip(some, self.viterbi_batch([SPACE + w for w in some]), strict=True))
        for w in fresh:
            if w not in known:
                known[w] = self.single(w)
        self.large = [w for w in fresh if len(w) >= LONG]
        # every path that the table holds decodes to its pre-token
        raw = b"".join([known[w][2] for w in fresh])
        if self.marked(np.frombuffer(raw, "<i4").tolist()) != "".join([SPACE + w for w in fresh]):
            self.bad |= {w for w in fresh if self.marked(np.frombuffer(known[w][2], "<i4").tolist()) != SPACE + w}
        return known

    def segment(self, text: str, n: int = 1, words: list[str] | None = None) -> tuple[bytes, list[tuple[float, list[tuple[int, bytes, tuple[int, ...]]]]], bool]:
        """The best ids of a text (little-endian int32), its n best as (score, [(pre-token, best ids there, ids instead)]), and
        whether all of them decode to the text."""
        if words is None:
            words = pretokens(text)
            self.learn(dict.fromkeys(words))
        known = self.known
        paths = [known[w] for w in words]
        first = sum([p[0] for p in paths])
        # alternatives by what they lose against the best: the second best score tells which pre-tokens can be among the
        # n of least loss, and only those are searched
        losses = [p[1] for p in paths]
        close = [(x, k) for x, k in heapq.nsmallest(n - 1, zip(losses, range(len(losses)), strict=True)) if x < float("inf")] if n > 1 else []
        other = {k: [x for x in self.nbest(SPACE + words[k], n) if np.array(x[1], "<i4").tobytes() != paths[k][2]][: n - 1] for _, k in close}
        loss = heapq.nsmallest(n - 1, ((paths[k][0] - s, k, r) for k, found in other.items() for r, (s, _) in enumerate(found)))
        found: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        for lost, k, r in loss:
            found = heapq.nsmallest(n, found + [(x + lost, (*c, (k, r))) for x, c in found if all(k != q for q, _ in c)])
        out = [(first - lost, [(k, paths[k][2], other[k][r][1]) for k, r in sorted(c)]) for lost, c in found]
        whole = self.bad.isdisjoint(words) and all(self.marked(q) == SPACE + words[k] for _, c in out for k, _, q in c)
        return b"".join([p[2] for p in paths]), out, whole

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text: (score, ids), best first."""
        words, out = pretokens(text), []
        known = self.learn(dict.fromkeys(words))
        for score, changes in self.segment(text, n, words)[1]:
            row = {k: p for k, _, p in changes}
            out.append((score, [i for k, w in enumerate(words) for i in row.get(k) or np.frombuffer(known[w][2], "<i4").tolist()]))
        return out

    def marked(self, ids: Iterable[int]) -> str:
        """The text of ids with space marks; bytes that are no UTF-8 come back as U+FFFD."""
        ids = list(ids)
        if self.high.isdisjoint(ids):
            return "".join(map(self.shown.__getitem__, ids))
        return b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.vocab.text[i].encode() for i in ids).decode("utf-8", "replace")

    def decode(self, ids: Iterable[int]) -> str:
        text = self.marked(ids).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


SCHEMA = "doc_id long, n_bytes long, ids array<int>, scores array<double>, n_tokens array<int>, sha256 string, round_trip boolean"


def encode_nbest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, ids of the best segmentation (null without with_ids), scores and numbers of
    pieces of the n best (fewer if there are fewer), sha256 of the best ids (little-endian int32) and of what the others
    change, and round_trip, whether each of them decodes to the text."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for a, z in slices(texts):
                rows, parts = [], []
                each = [pretokens(t) for t in texts[a:z]]
                m.learn(dict.fromkeys(chain.from_iterable(each)))
                for k, t, words in zip(keys[a:z], texts[a:z], each, strict=True):
                    raw, found, back = m.segment(t, n, words)
                    sha = hashlib.sha256(raw)
                    sha.update(repr([[(w, p) for w, _, p in c] for _, c in found[1:]]).encode())
                    sizes = [len(raw) // 4 + sum(len(q) - len(p) // 4 for _, p, q in c) for _, c in found]
                    rows.append((k, len(t.encode("utf-8", "surrogatepass")), [s for s, _ in found], sizes, sha.hexdigest(), back))
                    parts.append(raw)
                key, size, scores, sizes, sha, back = zip(*rows, strict=True)
                if with_ids:
                    ends = (np.cumsum([0, *map(len, parts)]) // 4).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(parts), dtype="<i4")))
                else:
                    ids = pa.nulls(len(rows), pa.list_(pa.int32()))
                cols = [pa.array(key, pa.int64()), pa.array(size, pa.int64()), ids, pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.list_(pa.int32())), pa.array(sha), pa.array(back)]
                yield pa.record_batch(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t")).mapInArrow(run, SCHEMA)


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, text: the text of each list of ids; null ids give a null text."""
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lattice(path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([None if x is None else m.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
