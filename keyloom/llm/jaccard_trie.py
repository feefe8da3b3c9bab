"""N-gram Jaccard join by prefix trees.

A document's set holds its distinct word shingles, as 64-bit hashes; the order of hashes is the global order. Documents of
equal sets are one node from the start, so exact copies cost nothing further.

Who may meet: sets of sizes within the threshold differ in at most H elements, H by their sizes. Elements are dealt by hash
into H / 2 + 1 + spare classes, and those of a class into three parts. In all but H / 2 classes two linked sets differ in one element
at most, so two parts of such a class agree; each two parts of a class are a signature under which sets meet. (Of few classes, as
small sets have them, each counts whole, and there are H + 1 + spare.) A signature without elements tells nothing and is left out. Where
that concerns more classes than are spare, a set signs under the next of SEEDS hashes as well, so that of two linked sets at least
one has enough under a hash that both sign under. Sizes are cut into buckets so that linked sets lie in one or neighbouring buckets;
a set signs for both pairs of buckets that it belongs to. Those under one signature form a family around one of them, its lead,
and families around one lead are one family. So every link lies within a family.

Signatures are many, and nearly all of them are met by nobody. So tasks gather them in batches, sorted, as steps of a few
bytes, and send each shard one piece of a batch; a signature that several sets of a batch share goes there once, for the first
of them, and the others learn the lead that the shard finds in a join on signature and batch. A signature that a third of all sets
share thus sends a shard one entry a batch. Texts travel only for sets with a family: a table of bits keeps the others back.

Within a family the sets are stored in a trie in global order, held as arrays. Each set traverses it level by level, sharing the
overlap of common beginnings; a subtree is left when even all remaining elements can't reach the threshold, or when it holds
no set after the traversing one that isn't of its component already. What is returned are the links that join components, not all pairs.

A family of more than BLOCK sets, or of more than BLOCK_SIZE elements, is cut into blocks, each with the lead. Sets that a block doesn't connect with the
central one are then joined against all other blocks, so that no link is lost and no task holds more than a block and as many
probes. Components come from large-star and small-star steps.

Defined results: null or empty text, or text of white space, has no shingle, a component of its own and links with nothing;
a null id sorts after all others; repeated rows are linked with each other; each row follows its own text if one id has
several (rows are known by id and the text's hash); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, number, original, packed, saved, small_batches, unpacked
from .components import connected
from .context_tree import tokens

BLOCK, BLOCK_SIZE, PROBES = 1000, 500_000, 1000
#: Hashes that a set signs under at most; differing elements up to which classes count whole.
SEEDS, FEW = 16, 8
#: Signatures that a task gathers before it sends them, bytes of text that send one shard theirs, and bits of a signature.
GATHERED, SHARE, SIGN_BITS = 1_500_000, 20_000_000, 48
#: Elements of a run of the trie before it is parted.
EDGE = 16
#: Tasks that families are dealt to at most.
TASKS = 100_000
#: Kinds of rows that tasks give: a document's set, a batch's signatures for a shard, and those of a batch that share one.
SET, SIGNS, GROUP = 0, 1, 2
#: Words whose hashes a task keeps.
KEPT = 100_000
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _D
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words than width the whole sequence is one."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > KEPT:
        _words.clear()
    get = _words.get
    each = [get(w) or _words.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words]
    h = np.array(each, dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = mix(out * _B + h[k : k + n])
    return np.unique(out)


class Measure:
    """Jaccard threshold per / 100 in whole numbers."""

    def __init__(self, per: int = 90):
        self.per = per

    def apart(self, total: int) -> int:
        """Most elements in which linked sets of total size differ: 100 (t - h) / 2 >= per (t + h) / 2."""
        return total * (100 - self.per) // (100 + self.per)

    def linked(self, a: int, b: int, overlap: int) -> bool:
        return (100 + self.per) * overlap >= self.per * (a + b)

    @cache  # noqa: B019
    def bounds(self, size: int) -> list[int]:
        """Starts of the buckets up to beyond size: linked sets lie in one bucket or neighbours."""
        out = [1]
        while out[-1] <= size:
            out.append(max(out[-1] + 1, -(-out[-1] * 100 // self.per)))
        return [*out, -(-out[-1] * 100 // self.per) + 1]

    def classes(self, most: int) -> tuple[int, int, int]:
        """For sets that differ in so many elements at most: classes, parts of each, and how many classes are spare."""
        if most < FEW:
            return most + 3, 1, 2
        spare = 3 + most // 20
        return most // 2 + 1 + spare, 3, spare

    def signatures(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            return np.zeros(0, np.uint64)
        bounds = self.bounds(1 << int(len(s)).bit_length())
        k = int(np.searchsorted(bounds, len(s), side="right")) - 1
        value, out = mix(s * _C), []
        for level in {max(k - 1, 0), k}:  # where the smaller of two linked sets lies
            least = bounds[level + 1] - 1
            most = self.apart(least + least * 100 // self.per)
            if not most:  # only equal sets
                continue
            classes, parts, spare = self.classes(most)
            for seed in range(SEEDS):
                h = mix(s + np.uint64(seed) * _B)
                at = ((h >> np.uint64(32)) * np.uint64(classes) >> np.uint64(32)).astype(np.int64)
                if parts > 1:
                    at = at * parts + ((h & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
                count = np.bincount(at, minlength=classes * parts).reshape(classes, parts)
                content = np.zeros(classes * parts, np.uint64)
                np.add.at(content, at, value)
                content = content.reshape(classes, parts)
                if parts > 1:  # all but one part
                    count, content = count.sum(1, keepdims=True) - count, content.sum(1, keepdims=True) - content
                bare = count == 0
                enough = bare.any(1).sum() <= spare
                if seed == SEEDS - 1 and not enough:
                    bare[:] = False
                name = np.array([level * SEEDS + seed + 1], np.uint64)
                each = content.ravel() + np.arange(bare.size, dtype=np.uint64) * _B
                out.append(mix(mix(each[~bare.ravel()]) + name * _C))
                if enough:
                    break
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Trie:
    """Sets in a trie in global order, held as arrays, so that a traversal handles all nodes of one level together. A node is a run of
    elements that the sets below it share at one place; long runs are parted (EDGE elements, then twice as many), so that the bound
    applies early. Sets are known by their place in the order; label tells components."""

    def __init__(self, measure: Measure, sets: list[np.ndarray]):
        self.measure, self.sets = measure, sets
        self.universe = np.unique(np.concatenate(sets))
        self.has = np.zeros(len(self.universe), np.uint8)
        coded = [np.searchsorted(self.universe, s).astype(">u4") for s in sets]
        keys = [c.tobytes() for c in coded]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.label = np.arange(len(sets))
        self.twins: list[tuple[int, int]] = []  # places of equal sets
        # nodes: the one above, depths where the run begins and ends, place of a set below, place of the set that ends here
        up, start, depth, low_place, member = [-1], [0], [0], [0], [-1]
        path = [0]

        def grow(begin: int, end: int, place: int, ends: int) -> None:
            for column, x in zip((up, start, depth, low_place, member), (path[-1], begin, end, place, ends), strict=True):
                column.append(x)
            path.append(len(up) - 1)

        for p, i in enumerate(self.order):
            s, common, last = coded[i], 0, -1
            if p:
                t = coded[self.order[p - 1]]
                same = s[: len(t)] == t[: len(s)]
                common = len(same) if same.all() else int(same.argmin())
            while depth[path[-1]] > common:
                last = path.pop()
            if depth[path[-1]] < common:
                grow(depth[path[-1]], common, low_place[last], -1)
                up[last], start[last] = path[-1], common
            if common == len(s):
                self.twins.append((p, member[path[-1]]))
                self.label[p] = self.label[member[path[-1]]]
            else:
                grow(common, len(s), p, p)
        low = [d if m >= 0 else 1 << 60 for d, m in zip(depth, member, strict=True)]  # sizes of the sets below
        high = [d if m >= 0 else 0 for d, m in zip(depth, member, strict=True)]
        beyond = [m + 1 for m in member]  # places below: low_place up to here
        for p, q in self.twins:
            k = member.index(q)
            beyond[k] = max(beyond[k], p + 1)
        kids: list[list[int]] = [[] for _ in up]
        for k in sorted(range(1, len(up)), key=depth.__getitem__, reverse=True):
            u = up[k]
            low[u], high[u], beyond[u] = min(low[u], low[k]), max(high[u], high[k]), max(beyond[u], beyond[k])
            kids[u].append(k)
        parts, runs, kid_from, kid_to = [(k, 0) for k in kids[0]], [], [], []
        self.tops = len(parts)
        for k, a in parts:  # grows as it is read, so that what hangs below one part is in one piece
            z = min(depth[k], a + max(EDGE, a - start[k]))
            kid_from.append(len(parts))
            parts += [(k, z)] if z < depth[k] else [(x, z) for x in kids[k]]
            kid_to.append(len(parts))
            runs.append((k, a, z))
        self.runs = np.concatenate([coded[self.order[low_place[k]]][a:z] for k, a, z in runs]).astype(np.int64)
        self.run_at = np.cumsum([0, *(z - a for _, a, z in runs)])
        self.final = self.universe[self.runs[self.run_at[1:] - 1]]
        each = [(z, member[k] if z == depth[k] else -1, low[k], high[k], low_place[k], beyond[k]) for k, _, z in runs]
        self.depth, self.member, self.low, self.high, self.first, self.beyond = np.array(each).T
        self.kid_from, self.kid_to = np.array(kid_from), np.array(kid_to)

    def linked(self, s: np.ndarray, settled: np.ndarray) -> np.ndarray:
        """Places of the sets linked with s. A subtree is left if all its places are settled, or if even all remaining elements can't
        reach the threshold."""
        per, n = self.measure.per, len(s)
        up = 100 + per
        at = np.searchsorted(self.universe, s)
        at = at[self.universe[np.minimum(at, len(self.universe) - 1)] == s]
        self.has[at] = 1
        done = np.cumsum(np.r_[0, settled])
        node, overlap, out = np.arange(self.tops), np.zeros(self.tops, np.int64), []
        while len(node):
            a, z = self.first[node], self.beyond[node]
            some = done[z] - done[a] < z - a
            node, overlap = node[some], overlap[some]
            if not len(node):
                break
            begin = self.run_at[node]
            where, ahead = ragged(begin, self.run_at[node + 1] - begin)
            overlap = overlap + np.add.reduceat(self.has[self.runs[where]], ahead, dtype=np.int64)
            left = n - np.searchsorted(s, self.final[node], side="right")
            depth = self.depth[node]
            # of the sizes below, the one that leaves most room: as many more elements as the set still has
            size = np.minimum(np.maximum(depth + left, self.low[node]), self.high[node])
            good = up * (overlap + np.minimum(left, size - depth)) >= per * (n + size)
            node, overlap, depth = node[good], overlap[good], depth[good]
            member = self.member[node]
            out.append(member[(member >= 0) & (up * overlap >= per * (n + depth))])
            count = self.kid_to[node] - self.kid_from[node]
            node, overlap = ragged(self.kid_from[node], count)[0], np.repeat(overlap, count)
        self.has[at] = 0
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def meet(self, found: np.ndarray, label: int) -> Iterator[int]:
        """One of the places found for each component other than label, which all become that."""
        names, first = np.unique(self.label[found], return_index=True)
        for name, k in zip(names.tolist(), first.tolist(), strict=True):
            if name != label:
                self.label[self.label == name] = label
                yield self.order[found[k]]

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of sets that connect the components among the trie's own."""
        yield from ((self.order[p], self.order[q]) for p, q in self.twins)
        for p, i in enumerate(self.order):  # a set meets those after it
            label = int(self.label[p])
            settled = self.label == label
            settled[: p + 1] = True
            if not settled.all():
                found = self.linked(self.sets[i], settled)
                yield from ((i, j) for j in self.meet(found[found > p], label))

    def probed(self, probes: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        """Pairs of a probe and a set that connect components."""
        nothing = np.zeros(len(self.sets), bool)
        for k, s in enumerate(probes):
            yield from ((k, j) for j in self.meet(self.linked(s, nothing), len(self.sets) + k))


def ragged(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range one after another, and where each range's begin."""
    ahead = np.cumsum(length) - length
    return np.repeat(begin - ahead, length) + np.arange(int(length.sum())), ahead


_KINDS = [("kind", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("mark", pa.binary()), ("shard", pa.int32()), ("sign", pa.int64()), ("codes", pa.binary()), ("leads", pa.binary()), ("members", pa.list_(pa.int64()))]
DESCRIBED = "kind int, uid long, id long, h long, n long, mark binary, shard int, sign long, codes binary, leads binary, members array<long>"


def _rows(kind: int, **columns: list) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.record_batch([pa.array([kind] * size, t) if n == "kind" else pa.array(columns[n], t) if n in columns else pa.nulls(size, t) for n, t in _KINDS], names=[n for n, _ in _KINDS])


def popular_first(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and owners by code, owners that share most codes first, the smaller of equals; where each code begins, and the order.
    So the many variants of a text gather around few leads."""
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    edge = code[1:] != code[:-1]
    shared = ~(np.r_[True, edge] & np.r_[edge, True])
    who, at = np.unique(owner, return_inverse=True)
    fame = np.bincount(at[shared], minlength=len(who))
    some = np.flatnonzero(shared)
    turn = some[np.lexsort((owner[some], -fame[at[some]], code[some]))]
    owner[some], order[some] = owner[turn], order[turn]
    return code, owner, np.flatnonzero(np.r_[True, edge]), order


def _describe(width: int, measure: Measure, shards: int, gathered: int) -> Callable:
    """Rows (id, h, text) to the three kinds. A document's uid counts within its partition; what is read of this is a checkpoint,
    so that a uid names one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = uid = TaskContext.get().partitionId() << 33
        seen: set[bytes] = set()
        signs, owners, held = [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            code, owner = np.concatenate(signs) >> np.uint64(64 - SIGN_BITS), np.concatenate(owners)
            code, owner, first = popular_first(code, owner)[:3]
            count = np.diff(np.r_[first, len(code)])
            for k in range(0, len(many := np.flatnonzero(count > 1)), 20_000):
                some = many[k : k + 20_000]
                bounds = zip(first[some].tolist(), (first + count)[some].tolist(), strict=True)
                yield _rows(GROUP, sign=code[first[some]].astype(np.int64), uid=owner[first[some]], members=[np.unique(owner[a + 1 : z]) for a, z in bounds])
            code, lead = code[first], (owner[first] - base).astype(np.uint32) << np.uint32(1) | (count > 1)
            shard = (code * np.uint64(shards) >> np.uint64(SIGN_BITS)).astype(np.int32)
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            ranges = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
            yield _rows(SIGNS, uid=[base] * len(ranges), shard=shard[cut[:-1]], codes=[packed(code[a:z], True) for a, z in ranges], leads=[packed(lead[a:z]) for a, z in ranges])

        for b in batches:
            for a in range(0, b.num_rows, 200):
                ids, hs, texts = (c.slice(a, 200).to_pylist() for c in b.columns)
                sets = [shingle_set(t, width) for t in texts]
                marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                for k, (s, m) in enumerate(zip(sets, marks, strict=True)):
                    if len(s) and m not in seen:  # copies within a batch needn't sign again
                        seen.add(m)
                        signs.append(np.unique(measure.signatures(s)))
                        owners.append(np.full(len(signs[-1]), uid + k))
                        held += len(signs[-1])
                yield _rows(SET, uid=list(range(uid, uid + len(ids))), id=ids, h=hs, n=list(map(len, sets)), mark=marks)
                uid += len(ids)
                if held > gathered:
                    yield from sent()
                    seen.clear()
                    signs, owners, held = [], [], 0
        if held:
            yield from sent()
        _words.clear()  # the process goes on to other tasks

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, uid, codes, leads), sorted by shard, to pairs (node, lead), and with a sign where the node has a group of its
    batch behind it."""

    def pairs() -> Iterator[pa.RecordBatch]:
        code = np.concatenate([unpacked(c, np.uint64, True) for _, c, _ in held])
        raw = [unpacked(x, np.uint32) for _, _, x in held]
        lead = np.concatenate([base + (x >> 1).astype(np.int64) for (base, _, _), x in zip(held, raw, strict=True)])
        group = np.concatenate([(x & 1).astype(bool) for x in raw])
        code, lead, first, order = popular_first(code, lead)
        group = group[order]
        head = np.repeat(lead[first], np.diff(np.r_[first, len(code)]))
        other = head != lead
        each = np.unique(np.stack([lead[other], head[other]], 1), axis=0)
        yield pa.record_batch([pa.array(each[:, 0]), pa.array(each[:, 1]), pa.nulls(len(each), pa.int64())], names=["node", "lead", "sign"])
        more = other & group
        yield pa.record_batch([pa.array(lead[more]), pa.array(head[more]), pa.array(code[more].astype(np.int64))], names=["node", "lead", "sign"])

    now, held = None, []
    for b in batches:
        for shard, base, codes, leads in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if shard != now and held:
                yield from pairs()
                held = []
            now = shard
            held.append((base, codes, leads))
    if held:
        yield from pairs()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple[int, bool, bytes]]]]:
    """Rows (lead, block, probe, id, t), sorted by lead and block, by group."""
    now, held = None, []
    for b in batches:
        for lead, block, probe, i, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (lead, block) != now:
                if held:
                    yield now, held
                now, held = (lead, block), []
            held.append((i, probe, t))
    if held:
        yield now, held


def _linked(width: int, measure: Measure) -> Callable:
    """Links of each group; and, in groups without probes, which sets aren't connected with the lead (b is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int | None]] = []
        for (lead, _), rows in _groups(batches):
            stored, probes = ([(i, shingle_set(t, width)) for i, probe, t in rows if probe == which] for which in (False, True))
            if not stored:
                continue
            trie, name = Trie(measure, [s for _, s in stored]), [i for i, _ in stored]
            if probes:  # the block's own links are known
                out += [(lead, probes[k][0], name[j]) for k, j in trie.probed([s for _, s in probes]) if probes[k][0] != name[j]]
            else:
                out += [(lead, name[i], name[j]) for i, j in trie.links() if name[i] != name[j]]
                label = dict(zip(trie.order, trie.label.tolist(), strict=True))
                centre = {label[k] for k, i in enumerate(name) if i == lead}
                out += [(lead, i, None) for k, i in enumerate(name) if label[k] not in centre]
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["lead", "a", "b"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["lead", "a", "b"])

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, per: int = 90, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return _components(docs, id_col, text_col, width, per, block).drop("h")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, per: int, block: int) -> DataFrame:
    """And h, the hash of the document's text."""
    measure = Measure(per)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(docs).select(number(id_col).alias("id"), F.xxhash64(text).alias("h"), F.encode(text, "UTF-8").alias("t"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col)).cast("long")), F.lit(0))).first()[0]
    shards = int(total // SHARE + 16)
    found = saved(rows.mapInArrow(_describe(width, measure, shards, GATHERED), DESCRIBED))
    sized = found.filter(F.col("kind") == SET).select("uid", "id", "h", "n", "mark")
    # one node for each set: the document of the smallest uid; its name in the graph is that uid
    nodes = saved(sized.filter("n > 0").groupBy("mark").agg(F.min(F.struct("uid", "id", "h", "n")).alias("rep"), F.min("id").alias("least")).select("mark", F.col("rep.uid").alias("node"), "rep.id", "rep.h", "rep.n", "least"))
    signs = found.filter(F.col("kind") == SIGNS).select("shard", "uid", "codes", "leads")
    met = saved(signs.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_met, "node long, lead long, sign long"))
    # sets of one batch that share a signature: around the lead that its shard found, or else around their own
    group = found.filter(F.col("kind") == GROUP).select(F.col("sign").alias("s"), F.col("uid").alias("u"), F.explode("members").alias("node"))
    heads = met.filter("sign is not null").select("sign", F.col("node").alias("own"), "lead")
    group = group.join(heads, (F.col("s") == F.col("sign")) & (F.col("u") == F.col("own")), "left").select("node", F.coalesce("lead", "u").alias("lead"))
    families = met.filter("sign is null").select("node", "lead").union(group).distinct()
    # copies stand for one node
    same = sized.filter("n > 0").join(nodes.select(F.col("mark").alias("m"), F.col("node").alias("to")), F.col("mark") == F.col("m")).select("uid", "to")
    families = families.join(same, F.col("node") == F.col("uid")).select(F.col("to").alias("node"), "lead")
    families = families.join(same, F.col("lead") == F.col("uid")).select("node", F.col("to").alias("lead"))
    families = families.filter("node != lead").distinct().join(nodes.select("node", "n"), "node")
    families = saved(families)
    sizes = families.groupBy("lead").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    # saved, so that the join below is one of two plain exchanges, of which Spark splits a family's that is too large
    sizes = saved(sizes.select("lead", F.ceil(F.greatest(F.col("size") / block, F.col("elements") / BLOCK_SIZE)).cast("int").alias("blocks")))
    blocks = families.join(sizes, "lead")
    blocks = saved(blocks.select("lead", "node", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    centres = blocks.select("lead", "block", F.col("lead").alias("node")).distinct()
    members = blocks.select("lead", "block", "node").union(centres)
    # the texts of nodes with a family, by id and hash
    wanted = saved(blocks.select("node").union(blocks.select("lead")).distinct().join(nodes.select("node", F.col("id").alias("i"), F.col("h").alias("k")), "node"))
    texts = among(rows, F.xxhash64("id", "h"), wanted.select(F.xxhash64("i", "k").alias("key")), wanted.count())
    texts = texts.groupBy("id", "h").agg(F.first("t").alias("t"))

    def linked(group: DataFrame) -> DataFrame:
        """group: lead, block, node, probe. Groups are few rows and much work, so Spark doesn't choose the number of tasks by size."""
        tasks = min(TASKS, max(16, group.count() // block))
        met = group.join(wanted, "node").join(texts, (F.col("i") == F.col("id")) & (F.col("k") == F.col("h")))
        met = met.select("lead", "block", "probe", F.col("node").alias("id"), "t").repartition(tasks, "lead", "block").sortWithinPartitions("lead", "block")
        return met.mapInArrow(_linked(width, measure), "lead long, a long, b long")

    first = saved(linked(members.withColumn("probe", F.lit(False))))
    links = first.filter("b is not null").select("a", "b")
    # sets that their block didn't connect with the centre, against all other blocks of the family
    wide = blocks.filter("blocks > 1")
    loose = first.filter("b is null").select(F.col("lead").alias("l"), F.col("a").alias("node")).distinct()
    loose = wide.join(loose, (wide["lead"] == loose["l"]) & (wide["node"] == loose["node"])).select(wide["lead"], wide["node"], wide["block"].alias("own"), wide["blocks"])
    if loose.limit(1).count():
        # at most PROBES probes in a task: more are cut into slices, each with its own copy of the block
        slices = loose.groupBy("lead").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("slices"))
        loose = loose.join(slices, "lead").withColumn("slice", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
        code = F.col("block") * F.col("slices") + F.col("slice")
        probes = loose.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("block != own")
        probes = probes.select("lead", code.alias("block"), "node", F.lit(True).alias("probe"))
        stored = wide.join(slices, "lead").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        stored = stored.select("lead", code.alias("block"), "node", F.lit(False).alias("probe"))
        links = links.union(saved(linked(probes.union(stored))).filter("b is not null").select("a", "b"))
    joined = connected(links).select(F.col("node").alias("of"), "component")
    # the smallest id of each component, by sets first
    placed = nodes.select("mark", "least", "node").join(joined, F.col("node") == F.col("of"), "left").select("mark", "least", F.coalesce("component", "node").alias("c"))
    least = saved(placed.groupBy("c").agg(F.min("least").alias("component_id")).withColumnRenamed("c", "d"))  # so that the join can be split
    placed = placed.join(least, F.col("c") == F.col("d")).select(F.col("mark").alias("m"), "component_id")
    out = sized.join(placed, F.col("mark") == F.col("m"), "left")
    return out.select(original("id").alias("doc_id"), F.col("n").alias("n_shingles"), original(F.coalesce("component_id", "id")).alias("component_id"), "h")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, per: int = 90) -> DataFrame:
    """docs without those whose component has a smaller id; rows of one id and text stay or go together. Null and empty texts stay;
    columns of any name are kept; an empty table stays empty."""
    gone = _components(docs, id_col, text_col, width, per, BLOCK).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = gone.select(number("doc_id").alias("j"), F.col("h").alias("k")).distinct()
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), number(id_col).alias("i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    return row.join(gone, (F.col("i") == F.col("j")) & (F.col("h") == F.col("k")), "left_anti").select("row.*")
