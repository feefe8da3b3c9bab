"""Removal of repeated strings by suffix arrays.

A byte goes when a string of `length` bytes that covers it also starts in a document of smaller id. A suffix array of all
texts can't be built in one place, so strings are dealt by content first: every window of `length` bytes belongs to the
smallest hash of the k-grams within it, and a run of windows with one such minimizer, a segment, goes to that minimizer's
bucket as one piece of text. Equal windows have equal minimizers, so all occurrences of a string meet in one bucket.

In each bucket, a segment that a smaller id holds as a whole goes as a whole. Of the others, those that hold a window hash seen
twice are put together and their suffixes sorted by the two-stage method: suffixes smaller than their successors are sorted directly, in rounds of eight bytes among those still tied; the rest
are induced by one scan over the buckets of first bytes. Common prefixes of neighbours in the array are then computed, and runs
of `length` or more bytes in common give each string's smallest document.

A minimizer that many different neighbourhoods share would make its bucket large. So buckets are measured first; of one
that would hold more than CROWDED times BUCKET, every window is a segment of its own and goes to one of many buckets by its own
hash. Equal windows still meet, and no bucket grows with a common k-gram.

A text's exact copies are settled before: only the smallest id of equal texts sends segments, the others lose all windows.
A segment that several documents of one batch hold is sent once, for the smallest id; for the others it is settled there. So
neither copies nor a passage that many documents share heap up in a bucket; each batch adds one segment at most. Segments
travel compressed. Buckets are as many as keep each at about BUCKET bytes.

Defined results: a null text counts as empty; texts shorter than length lose nothing; a null id is greater than all others;
rows of one id never take strings from each other, and repeated rows get equal results; an empty table gives an empty
result; other columns are ignored. Rows meet by id, and of ids with several texts (null ids, say) by the text's hash too, so that
no id gathers many texts in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number, original, saved, small_batches

LENGTH, BUCKET, BATCH, LEVEL = 50, 6_000_000, 6_000_000, 5
#: Times BUCKET that a bucket may hold before its windows are dealt once more.
CROWDED = 2
#: Segments that a task holds before it sends them.
PIECES = 400_000
#: Ids with several texts that are broadcast; more meet the texts in a join.
SEVERAL = 500_000
_MULS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes at each place, from hashes of 1, 2, 4, ... bytes."""
    level, n, size = [(raw.astype(np.uint64) + np.uint64(1)) * _MULS[0]], 1, len(raw)
    while n * 2 <= k:
        h = level[-1]
        level.append(h[:-n] * _MULS[len(level) % 7])
        level[-1] += h[n:]
        n *= 2
    out, done = level[-1][: size - k + 1], n
    for i in range(len(level) - 2, -1, -1):
        if k - done >= 1 << i:
            out = out * _MULS[3]
            out += level[i][done : done + size - k + 1]
            done += 1 << i
    out = out ^ (out >> np.uint64(32))
    out *= _MULS[5]
    out ^= out >> np.uint64(29)
    return out


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    n, m, size = 1, h, len(h) - w + 1
    while n * 2 <= w:
        m = np.minimum(m[:-n], m[n:])
        n *= 2
    return np.minimum(m[:size], m[w - n : w - n + size])


def stable_order(values: np.ndarray) -> np.ndarray:
    """A stable sort of whole numbers from 0, by digits of 16 bits, for which numpy counts instead of comparing."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    most, shift = int(values.max(initial=0)) >> 16, 16
    while most:
        order = order[np.argsort((values[order] >> shift & 0xFFFF).astype(np.uint16), kind="stable")]
        most, shift = most >> 16, shift + 16
    return order


def two_stage_sort(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of text in the order of their suffixes, right to depth bytes at least; and each place's eight bytes as a number."""
    n = len(text)
    wide = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    wide = wide[:-1] << np.uint64(8) | wide[1:]
    wide = wide[:-2] << np.uint64(16) | wide[2:]
    eight = wide[:-4] << np.uint64(32) | wide[4:]
    # which suffixes are smaller than their successors: the next unequal byte is greater
    step = np.sign(np.diff(text.astype(np.int16), append=-1)).astype(np.int8)
    change = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    smaller = step[np.minimum.accumulate(change[::-1])[::-1]] > 0
    del step, change
    # first stage: sort these directly
    place = np.flatnonzero(smaller).astype(np.int32)
    place = place[np.argsort(eight[place])]
    group = np.cumsum(np.r_[False, eight[place][1:] != eight[place][:-1]], dtype=np.int32) if len(place) else place
    for done in range(8, depth, 8):
        tied = np.zeros(len(place), dtype=bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        some, key = place[at], eight[place[at] + done]
        order = np.argsort(key)
        order = order[stable_order(group[at][order])]
        place[at] = some[order]
        key = key[order]
        new = np.ones(len(place), dtype=bool)
        new[1:] = group[1:] != group[:-1]
        new[at[1:]] |= key[1:] != key[:-1]
        group = np.cumsum(new, dtype=np.int32)
    first = text[place]
    ends = np.searchsorted(first, np.arange(257))
    # second stage: in the order of the array, the suffix before a sorted one takes the next place in its own bucket
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1], np.int32))
    out: list[np.ndarray] = []
    for c in range(256):
        part = waiting[c]
        wave = np.concatenate(part) if part else np.zeros(0, np.int32)
        while len(wave):  # runs of c
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            if len(wave):
                part.append(wave)
        here = np.concatenate([*part, place[ends[c] : ends[c + 1]]]) if part else place[ends[c] : ends[c + 1]]
        waiting[c] = []
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(byte[1:] != byte[:-1]) + 1
        for some in np.split(before, cuts):
            if len(some):
                waiting[text[some[0]]].append(some)
    return np.concatenate(out), eight


def common_prefixes(order: np.ndarray, eight: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place of order has in common with the one before, up to depth rounded up to eights."""
    out = np.zeros(len(order), dtype=np.int64)
    at = np.arange(1, len(order))
    for done in range(0, depth, 8):
        a, b = eight[order[at - 1] + done], eight[order[at] + done]
        odd = a ^ b
        same = odd == 0
        lead = np.zeros(len(at), dtype=np.int64)
        for bits in (56, 48, 40, 32, 24, 16, 8):
            lead += odd < np.uint64(1 << bits)
        out[at] += np.where(same, 8, lead)
        at = at[same]
    return out


def _repeating(data: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which of these places, in ascending order, begin windows whose hash occurs at two of them or more."""
    step, h = 1 << 16, np.empty(len(place), np.uint64)
    cuts = np.searchsorted(place, np.arange(0, len(data) + step, step))
    for k, a in enumerate(range(0, len(data), step)):  # parts that fit the processor's cache
        x, y = cuts[k], cuts[k + 1]
        if x < y:
            h[x:y] = gram_hashes(data[a : a + step + length - 1], length)[place[x:y] - a]
    ranked = np.sort(h)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    # most others leave by a table of 22 bits of the hash; a search decides on the rest
    table = np.zeros(1 << 22, bool)
    table[twice >> np.uint64(42)] = True
    maybe = np.flatnonzero(table[h >> np.uint64(42)])
    h = h[maybe]
    return maybe[twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h]


def repeated(data: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data: segments one after the other, of these sizes and owners (ids). What also starts in a smaller owner: (segment, from,
    to) of each window, or of a whole segment that a smaller owner holds as it is."""
    ends = np.cumsum(size)
    begin = ends - size
    # whole segments first: the smallest owner's stays in the search, and others of that owner
    raw, first, gone = data.tobytes(), {}, []
    order = np.argsort(owner, kind="stable")
    for k, who, a, z in zip(order.tolist(), owner[order].tolist(), begin[order].tolist(), ends[order].tolist(), strict=True):
        if first.setdefault(raw[a:z], who) < who:
            gone.append(k)
    del first
    count = np.maximum(size - length + 1, 0)
    whole = np.array(gone, dtype=np.int64)
    count[whole] = 0
    out = whole, np.zeros(len(whole), np.int64), size[whole]
    if not count.sum():
        return out
    before = np.cumsum(count) - count
    place = np.arange(count.sum(), dtype=np.int32)
    place += np.repeat((begin - before).astype(np.int32), count)
    # only windows whose hash occurs twice can repeat
    place = place[_repeating(data, place, length)].astype(np.int64)
    if not len(place):
        return out
    segment = np.searchsorted(begin, place, side="right") - 1
    offset = place - begin[segment]
    # of each segment, from its first to its last such window
    cut = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    kept, low = segment[cut], offset[cut]
    long = offset[np.r_[cut[1:], len(segment)] - 1] + length - low
    total = np.cumsum(long)
    text = data[np.arange(total[-1]) - np.repeat(total - long - begin[kept] - low, long)]
    within = np.repeat(np.arange(len(kept)), np.diff(np.r_[cut, len(segment)]))
    spot = (total - long)[within] + offset - low[within]
    order, eight = two_stage_sort(text, length)
    back = np.full(len(text), -1, dtype=np.int32)
    back[spot] = np.arange(len(spot), dtype=np.int32)
    order = order[back[order] >= 0]
    run = np.flatnonzero(np.r_[True, common_prefixes(order, eight, length)[1:] < length])
    at = back[order]
    who = owner[segment[at]]
    least = np.repeat(np.minimum.reduceat(who, run), np.diff(np.r_[run, len(who)]))
    at = at[who > least]
    return tuple(np.concatenate(x) for x in zip(out, (segment[at], offset[at], offset[at] + length), strict=True))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals, which touch or overlap."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    cut = np.flatnonzero(new)
    return start[cut], end[np.r_[cut[1:], len(end)] - 1]


def segments(text: bytes, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A text's segments: minimizer, bucket, start and end of each."""
    k = max(1, length // 4)
    least = window_least(gram_hashes(np.frombuffer(text, np.uint8), k), length - k + 1)
    cut = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    return least[cut], (least[cut] % np.uint64(buckets)).astype(np.int64), cut, np.r_[cut[1:], len(least)] + length - 1


def _documents(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Documents (id, rank, text) in batches of about BATCH bytes, without copies (rank 0) and short texts."""
    unpack = zstandard.ZstdDecompressor()
    held, size = [], 0
    for b in batches:
        for i, rank, z in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if rank and len(text := unpack.decompress(z)) >= length:
                held.append((i, rank, text))
                size += len(text)
                if size >= BATCH:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _sizes(length: int, buckets: int) -> Callable:
    """Bytes that each bucket gets at most, segments that a batch holds several times counted once. Copies are still in, so this
    needs no join; a bucket that only they fill is dealt once more for nothing, which costs time but changes no result."""
    factors = np.random.default_rng(5).integers(1, 1 << 62, length).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def measured(texts: list[bytes]) -> pa.RecordBatch:
        parts = []
        for text in texts:
            least, home, start, end = segments(text, length, buckets)
            head = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), length)[start]
            parts.append((least ^ (head * factors).sum(axis=1), home, end - start))
        name, home, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        once = np.unique(name, return_index=True)[1]
        found, at = np.unique(home[once], return_inverse=True)
        return pa.record_batch([pa.array(found), pa.array(np.bincount(at, size[once]).astype(np.int64))], names=["bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                if len(text) >= length:
                    held.append(text)
                    size += len(text)
                    if size >= BATCH:
                        yield measured(held)
                        held, size = [], 0
        if held:
            yield measured(held)

    return run


def _send(length: int, buckets: int, wide: dict[int, tuple[int, int]]) -> Callable:
    """Documents (id, salt, rank, z) to blobs of segments by bucket. Rank 0: a copy, which sends none. wide: of buckets that would
    grow too large, the first and the number of those that take its windows one by one, by the windows' own hash."""
    crowded = np.array(sorted(wide), np.int64)

    def blobs(docs: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, bytes]]:
        docs.sort(key=lambda d: d[:2])
        first: dict[bytes, int] = {}
        pieces, sizes, starts, homes, owners, done = [], [], [], [], [], bytearray()
        for d, (i, _, text) in enumerate(docs):
            _, home, cut, end = segments(text, length, buckets)
            if len(crowded) and (apart := np.isin(home, crowded)).any():
                own = gram_hashes(np.frombuffer(text, np.uint8), length)
                at = np.concatenate([np.arange(x, y - length + 1) for x, y in zip(cut[apart].tolist(), end[apart].tolist(), strict=True)])
                base, many = np.array([wide[b] for b in home[apart].tolist()]).T
                n = end[apart] - cut[apart] - length + 1
                to = np.repeat(base, n) + (own[at] % np.repeat(many, n).astype(np.uint64)).astype(np.int64)
                home, cut, end = np.r_[home[~apart], to], np.r_[cut[~apart], at], np.r_[end[~apart], at + length]
            homes.append(home)
            starts.append(cut.astype(np.int32))
            sizes.append((end - cut).astype(np.int32))
            owners.append(np.full(len(cut), d, np.int32))
            for x, y in zip(cut.tolist(), end.tolist(), strict=True):
                piece = text[x:y]
                # settled here: a smaller id of this batch holds the whole segment
                settled = first.setdefault(piece, i) < i
                done.append(settled)
                pieces.append(b"" if settled else piece)
            if len(pieces) > PIECES:
                yield from packed(docs, pieces, sizes, starts, homes, owners, done)
                first.clear()
                pieces, sizes, starts, homes, owners, done = [], [], [], [], [], bytearray()
        if homes:
            first.clear()
            yield from packed(docs, pieces, sizes, starts, homes, owners, done)

    def packed(docs: list[tuple[int, int, bytes]], pieces: list[bytes], sizes: list, starts: list, homes: list, owners: list, done: bytearray) -> Iterator[tuple[int, bytes]]:
        home = np.concatenate(homes)
        order = np.argsort(home, kind="stable")
        size = np.concatenate(sizes)
        size = np.where(np.frombuffer(done, bool), -size, size)[order]
        home, start, owner = home[order], np.concatenate(starts)[order], np.concatenate(owners)[order]
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for some in np.split(np.arange(len(home)), np.flatnonzero(home[1:] != home[:-1]) + 1):
            who, at = np.unique(owner[some], return_inverse=True)
            ids = np.array([docs[d][0] for d in who], np.int64)
            ranks = np.array([docs[d][1] for d in who], np.int64)
            head = np.array([len(who), len(some)], np.int32)
            turn = np.diff(at, prepend=0).astype(np.int32)
            body = b"".join(x.tobytes() for x in (head, np.diff(ids, prepend=0), ranks, turn, start[some], size[some])) + b"".join([pieces[order[i]] for i in some])
            yield int(home[some[0]]), pack.compress(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in _documents(batches, length):
            found = list(blobs(docs))
            yield pa.record_batch([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])

    return run


def _receive(length: int) -> Callable:
    """Blobs, sorted by bucket, to removed runs: id, rank, spans (start, end, start, end, ...)."""

    def solve(blobs: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        unpack = zstandard.ZstdDecompressor()
        ids, ranks, starts, sizes, data = [], [], [], [], []
        for blob in blobs:
            raw = unpack.decompress(blob)
            docs, n = np.frombuffer(raw, np.int32, 2)
            spot = 8
            cols = []
            for kind, count in ((np.int64, docs), (np.int64, docs), (np.int32, n), (np.int32, n), (np.int32, n)):
                cols.append(np.frombuffer(raw, kind, count, spot))
                spot += cols[-1].nbytes
            at = np.cumsum(cols[2])
            ids.append(np.cumsum(cols[0])[at])
            ranks.append(cols[1][at])
            starts.append(cols[3])
            sizes.append(cols[4])
            data.append(np.frombuffer(raw, np.uint8, offset=spot))
        ids, ranks, starts, sizes, data = (np.concatenate(x) for x in (ids, ranks, starts, sizes, data))
        done = sizes < 0
        live = np.flatnonzero(~done)
        segment, start, end = repeated(data, sizes[live].astype(np.int64), ids[live], length)
        which = np.r_[np.flatnonzero(done), live[segment]]
        low = np.r_[starts[done], starts[live[segment]] + start].astype(np.int64)
        high = np.r_[starts[done] - sizes[done], starts[live[segment]] + end].astype(np.int64)
        if not len(which):
            return
        order = np.lexsort((low, ranks[which], ids[which]))
        which, low, high = which[order], low[order], high[order]
        i, r = ids[which], ranks[which]
        cuts = np.flatnonzero((i[1:] != i[:-1]) | (r[1:] != r[:-1])) + 1
        # maximal runs of all documents at once: a new one where a document begins or a gap lies before
        reach = high.copy()
        base = np.zeros(len(low), np.int64)
        base[cuts] = 1
        shift = np.cumsum(base) << np.int64(33)
        reach = np.maximum.accumulate(reach + shift)
        new = np.r_[True, (low + shift)[1:] > reach[:-1]]
        a = np.flatnonzero(new)
        z = np.r_[a[1:], len(low)] - 1
        spans = np.stack([low[a], reach[z] - shift[z]], axis=1).ravel().tolist()
        bounds = np.searchsorted(a, np.r_[0, cuts, len(low)])
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield int(i[a[x]]), int(r[a[x]]), spans[2 * x : 2 * y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, found = None, [], []

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.int32()))], names=["id", "rank", "spans"])

        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    found += solve(blobs)
                    blobs = []
                    if len(found) > 20_000:
                        yield out()
                        found = []
                now = bucket
                blobs.append(blob)
        if blobs:
            found += solve(blobs)
        if found:
            yield out()

    return run


def _cut(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for i, rank, z, found in zip(*(b.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                text = unpack.decompress(z)
                spans = [x for f in found or [] for x in f]
                if not rank:
                    spans = [0, len(text)] if len(text) >= length else []
                if spans:
                    low, high = merged(np.array(spans[::2], np.int64), np.array(spans[1::2], np.int64))
                    low, high = low.tolist(), high.tolist()
                else:
                    low, high = [], []
                kept = b"".join(text[x:y] for x, y in zip([0, *high], [*low, len(text)], strict=True)) if low else text
                rows.append((i, len(text), [{"start": x, "end": y} for x, y in zip(low, high, strict=True)], kept))
                if len(kept) > 4_000_000 or len(rows) >= 500:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_bytes", "spans", "kept"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array([pack.compress(t) for t in b.column(2).to_pylist()], pa.binary())], names=["id", "h", "z"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (maximal removed runs of bytes: start, end) and kept (the other bytes)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = small_batches(docs).select(number(id_col).alias("id"), text.alias("t"))
    sha = F.sha2("t", 256)
    code = lambda c: F.xxhash64(c).bitwiseOR(F.lit(2))  # noqa: E731  neither 0 nor 1, which are salts and ranks of their own
    # of equal texts the smallest id
    first = rows.select("id", sha.alias("sha"), F.octet_length("t").alias("n")).groupBy("sha").agg(F.min("id").alias("own"), F.max("n").alias("n"))
    first = saved(first.select("own", code("sha").alias("k"), "n"))
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(16, 3 * total // BUCKET + 1)
    # a text is known by its id and 0, or by its id and hash where the id has several such texts
    several = saved(first.groupBy("own").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.col("own").alias("many")))
    several = F.broadcast(several) if several.count() <= SEVERAL else several
    salted = lambda df, i, h: df.join(several, F.col(i) == F.col("many"), "left").withColumn("salt", F.when(F.col("many").isNull(), F.lit(0)).otherwise(F.col(h))).drop("many")
    heads = salted(first, "own", "k").select("own", "k", F.col("salt").alias("own_salt"))
    packed = rows.select("id", code(sha).alias("h"), F.encode("t", "UTF-8").alias("t")).mapInArrow(_packed, "id long, h long, z binary")
    # this join deals the texts, once: Spark reuses that exchange for the join at the end
    ranked = salted(packed, "id", "h").join(heads.hint("merge"), (F.col("id") == F.col("own")) & (F.col("salt") == F.col("own_salt")), "left")
    rank = F.when(F.col("h") == F.col("k"), F.when(F.col("salt") == 0, F.lit(1)).otherwise(F.col("salt"))).otherwise(F.lit(0))
    ranked = ranked.select("id", "salt", rank.cast("long").alias("rank"), "z")
    # minimizers that many different neighbourhoods share: their buckets' windows are dealt once more, by their own hash
    sizes = rows.select(F.encode("t", "UTF-8").alias("t")).mapInArrow(_sizes(length, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    wide, next_ = {}, buckets
    for b, n in sorted(tuple(r) for r in sizes.filter(F.col("n") > CROWDED * BUCKET).collect()):
        wide[b] = (next_, length * n // BUCKET + 1)
        next_ += wide[b][1]
    blobs = ranked.mapInArrow(_send(length, buckets, wide), "bucket long, blob binary")
    spans = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_receive(length), "id long, rank long, spans array<int>")
    spans = spans.select(F.col("id").alias("of"), F.when(F.col("rank") == 1, F.lit(0)).otherwise(F.col("rank")).alias("of_salt"), "spans").groupBy("of", "of_salt").agg(F.collect_list("spans").alias("found"))
    met = ranked.join(spans.hint("merge"), (F.col("id") == F.col("of")) & (F.col("salt") == F.col("of_salt")), "left").select("id", "salt", "rank", "z", "found")
    out = met.mapInArrow(_cut(length), "id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select(original("id").alias("doc_id"), "n_bytes", "spans", "kept")
