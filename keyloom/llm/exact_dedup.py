"""Exact deduplication by a log-structured merge index of text digests.

Each task feeds (digest, id) entries into a memtable; a full memtable is flushed as a sorted run with a Bloom
filter, and runs are compacted into one, which keeps the smallest id and adds up the counts. What a task emits is
therefore pre-aggregated: a text held by a third of all rows leaves each task as one entry. The entries are dealt by
digest to shards of about SHARD rows, and each shard compacts its share the same way. Ids then meet the index in a join on the
digest; those of a digest with more than a thousandth of all rows are spread by salts. Every hit is verified by comparing bytes with
the row that stays: only texts of digests that occur twice are dealt for that.

Defined results: a null text counts as empty; a null id sorts after every other id; of repeated rows with one id and
one text exactly one is kept, by without_copies the one whose columns come first as JSON; an empty table gives an empty result;
other columns are ignored by exact_dedup and kept by without_copies, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, among, number, original, saved

#: Entries that a memtable holds before it is flushed, and runs that are left side by side before they are compacted.
MEMTABLE, FANOUT = 1 << 17, 8
#: Rows of one text up to which they aren't spread.
HOT = 1000
#: Rows whose digests a shard indexes.
SHARD = 1_000_000


class Bloom:
    """A Bloom filter over the first 16 bytes of a digest; two hashes give four probes, 10 bits a key."""

    def __init__(self, keys: np.ndarray):
        self.size = max(64, 1 << int(np.ceil(np.log2(10 * len(keys) + 1))))
        self.bits = np.zeros(self.size, dtype=bool)
        for probe in self._probes(keys):
            self.bits[probe] = True

    def _probes(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        halves = np.ascontiguousarray(keys).view("S32").view(np.uint64).reshape(-1, 4)
        with np.errstate(over="ignore"):
            for i in range(4):
                yield (halves[:, 0] + np.uint64(i) * (halves[:, 1] | np.uint64(1))) & np.uint64(self.size - 1)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        hit = np.ones(len(keys), dtype=bool)
        for probe in self._probes(keys):
            hit &= self.bits[probe]
        return hit


class Run:
    """Entries sorted by digest, each digest once."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.keys, self.ids, self.counts = keys, ids, counts
        self.filter = Bloom(keys)

    @classmethod
    def flush(cls, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Run:
        order = np.argsort(keys, kind="stable")
        keys, ids, counts = keys[order], ids[order], counts[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return cls(keys[first], np.minimum.reduceat(ids, first), np.add.reduceat(counts, first))

    def merge(self, other: Run) -> Run:
        """Compaction: only keys that pass the other run's filter are looked up; the rest are new for certain."""
        low, high = (self, other) if len(self.keys) <= len(other.keys) else (other, self)
        ids, counts, fresh = high.ids.copy(), high.counts.copy(), np.ones(len(low.keys), dtype=bool)
        probe = np.flatnonzero(high.filter.maybe(low.keys))
        at = np.searchsorted(high.keys, low.keys[probe])
        same = (at < len(high.keys)) & (high.keys[np.minimum(at, len(high.keys) - 1)] == low.keys[probe])
        probe, at = probe[same], at[same]
        ids[at] = np.minimum(ids[at], low.ids[probe])
        counts[at] += low.counts[probe]
        fresh[probe] = False
        place = np.searchsorted(high.keys, low.keys[fresh])
        return Run(*(np.insert(a, place, b[fresh]) for a, b in ((high.keys, low.keys), (ids, low.ids), (counts, low.counts))))


class MergeIndex:
    """Log-structured merge index: digest -> (smallest id, count)."""

    def __init__(self, memtable: int = MEMTABLE, fanout: int = FANOUT):
        self.memtable, self.fanout, self.held, self.rows, self.runs = memtable, fanout, [], 0, []

    def put(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((keys, ids, counts))
        self.rows += len(keys)
        if self.rows >= self.memtable:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            self.runs.append(Run.flush(*(np.concatenate(x) for x in zip(*self.held, strict=True))))
            self.held, self.rows = [], 0
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        while len(self.runs) > 1:
            self.runs.sort(key=lambda r: len(r.keys), reverse=True)
            small = self.runs.pop()
            self.runs.append(self.runs.pop().merge(small))

    def entries(self) -> Run | None:
        self.flush()
        self.compact()
        return self.runs[0] if self.runs else None


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = MergeIndex()
    for b in batches:
        if b.num_rows:
            keys = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="V32")
            index.put(keys.view("S32"), b.column(1).to_numpy(), b.column(2).to_numpy())
    if run := index.entries():
        raw = run.keys.tobytes()
        for a in range(0, len(run.keys), 1 << 16):
            z = min(a + (1 << 16), len(run.keys))
            yield pa.record_batch([pa.array([raw[32 * i : 32 * i + 32] for i in range(a, z)], pa.binary()), pa.array(run.ids[a:z]), pa.array(run.counts[a:z])], names=["digest", "keep", "n"])


def _judged(docs: DataFrame, id_col: str, text_col: str, digest_bits: int = 256) -> DataFrame:
    """For each id and text: id, sha (of the normalised text), copies (rows), keep and n, the smallest id and the rows of its group."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    rows = docs.select(number(id_col).alias("id"), text.alias("t")).select("id", "t", F.unhex(F.sha2("t", 256)).alias("sha"))
    if digest_bits < 256:
        rows = rows.withColumn("digest", F.unhex(F.rpad(F.substring(F.hex("sha"), 1, digest_bits // 4), 64, "0")))
    else:
        rows = rows.withColumn("digest", F.col("sha"))
    pairs = saved(rows.groupBy("id", "sha", "digest").agg(F.count("*").alias("copies")))
    entries = pairs.select("digest", "id", F.col("copies").alias("n"))
    schema = "digest binary, keep long, n long"
    shards = pairs.count() // SHARD + 16
    index = saved(entries.mapInArrow(_indexed, schema).repartition(shards, "digest").mapInArrow(_indexed, schema).withColumnRenamed("digest", "key"))
    # digests of more than a thousandth of all rows, of which there are less than a thousand, spread over several salts
    rows_all, twice = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    share = max(HOT, rows_all // 1000)
    salts = F.ceil(F.col("n") / share).cast("int")
    hot = F.broadcast(index.filter(F.col("n") > share).select(F.col("key").alias("hot"), salts.alias("salts")))
    spread = index.withColumn("of", F.explode(F.sequence(F.lit(0), salts - 1)))

    def met(some: DataFrame, index: DataFrame) -> DataFrame:
        some = some.join(hot, F.col("digest") == F.col("hot"), "left")
        some = some.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int")).drop("hot")
        return some.join(index, (F.col("digest") == F.col("key")) & (F.col("salt") == F.col("of"))).drop("key", "of")

    found = met(pairs, spread).select("id", "sha", "copies", "keep", "n")
    # groups of two or more need bytes; the row that stays goes to every salt of its digest
    texts = among(rows, F.xxhash64("digest"), index.filter("n > 1").select(F.xxhash64("key").alias("k")), twice)
    texts = met(texts, spread.filter("n > 1"))
    stay = texts.filter(F.col("id") == F.col("keep"))
    stay = stay.select(F.col("digest").alias("key"), F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("of"), F.col("t").alias("kept_t"), F.col("sha").alias("kept_sha"))
    stay = stay.groupBy("key", "of").agg(F.min_by("kept_t", "kept_sha").alias("kept_t"))
    hits = texts.join(stay, (F.col("digest") == F.col("key")) & (F.col("salt") == F.col("of")), "left")
    other = saved(hits.filter(~F.col("t").eqNullSafe(F.col("kept_t"))).select(F.col("id").alias("i"), F.col("sha").alias("s")).distinct())
    if other.limit(1).count():  # another text under the same digest
        found = found.join(other, (F.col("id") == F.col("i")) & (F.col("sha") == F.col("s")), "left")
        alone = F.col("i").isNotNull()
        found = found.select("id", "sha", "copies", F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n")).alias("n"))
    return found


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bits: int = 256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    digest_bits below 256 shortens the index's key (the rest is zero), so that tests can see byte verification part
    texts whose keys collide; a text that fails verification forms a group of its own.
    """
    found = _judged(docs, id_col, text_col, digest_bits)
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return found.select("*", copy).select(
        original("id").alias("doc_id"),
        original("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("id") == F.col("keep")) & (F.col("copy") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    kept = saved(_judged(docs, id_col, text_col).filter(F.col("id") == F.col("keep")).select("id", "sha", "copies"))
    row = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), number(id_col).alias("i"), F.unhex(F.sha2(text, 256)).alias("s"))
    left = row.join(kept, (F.col("i") == F.col("id")) & (F.col("s") == F.col("sha")))
    if kept.filter("copies > 1").limit(1).count():
        once = left.filter("copies > 1").groupBy("i", "s").agg(F.min_by("row", F.to_json("row")).alias("row"))
        return left.filter("copies = 1").select("row.*").unionByName(once.select("row.*"))
    return left.select("row.*")
