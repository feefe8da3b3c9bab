"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null document id: greater than every other id.
NO_ID = (1 << 63) - 1
#: Bits of the largest table of among(): 32 MB.
BITS = 1 << 28


def checkpoint_ready(spark: SparkSession) -> None:
    """Make sure that checkpoint() has a folder: the cluster's own, or one in the shared warehouse where none is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    sc.setCheckpointDir(folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(df: DataFrame) -> DataFrame:
    """Let Spark hand rows to Python in batches of 1,000 unless the session says otherwise: whole texts in batches of the default
    10,000 take tens of megabytes several times over, in Arrow's buffers of the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == "10000":
        df.sparkSession.conf.set(key, "1000")
    return df


def number(column: str | Column) -> Column:
    """A document id as long, nulls last."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def original(column: str | Column) -> Column:
    """Undo number()."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column == NO_ID, F.lit(None).cast("long")).otherwise(column)


def bucket_of(id_col: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id has the remainder 0."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def ascii_lower(column: str | Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def packed(a: np.ndarray, delta: bool = False) -> bytes:
    """Numbers (or the steps between them) by planes: first all lowest bytes, then all second bytes, and so on, compressed."""
    a = np.diff(a, prepend=a.dtype.type(0)) if delta else a
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(raw: bytes, dtype, delta: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    a = np.ascontiguousarray(planes.T).view(dtype).ravel()
    return np.cumsum(a, dtype=dtype) if delta else a


def among(rows: DataFrame, key: Column, wanted: DataFrame, count: int) -> DataFrame:
    """rows whose key (a hash, long) may be among those of wanted, a frame of one column of count keys: a table of bits tells,
    broadcast, of BITS at most. Some other rows pass too, and the more the fuller the table, so a join must follow; but rows
    that nobody wants aren't dealt for it."""
    bits = min(BITS, 1 << max(15, (16 * count).bit_length()))
    place = lambda c: F.pmod(c, F.lit(bits))
    row, bit = lambda c: F.floor(place(c) / 32768).cast("int"), lambda c: place(c) % 32768
    name = wanted.columns[0]
    table = wanted.select(row(F.col(name)).alias("__row"), bit(F.col(name)).alias("__bit")).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    met = rows.withColumn("__key", key).join(F.broadcast(table), row(F.col("__key")) == F.col("__row"))
    at = bit(F.col("__key"))
    byte = F.conv(F.hex(F.substr("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return met.filter(F.call_function("getbit", byte, (at % 8).cast("int")) == 1).select(*rows.columns)
