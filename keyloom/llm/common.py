"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id takes part as the largest id there is.
NULL_ID = (1 << 63) - 1


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or a folder set on the context. In local mode only, where there is one machine, a
    session without either gets one of its own."""
    context = spark.sparkContext._jsc.sc()
    set_by_hand = context.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (set_by_hand.get() if set_by_hand.isDefined() else None)
    if named:
        return named
    if not context.isLocal():
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "keyloom_checkpoints")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


#: Rows and bytes of a batch sent to Python, where rows are long (texts, sets of shingles).
SMALL_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs run inside send few rows at a time to Python, so that the buffers of both sides stay small whatever the rows'
    length; the session's own settings come back afterwards. For work that ends inside, not for plans that are returned."""
    was = {k: spark.conf.get(k, None) for k in SMALL_BATCH}
    try:
        for k, v in SMALL_BATCH.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table hasn't."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame, alias: str | None = None) -> list[Column]:
    """All columns, whatever characters their names have."""
    return [F.col((f"{alias}." if alias else "") + "`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, hash_col: str, size: int) -> DataFrame:
    """About `size` rows chosen by their hash (a long), never more than twice as many: a threshold from the count of rows
    comes before the limit, so a task sends its share and not `size` rows of its own."""
    n = df.count()
    top = -(1 << 63) + (((1 << 64) - 1) * min(n, size + size // 2) // n if n else 0)
    return df.where(F.col(hash_col) <= F.lit(top)).orderBy(hash_col).limit(2 * size)


def text_bytes(col: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.encode(F.col(col) if isinstance(col, str) else col, "UTF-8"), F.lit(b""))


def total_bytes(df: DataFrame, col: str) -> int:
    """One scan of the text column; the sum sizes blocks and buckets."""
    return int(df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length or several as one compressed blob; unpack() needs the dtypes."""
    raw = b"".join(np.int64(len(a)).tobytes() for a in arrays) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, np.int64, 1)[0]), codec="zstd", asbytes=True)
    lens, at, out = np.frombuffer(raw, np.int64, len(dtypes)), 8 * len(dtypes), []
    for n, d in zip(lens, map(np.dtype, dtypes), strict=True):
        out.append(np.frombuffer(raw, d, int(n), at))
        at += int(n) * d.itemsize
    return out


def binary_column(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and the offsets of its rows, without copying a row at a time."""
    a = pa.concat_arrays([c.cast(pa.large_binary()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the places that the half-open intervals cover."""
    d = np.zeros(length + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
