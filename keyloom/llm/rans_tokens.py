"""Token ids as binary files, coded by a static range asymmetric numeral system (rANS).

A segment holds the ids of whole documents, about SEGMENT of them, in ascending doc_id order:

  magic and counts | frequency table, shared by the segment's blocks | documents (id, number of ids) |
  checkpoint of each block (where its words begin, state of each lane, checksum of its ids) | words | checksum

A block is BLOCK ids dealt to LANES interleaved states of 32 bits; words of 16 bits are taken in by whichever lane runs
low, in order. Blocks depend on nothing but the table, so any one can be decoded alone, and all are decoded side by side
here, one array operation for a step of every lane of every block.

Segments are written by Spark, as the rows of a table in the shared folder (Spark has no sink for raw bytes, and only its
writers commit tasks safely); a file is the range of doc_ids that one task holds.

Defined cases: null text counts as empty, its document is just the end id; rows that share an id follow each other, by
text; null ids come last; an empty table gives no file and an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, shared_folder, total_bytes
from .tokens import encode, vocabulary

LANES, BLOCK, SEGMENT = 32, 1 << 14, 1 << 21
#: Bits of a probability; every id that occurs gets at least one unit.
BITS = 16
FILE_BYTES = 16 << 20
MAGIC = b"KLRANS1\n"
_HEAD = struct.Struct("<8sQQQQQ")


class Corrupt(ValueError):
    """A checksum doesn't hold."""


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and their shares of 2**BITS, at least one each."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << BITS
    if len(symbols) > total:
        raise ValueError("more distinct ids than units of probability")
    share = np.maximum(1, counts * total // counts.sum())
    order = np.argsort(-counts, kind="stable")
    short = total - int(share.sum())
    share[order[0]] += max(short, 0)
    while short < 0:  # the units that minima took come from the most frequent
        take = np.minimum(share - 1, -(short * share // share.sum()) + 1)
        take = take[order]
        take = np.minimum(take, np.maximum(0, -short - (np.cumsum(take) - take)))
        share[order] -= take
        short += int(take.sum())
    return symbols.astype(np.uint32), share.astype(np.uint32)


def encode_segment(docs: list[tuple[int, np.ndarray]]) -> bytes:
    ids = np.concatenate([a for _, a in docs]).astype(np.uint32)
    n = len(ids)
    symbols, share = frequencies(ids)
    start = np.concatenate(([0], np.cumsum(share[:-1], dtype=np.uint64))).astype(np.uint64)
    freq = share.astype(np.uint64)
    blocks, steps = -(-n // BLOCK), BLOCK // LANES
    code = np.zeros(blocks * BLOCK, np.uint32)
    place = np.zeros(int(symbols[-1]) + 1, np.uint32)
    place[symbols] = np.arange(len(symbols), dtype=np.uint32)
    code[:n] = place[ids]
    code = code.reshape(blocks, steps, LANES)
    real = (np.arange(blocks * BLOCK) < n).reshape(blocks, steps, LANES)
    x = np.full((blocks, LANES), 1 << 16, np.uint64)
    out, given = np.zeros((steps, blocks, LANES), np.uint16), np.zeros((steps, blocks, LANES), bool)
    low, sixteen = np.uint64(0xFFFF), np.uint64(16)
    for t in range(steps - 1, -1, -1):
        f, c, on = freq[code[:, t]], start[code[:, t]], real[:, t]
        spill = (x >= f << sixteen) & on
        out[t], given[t] = x & low, spill
        y = np.where(spill, x >> sixteen, x)
        q = y // f
        x = np.where(on, (q << np.uint64(BITS)) + (y - q * f) + c, x)
    words = [out[:, b][given[:, b]] for b in range(blocks)]
    at = np.cumsum([0, *(len(w) for w in words)])
    sums = [zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK]) for b in range(blocks)]
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).tobytes() + share.tobytes(), 1)
    listed = zlib.compress(np.array([d for d, _ in docs], "<i8").tobytes() + np.array([len(a) for _, a in docs], "<i8").tobytes(), 1)
    body = b"".join((_HEAD.pack(MAGIC, n, len(docs), len(symbols), len(table), len(listed)), table, listed, at.astype("<u8").tobytes(), x.astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(), *(w.astype("<u2").tobytes() for w in words)))
    return body + struct.pack("<I", zlib.crc32(body))


def decode_segment(data: bytes, only: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their numbers of ids, and the ids (of all blocks, or of those asked for)."""
    if len(data) < _HEAD.size + 4 or zlib.crc32(memoryview(data)[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise Corrupt("segment")
    magic, n, docs, distinct, table_size, list_size = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise Corrupt("magic")
    p = _HEAD.size
    table = zlib.decompress(data[p : p + table_size])
    symbols = np.cumsum(np.frombuffer(table, "<u4", distinct), dtype=np.uint32)
    freq = np.frombuffer(table, "<u4", distinct, 4 * distinct).astype(np.uint64)
    p += table_size
    listed = np.frombuffer(zlib.decompress(data[p : p + list_size]), "<i8")
    p += list_size
    blocks, steps = -(-n // BLOCK), BLOCK // LANES
    at = np.frombuffer(data, "<u8", blocks + 1, p).astype(np.int64)
    p += 8 * (blocks + 1)
    x = np.frombuffer(data, "<u4", blocks * LANES, p).reshape(blocks, LANES).astype(np.uint64)
    p += 4 * blocks * LANES
    sums = np.frombuffer(data, "<u4", blocks, p)
    p += 4 * blocks
    words = np.append(np.frombuffer(data, "<u2", int(at[-1]), p), np.uint16(0)).astype(np.uint64)
    asked = np.arange(blocks) if only is None else np.array(only)
    x, at = x[asked], at[asked]
    start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
    slot = np.repeat(np.arange(distinct), freq.astype(np.int64))
    code = np.zeros((len(asked), steps, LANES), np.int64)
    left = np.clip(n - asked * BLOCK, 0, BLOCK)
    lane = np.arange(LANES)
    low, sixteen = np.uint64(0xFFFF), np.uint64(16)
    for t in range(steps):
        on = t * LANES + lane < left[:, None]
        u = x & low
        s = slot[u.astype(np.int64)]
        code[:, t] = s
        y = freq[s] * (x >> np.uint64(BITS)) + u - start[s]
        need = (y < 1 << 16) & on
        place = at[:, None] + np.cumsum(need, axis=1) - 1
        y = np.where(need, y << sixteen | words[np.where(need, place, 0)], y)
        at = at + need.sum(axis=1)
        x = np.where(on, y, x)
    ids = symbols[code.reshape(len(asked), BLOCK)]
    parts = [ids[i, : left[i]] for i in range(len(asked))]
    for b, part in zip(asked, parts, strict=True):
        if zlib.crc32(np.ascontiguousarray(part)) != sums[b]:
            raise Corrupt(f"block {b}")
    return listed[:docs], listed[docs:], np.concatenate([np.zeros(0, np.uint32), *parts])


def write_tokens(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", **vocab) -> None:
    """Rows (file, segment, before, n_tokens, payload) at the path; before: ids of the same file ahead of the segment."""
    vocab = vocab or vocabulary()
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = max(1, -(-total_bytes(base, "text") // FILE_BYTES))

    def run(batches):
        file, number, before, held, n = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush():
            return pa.record_batch([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([encode_segment(held)], pa.binary())], ["file", "segment", "before", "n_tokens", "payload"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append((i, np.append(encode(t, **vocab), np.uint32(end_id))))
                n += len(held[-1][1])
                if n >= SEGMENT:
                    yield flush()
                    number, before, held, n = number + 1, before + n, [], 0
        if held:
            yield flush()

    in_order = base.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    in_order.mapInArrow(run, "file long, segment long, before long, n_tokens long, payload binary").write.parquet(path)


def _read(spark: SparkSession, path: str, columns, schema: str) -> DataFrame:
    """columns: of each document's place among a segment's ids, and the ids, the columns after doc_id and start."""
    segments = spark.read.schema("file long, segment long, before long, n_tokens long, payload binary").parquet(path)
    # a few numbers for each file, so one window takes them all
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = segments.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for ahead, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc, n, ids = decode_segment(data)
                first = np.cumsum(n) - n
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(first + ahead), *columns(first, n, ids)], names)

    out = segments.join(files, "file").select((F.col("ahead") + F.col("before")).alias("ahead"), "payload").mapInArrow(run, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document in the files at the path."""

    def columns(first, n, ids):
        return [pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))]

    return _read(spark, path, columns, "doc_id long, start long, ids array<int>")


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files: the ids themselves stay in the task."""

    def columns(first, n, ids):
        return [pa.array(n.astype(np.int64)), pa.array([zlib.crc32(ids[i : i + k]) for i, k in zip(first.tolist(), n.tolist(), strict=True)], pa.int64())]

    return _read(spark, path, columns, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, end_id: int = 2, read=read_tokens, **vocab) -> DataFrame:
    """Writes the files in the shared folder and gives what they hold."""
    path = f"{shared_folder(docs.sparkSession).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, end_id, **vocab)
    return read(docs.sparkSession, path)
