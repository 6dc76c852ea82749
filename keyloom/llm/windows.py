"""Repeated windows of W tokens across documents, the common part of the two substring operators.

Every window is owned by its smallest seed (K tokens, by hash, leftmost on ties): equal windows have equal seeds, wherever
they stand. Consecutive windows with one owner are cut into two bundles, those that reach half of the other W-K tokens
before the seed and those that reach half of them after it, so all windows of a bundle have its gram in common: the seed
and that half. A bundle is the text of its windows; about one in (W-K)/3 tokens begins one.

Blocks of documents first say which grams they hold, by marks of 32 bits in buckets; a window whose gram no other document
holds is not repeated. Marks only choose which bundles meet: what is removed follows from the texts of bundles, compared
token by token in the operators' buckets. A block sends each distinct bundle once, with its smallest document, so a passage
of a third of all documents costs one entry a block. Windows of a gram that more than HOT blocks hold are sent one by one,
dealt by their whole text, so that no gram fills a bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, mix, pack, runs, text_bytes, total_bytes, unpack

#: Tokens hashed at a time; a longer document is taken whole.
CHUNK = 1 << 20
_M = 0xEA2E62A9
_C = np.uint64(0xF1357AEA2E62A9C5)


def rolling(tokens: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hash, in the tokens' own unsigned type, of every run of `length` tokens, by doubling."""
    bits, kind = tokens.dtype.itemsize * 8, tokens.dtype.type
    n = len(tokens) - length + 1
    if n <= 0:
        return np.zeros(0, tokens.dtype)
    out, have, power, size, p = None, 0, tokens, 1, _M
    while True:
        if length & size:
            out, have = (power, size) if out is None else (out[: len(out) - size] * kind(p) + power[have : have + len(out) - size], have + size)
        if size * 2 > length:
            return out[:n]
        power = power[:-size] * kind(p) + power[size:]
        p, size = p * p % (1 << bits), size * 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size : width - size + n])


def gather(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The runs of `length` tokens that start at the given places."""
    return np.lib.stride_tricks.sliding_window_view(data, length)[at] if len(at) else np.zeros((0, length), data.dtype)


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit words, so that words compare as the bytes do; rows of 64-bit tokens as is."""
    if rows.dtype != np.uint8:
        return rows
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(np.uint64)


def hash_rows(rows: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of tokens."""
    h = np.full(len(rows), rows.shape[1], np.uint64)
    for k, w in enumerate(words_of(rows).T):
        h = (h ^ w) * _C + np.uint64(k)
        h ^= h >> np.uint64(32)
    return mix(h)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix, column by column: each run of rows that tie so far is parted around a pivot into
    smaller, equal and larger, and only the equal ones go on to the next column. All open runs take a step at a time."""
    n, columns = words.shape
    order = np.arange(n)
    start, size, depth = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64)
    while columns and len(start := start[size > 1]):
        depth, size = depth[size > 1], size[size > 1]
        at, run, base = each_window(start, size), np.repeat(np.arange(len(start)), size), np.cumsum(size) - size
        rows = order[at]
        v = words[rows, depth[run]]
        a, b, c = v[base], v[base + size // 2], v[base + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[run]
        side = (v >= pivot).view(np.int8) + (v > pivot)
        count = np.bincount(run * 3 + side, minlength=3 * len(start)).reshape(-1, 3)
        into = base[:, None] + np.cumsum(count, axis=1) - count
        moved = np.empty(len(rows), np.int64)
        for k in range(3):
            before = np.cumsum(count[:, k]) - count[:, k]
            moved[np.repeat(into[:, k] - before, count[:, k]) + np.arange(count[:, k].sum())] = rows[side == k]
        order[at] = moved
        start = (start[:, None] + into - base[:, None]).reshape(-1)
        size, depth = count.reshape(-1), (depth[:, None] + [0, 1, 0]).reshape(-1)
        size = np.where(depth < columns, size, 0)
    return order


def changes(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """True where a new run of equal keys (or rows of keys) begins in the order."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for k in keys:
            s = k[order]
            differs = s[1:] != s[:-1]
            new[1:] |= differs.any(axis=1) if differs.ndim > 1 else differs
    return new


@dataclass
class Segments:
    """Of one block, in order of place: first and last window start and the seed's place (in the block's tokens), and
    the document row."""

    first: np.ndarray
    last: np.ndarray
    seed_at: np.ndarray
    row: np.ndarray


def segments(tokens: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> Segments:
    """tokens: 32-bit hashes of the tokens of all documents of a block; offsets: where each row begins."""
    parts, lo, rows = [], 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + CHUNK, "right")) - 1)
        part = _segments(tokens[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], window, gram)
        parts.append([x + offsets[lo] for x in part])
        lo = hi
    first, last, at = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))
    return Segments(first, last, at, np.searchsorted(offsets, first, "right") - 1)


def _segments(tokens, offsets, window, gram):
    n = len(tokens) - window + 1
    if n <= 0:
        return [np.zeros(0, np.int64)] * 3
    key = (rolling(tokens, gram) * np.uint32(0x9E3779B1)).astype(np.uint64) << np.uint64(32)
    key |= np.arange(len(key), dtype=np.uint64)
    owner = sliding_min(key, window - gram + 1).astype(np.uint32)  # the low half: the place
    ok = np.ones(n, bool)
    over = (offsets[1:-1, None] - np.arange(1, window)).reshape(-1)  # windows that would cross into the next document
    ok[over[(over >= 0) & (over < n)]] = False
    new = ok.copy()
    new[1:] &= (owner[1:] != owner[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    end = ok.copy()
    end[:-1] &= new[1:] | ~ok[1:]
    return [first, np.flatnonzero(end), owner[first].astype(np.int64)]


def each_window(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places first, first+1, ... of each entry, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def row_hashes(data: np.ndarray, at: np.ndarray, length: int, step: int = 1 << 17) -> np.ndarray:
    """Hash of the run of tokens at each place."""
    return np.concatenate([np.zeros(0, np.uint64), *(hash_rows(gather(data, at[i : i + step], length)) for i in range(0, len(at), step))])


def signless(ids: np.ndarray) -> np.ndarray:
    """Ids as unsigned numbers of the same order."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


class Block:
    """A block of documents, in order of id and text; every pass works it out again, always alike."""

    def __init__(self, docs: pa.Table, window: int, seed: int):
        docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.window = docs["doc_id"].to_numpy(), window
        self.seed = min(seed, window)
        self.half = (window - self.seed) // 2
        #: Tokens of a gram; tokens of the longest bundle.
        self.gram, self.width = self.seed + self.half, 2 * window - self.seed - self.half
        self.read(docs["text"])

    def bundles(self, tokens: np.ndarray, hashed: np.ndarray, offsets: np.ndarray, buckets: int) -> None:
        """first, last (window starts), at (the gram's place) and doc of each bundle, and its gram's mark: a bucket over 32
        more bits."""
        s = segments(hashed, offsets, self.window, self.seed)
        mid = s.seed_at - self.half
        left, right = s.first < mid, s.last >= mid
        self.tokens, self.offsets = tokens, offsets
        self.first = np.concatenate((s.first[left], np.maximum(s.first, mid)[right]))
        self.last = np.concatenate((np.minimum(s.last, mid - 1)[left], s.last[right]))
        self.at = np.concatenate((mid[left], s.seed_at[right]))
        self.row = np.concatenate((s.row[left], s.row[right]))
        self.doc = self.ids[self.row] if len(self.row) else np.zeros(0, np.int64)
        h = row_hashes(tokens, self.at, self.gram)
        self.mark = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))

    def marks(self):
        """The distinct marks, in order; the mark of each bundle; whether two documents of the block share it."""
        mark, of = np.unique(self.mark, return_inverse=True)
        low, high = np.full(len(mark), np.iinfo(np.int64).max), np.full(len(mark), np.iinfo(np.int64).min)
        np.minimum.at(low, of, self.doc)
        np.maximum.at(high, of, self.doc)
        return mark, of, low < high

    def shared(self, said: np.ndarray) -> None:
        """Keeps the bundles that another document may share, those of hot grams one window at a time."""
        _, of, here = self.marks()
        code = np.maximum(said, here)[of] if len(of) else np.zeros(0, np.uint8)
        keep, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        n = self.last[hot] - self.first[hot] + 1
        each = each_window(self.first[hot], n)
        self.row = np.concatenate((self.row[keep], np.repeat(self.row[hot], n)))
        self.doc = np.concatenate((self.doc[keep], np.repeat(self.doc[hot], n)))
        self.size = np.concatenate((self.last[keep] - self.first[keep] + 1, np.ones(len(each), np.int64)))
        self.lead = np.concatenate((self.at[keep] - self.first[keep], np.zeros(len(each), np.int64)))
        self.alone = np.concatenate((np.zeros(len(keep), bool), np.ones(len(each), bool)))
        self.first = np.concatenate((self.first[keep], each))

    def texts(self, which: np.ndarray) -> np.ndarray:
        """Tokens of bundles, as rows of one width, zeros beyond their ends."""
        out = np.zeros((len(which), self.width), self.tokens.dtype)
        for n in np.unique(self.size[which]):
            rows = np.flatnonzero(self.size[which] == n)
            out[rows, : self.window + n - 1] = gather(self.tokens, self.first[which[rows]], self.window + int(n) - 1)
        return out


@dataclass
class Entries:
    """The distinct bundles of a block: texts, sizes, smallest document, a bundle that has it; of: the entry of each bundle."""

    text: np.ndarray
    size: np.ndarray
    lead: np.ndarray
    doc: np.ndarray
    head: np.ndarray
    of: np.ndarray


def distinct(b: Block) -> Entries:
    text = b.texts(np.arange(len(b.first)))
    key = np.column_stack([words_of(text), (b.size * (b.window + 1) + b.lead).astype(np.uint64)])
    order = multikey_quicksort(np.column_stack([key, signless(b.doc)]))
    new = changes(order, key)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    head = order[new]
    return Entries(text[head], b.size[head], b.lead[head], b.doc[head], head, of)


EXCHANGE = "block long, key long, kind int, payload binary"
#: Kinds of payload: which grams others hold; what a bucket found about bundles.
SHARED, FOUND = 0, 1
#: Blocks that may hold a gram before its windows are sent one by one.
HOT = 256


def exchange_rows(out) -> pa.Table:
    cols = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table({"block": pa.array(cols[0], pa.int64()), "key": pa.array(cols[1], pa.int64()), "kind": pa.array(cols[2], pa.int32()), "payload": pa.array(cols[3], pa.binary())})


def in_order(said: pa.Table, kind: int) -> list[bytes]:
    return [r["payload"] for r in sorted(said.to_pylist(), key=lambda r: r["key"]) if r["kind"] == kind]


def shared_marks(said: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(unpack(x, np.uint8)[0] for x in in_order(said, SHARED))])


def send_marks(block_of, buckets: int):
    def run(key, docs):
        mark, _, _ = block_of(docs).marks()
        edges = np.searchsorted(mark, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
        return exchange_rows([(key[0].as_py(), k, SHARED, pack(np.diff(mark[lo:hi].astype(np.uint32), prepend=np.uint32(0)))) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)) if hi > lo])

    return run


def judge_marks(hot: int):
    """0: no other block has the mark; 1: some have; 2: more than `hot`."""

    def run(key, sent):
        rows = sent.to_pylist()
        got = [np.cumsum(unpack(r["payload"], np.uint32)[0], dtype=np.uint32) for r in rows]
        _, of, n = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
        code = ((n > 1).astype(np.uint8) + (n > hot))[of]
        cut = np.cumsum([0, *(len(g) for g in got)])
        return exchange_rows([(r["block"], r["key"], SHARED, pack(code[a:z])) for r, a, z in zip(rows, cut, cut[1:], strict=False)])

    return run


def send_entries(block_of, route, payload):
    """route: bucket of each entry; payload: bytes of some entries. Which grams are shared goes on beside them, under a key
    of the block's own."""

    def run(key, docs, said):
        if not docs.num_rows:
            return exchange_rows([])
        b, block, code = block_of(docs), key[0].as_py(), shared_marks(said)
        b.shared(code)
        e = distinct(b)
        to = route(b, e)
        order = np.argsort(to, kind="stable")
        at = np.flatnonzero(changes(order, to))
        out = [(block, -1 - block, SHARED, pack(code))]
        for lo, hi in zip(at, [*at[1:], len(order)], strict=True):
            out.append((block, int(to[order[lo]]), FOUND, payload(b, e, order[lo:hi])))
        return exchange_rows(out)

    return run


def passing(judge):
    """Lets the blocks' own rows through; the others are a bucket's."""

    def run(key, sent):
        return sent.select(["block", "key", "kind", "payload"]) if key[0].as_py() < 0 else exchange_rows(judge(sent.to_pylist()))

    return run


def spans_of(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (within the row) of the maximal runs of True; a run ends with its row."""
    lo, hi = runs(mask)
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(mask))])
    inner = inner[mask[inner] & mask[inner - 1]]
    lo, hi = np.sort(np.concatenate((lo, inner))), np.sort(np.concatenate((hi, inner)))
    row = np.searchsorted(offsets, lo, "right") - 1
    base = offsets[row] if len(row) else np.zeros(0, np.int64)
    return row, lo - base, hi - base


def struct_lists(row: np.ndarray, rows: int, fields: dict) -> pa.ListArray:
    """A list of structs of longs for each row; entries come in order of their rows."""
    counts = np.bincount(row, minlength=rows)[:rows]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in fields.values()], list(fields)))


def blocked(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """doc_id, text (bytes) and block; rows that share an id or a text are dealt by where they are read as well."""
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_bytes(text_col).alias("text"))
    blocks = max(1, -(-total_bytes(base, "text") // block_bytes))
    return base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks))), blocks


def over_blocks(d: DataFrame, marks, judged_marks, entries, judged, remove, schema: str) -> DataFrame:
    """The passes: marks from blocks to buckets and back, bundles to buckets and back, what is left of the documents."""
    shared = d.groupBy("block").applyInArrow(marks, EXCHANGE).groupBy("key").applyInArrow(judged_marks, EXCHANGE)
    sent = d.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(entries, EXCHANGE)
    found = sent.groupBy("key").applyInArrow(judged, EXCHANGE)
    out = d.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(remove, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))
