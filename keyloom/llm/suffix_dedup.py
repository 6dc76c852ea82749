"""Suffix-array removal of repeated byte strings.

A byte goes if some 50-byte string that covers it also starts in a document with a smaller id. Method: suffixes are
range-partitioned by their leading bytes on sampled splitters; each bucket sorts its own by multikey quicksort, eight bytes
to a key, and neighbours in that order are compared: a run of equal strings gives its smallest document, and what others
have of it goes.

What is exchanged are bundles (windows.py): the text of neighbouring suffixes that share a gram of 37 bytes, dealt and
sorted by the suffix at the gram. Runs of one gram with bundles of different texts are opened, and their suffixes, cut at
50 bytes, sorted and compared in turn. There are at most RANGES splitters; a range is dealt further by a hash of the
leading bytes, so buckets grow with the corpus and the driver's sample doesn't. Strings of equal leading bytes are in one
bucket, so a run never goes on in the next.

Defined cases: null text counts as empty; rows without 50 bytes lose nothing; rows that share an id never outdate each
other; a null id counts as the largest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, bounded_sample, covered, mix, pack, unpack
from .windows import FOUND, HOT, Block, Entries, blocked, changes, distinct, each_window, in_order, judge_marks, multikey_quicksort, over_blocks, passing, row_hashes, send_entries, send_marks, shared_marks, signless, spans_of, struct_lists, words_of

#: Bytes of text in a block; a bucket gets the grams of two blocks.
BLOCK_BYTES = 8 << 20
#: Ranges of leading bytes at most, and suffixes sampled for each.
RANGES, SAMPLED = 4096, 16
SEED = 24
#: Suffixes that a bucket opens at a time, whole runs of a gram.
OPENED = 1 << 18
_TABLE = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


class _Bytes(Block):
    def __init__(self, docs: pa.Table, window: int, buckets: int):
        self.buckets = buckets
        super().__init__(docs, window, SEED)

    def read(self, text: pa.ChunkedArray) -> None:
        data, offsets = binary_column(text)
        self.bundles(data, _TABLE[data], offsets, self.buckets)


def leading(text: np.ndarray, lead: np.ndarray, length: int) -> np.ndarray:
    """Of each bundle's suffix at its gram."""
    return np.lib.stride_tricks.sliding_window_view(text, length, axis=1)[np.arange(len(text)), lead]


def route(splitters: list[bytes], parts: int):
    """Bucket of an entry: the range of its leading bytes, and a share of that range. Single suffixes go by their whole
    string."""

    def run(b: Block, e: Entries) -> np.ndarray:
        first = leading(e.text, e.lead, b.gram)
        edges = np.array(splitters, f"S{b.gram}")
        place = np.searchsorted(edges, np.ascontiguousarray(first).view(f"S{b.gram}")[:, 0], "right") if len(first) and len(edges) else np.zeros(len(first), np.int64)
        alone = b.alone[e.head]
        h = np.where(alone, row_hashes(e.text.reshape(-1), np.arange(len(alone)) * b.width, b.window), row_hashes(e.text.reshape(-1), np.arange(len(alone)) * b.width + e.lead, b.gram)) if len(alone) else np.zeros(0, np.uint64)
        return place * parts + (mix(h) % np.uint64(parts)).astype(np.int64)

    return run


def _payload(b: Block, e: Entries, which: np.ndarray) -> bytes:
    return pack(e.text[which].reshape(-1), e.size[which].astype(np.uint8), e.lead[which].astype(np.uint8), e.doc[which])


def smallest(text: np.ndarray, size: np.ndarray, doc: np.ndarray, run: np.ndarray, window: int) -> np.ndarray:
    """The smallest document that has each suffix of some distinct bundles, which come in runs of one gram."""
    row, within = np.repeat(np.arange(len(size)), size), each_window(np.zeros(len(size), np.int64), size)
    least = doc[row]
    begin = np.cumsum(size) - size
    n = np.bincount(run)
    at = np.cumsum(n) - n
    weight = np.concatenate(([0], np.cumsum(np.add.reduceat(size, at) * (n > 1)))) if len(n) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(weight, weight[lo] + OPENED, "right")) - 1)
        open_ = np.flatnonzero(np.repeat(n[lo:hi] > 1, n[lo:hi])) + at[lo]
        if len(open_):
            s = each_window(begin[open_], size[open_])
            strings = words_of(np.lib.stride_tricks.sliding_window_view(text, window, axis=1)[row[s], within[s]])
            order = multikey_quicksort(strings)
            new = changes(order, strings)
            least[s[order]] = np.minimum.reduceat(least[s[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
        lo = hi
    return least


def _judge(window: int, gram: int, width: int):
    def run(rows: list[dict]):
        got = [unpack(r["payload"], np.uint8, np.uint8, np.uint8, np.int64) for r in rows]
        text, size, lead, doc = (np.concatenate([g[i] for g in got]) for i in range(4))
        text, size, lead = text.reshape(-1, width), size.astype(np.int64), lead.astype(np.int64)
        first = words_of(leading(text, lead, gram))
        key = np.column_stack([first, words_of(text), (size * (window + 1) + lead).astype(np.uint64)])
        order = multikey_quicksort(np.column_stack([key, signless(doc)]))
        new = changes(order, key)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        head = order[new]
        run = np.cumsum(changes(head, first)) - 1
        least = smallest(text[head], size[head], doc[head], run, window)
        begin = (np.cumsum(size[head]) - size[head])[of]
        earlier = least[each_window(begin, size)] < np.repeat(doc, size)
        cut = np.concatenate(([0], np.cumsum(size)))[np.cumsum([0, *(len(g[3]) for g in got)])]
        return [(r["block"], r["key"], FOUND, pack(np.packbits(earlier[a:z]))) for r, a, z in zip(rows, cut, cut[1:], strict=False)]

    return run


def _remove(block_of, to_bucket):
    def run(key, docs, said):
        b = block_of(docs)
        b.shared(shared_marks(said))
        e = distinct(b)
        to = to_bucket(b, e)
        order = np.argsort(to, kind="stable")
        count = e.size[order]
        bits, found = [np.zeros(0, bool)], in_order(said, FOUND)
        cuts = [*np.flatnonzero(changes(order, to)), len(order)]
        for payload, lo, hi in zip(found, cuts, cuts[1:], strict=False):
            n = int(count[lo:hi].sum())
            bits.append(np.unpackbits(unpack(payload, np.uint8)[0], count=n).astype(bool))
        bits = np.concatenate(bits)
        begin = np.empty(len(order), np.int64)
        begin[order] = np.cumsum(count) - count
        # a bundle's suffixes go if a bucket says so, or all of them if its text is in an earlier document of this block
        source = each_window(begin[e.of], b.size)
        gone = bits[source] | np.repeat(b.doc > e.doc[e.of], b.size) if len(source) else np.zeros(0, bool)
        start = each_window(b.first, b.size)[gone]
        return _result(b, covered(len(b.tokens), start, start + b.window))

    return run


def _result(b: Block, mask: np.ndarray) -> pa.Table:
    row, lo, hi = spans_of(mask, b.offsets)
    kept = np.concatenate(([0], np.cumsum(~mask)))[b.offsets]
    raw = b.tokens[~mask]
    texts = pa.array([raw[kept[i] : kept[i + 1]].tobytes() for i in range(len(b.ids))], pa.binary())
    return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": pa.array(np.diff(b.offsets), pa.int64()), "spans": struct_lists(row, len(b.ids), {"start": lo, "end": hi}), "kept": texts})


def splitters_of(base: DataFrame, gram: int, ranges: int) -> list[bytes]:
    """Leading bytes of suffixes at random places of a bounded sample, one document a suffix: the ends of the ranges."""
    if ranges < 2:
        return []
    long = base.where(F.octet_length("text") >= gram).select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text")
    at = F.pmod(F.xxhash64("h", F.lit(1)), F.octet_length("text") - gram + 1).cast("int") + 1
    found = sorted(bytes(r["s"]) for r in bounded_sample(long.select("h", F.substring("text", at, F.lit(gram)).alias("s")), "h", ranges * SAMPLED).select("s").collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def suffix_array_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = BLOCK_BYTES, hot: int = HOT, ranges: int = RANGES) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, in order) and kept (the other bytes) of every document."""
    d, blocks = blocked(docs, id_col, text_col, block_bytes)
    buckets = max(1, -(-blocks // 2))
    seed = min(SEED, window)
    gram = seed + (window - seed) // 2
    splitters = splitters_of(d, gram, min(ranges, buckets))
    to_bucket = route(splitters, -(-buckets // (len(splitters) + 1)))

    def block_of(rows: pa.Table) -> Block:
        return _Bytes(rows, window, buckets)

    return over_blocks(
        d,
        send_marks(block_of, buckets),
        judge_marks(hot),
        send_entries(block_of, to_bucket, _payload),
        passing(_judge(window, gram, 2 * window - gram)),
        _remove(block_of, to_bucket),
        "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary",
    )
