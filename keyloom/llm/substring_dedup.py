"""Relative Lempel-Ziv removal of repeated word windows.

A word goes if some window of 50 words that covers it also starts in a document with a smaller id. Method: reference blocks
index the texts of bundles (windows.py), each block those of some grams, with the first document and place of every string
of 50 words and more. Each document is parsed greedily against every reference block that has one of its grams: where a
string of 50 words is known from an earlier document, the factor is the longest such string there, extended word by word to
its first mismatch; then the parse goes on with the windows that reach over the factor's end, so a passage known from
elsewhere across that boundary is found as well. The words of factors are what is removed. Factors that meet, with
references that go on alike, are one.

Words travel with their bytes and are numbered anew in each reference block; strings are named by doubling (pairs of names
of halves), so words are compared, not hashes.

Defined cases: null text has no words; rows with fewer than 50 words keep all; rows that share an id never outdate each
other; a null id counts as the largest; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from .common import binary_column, covered, pack, unpack
from .windows import FOUND, HOT, Block, Entries, blocked, changes, distinct, each_window, in_order, judge_marks, multikey_quicksort, over_blocks, passing, row_hashes, send_entries, send_marks, shared_marks, signless, spans_of, struct_lists

BLOCK_BYTES = 8 << 20
SEED = 20


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words `[^\\x20\\x09-\\x0D]+` of some texts, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(text)
    words, at = lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    return words.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[at]


class _Words(Block):
    def __init__(self, docs: pa.Table, window: int, buckets: int):
        self.buckets = buckets
        super().__init__(docs, window, SEED)

    def read(self, text: pa.ChunkedArray) -> None:
        self.bytes = binary_column(text)
        chunks = [c.cast(pa.large_string()) for c in text.chunks]
        words, offsets = split_words(pa.concat_arrays(chunks) if chunks else pa.array([], pa.large_string()))
        coded = words.dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_binary())
        number = coded.indices.to_numpy().astype(np.int64)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.words.to_pylist()), np.uint64, len(self.words))[number]
        self.bundles(h, h.astype(np.uint32), offsets, self.buckets)
        self.grams = h
        self.tokens = number.astype(np.uint64)

    def places(self, which: np.ndarray) -> np.ndarray:
        """Of bundles' first words in their documents."""
        return self.first[which] - self.offsets[self.row[which]] if len(which) else np.zeros(0, np.int64)


def route(buckets: int):
    def run(b: Block, e: Entries) -> np.ndarray:
        n = np.where(b.alone[e.head], b.window, b.gram)
        h = np.zeros(len(n), np.uint64)
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            h[at] = row_hashes(b.grams, b.first[e.head[at]] + e.lead[at], int(k))
        return (h % np.uint64(buckets)).astype(np.int64)

    return run


def _payload(b: Block, e: Entries, which: np.ndarray) -> bytes:
    number, text = np.unique(e.text[which], return_inverse=True)
    words = b.words.take(pa.array(number.astype(np.int64)))
    data, offsets = binary_column(pa.chunked_array([words]))
    return pack(data, np.diff(offsets).astype(np.uint32), text.reshape(-1).astype(np.uint32), e.size[which].astype(np.uint8), e.doc[which], b.places(e.head[which]))


def _read_payloads(rows: list[dict], width: int):
    """Texts in numbers of words that hold for all payloads, sizes, documents, places, and how many each payload has."""
    got = [unpack(r["payload"], np.uint8, np.uint32, np.uint32, np.uint8, np.int64, np.int64) for r in rows]
    sizes = np.concatenate([g[1] for g in got]).astype(np.int64)
    data = np.concatenate([g[0] for g in got])
    every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(sizes)))), pa.py_buffer(data)])
    number = every.dictionary_encode().indices.to_numpy().astype(np.uint64)
    begin = np.cumsum([0, *(len(g[1]) for g in got)])
    text = np.concatenate([number[a + g[2]] for a, g in zip(begin, got, strict=False)]).reshape(-1, width)
    return text, *(np.concatenate([g[i] for g in got]).astype(np.int64) for i in (3, 4, 5)), [len(g[3]) for g in got]


def _names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for every distinct pair."""
    return np.unique(a << np.uint64(32) | b, return_inverse=True)[1].reshape(a.shape).astype(np.uint64)


def longest_known(text: np.ndarray, size: np.ndarray, doc: np.ndarray, window: int):
    """For each window of some texts, the length of the longest string from there on that a smaller document has (0: none),
    and a text and window that has it first."""
    n, most = len(text), int(size.max(initial=0))
    length, ref, at = (np.zeros((n, most), np.int64) for _ in range(3))
    name, have = text, 1
    while have * 2 <= window:
        name, have = _names(name[:, :-have], name[:, have:]), have * 2
    if have < window:
        name = _names(name[:, : name.shape[1] - (window - have)], name[:, window - have :])
    for more in range(most):
        row, place = np.nonzero(np.arange(name.shape[1])[None, :] < (size - more)[:, None])
        if not len(row):
            break
        of = np.unique(name[row, place], return_inverse=True)[1]
        order = np.lexsort((row, doc[row], of))
        first = order[changes(order, of)][of]
        known = doc[row[first]] < doc[row]
        r, p, f = row[known], place[known], first[known]
        if not len(r):
            break
        length[r, p], ref[r, p], at[r, p] = window + more, row[f], place[f]
        if more + 1 < most:
            name = _names(name[:, : most - more - 1], text[:, window + more : window + most - 1])
    return length, ref, at


def parse(length: np.ndarray, window: int):
    """Greedy factors (row, start): the first known window, then the first known one that reaches over the factor's end."""
    row, start, n = [], [], length.shape[1]
    open_, at = np.arange(len(length)), np.zeros(len(length), np.int64)
    while n and len(open_):
        ahead = (length[open_] > 0) & (np.arange(n)[None, :] >= at[:, None])
        some = ahead.any(axis=1)
        open_, begin = open_[some], ahead.argmax(axis=1)[some]
        row.append(open_)
        start.append(begin)
        at = begin + length[open_, begin] - window + 1
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, start))


def _refer(window: int, width: int):
    """One reference block: the factors of the entries sent, as (entry, start, length, document, place)."""

    def run(rows: list[dict]):
        text, size, doc, place, sent = _read_payloads(rows, width)
        order = multikey_quicksort(np.column_stack([text, size.astype(np.uint64), signless(doc)]))
        new = changes(order, text, size)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        head = order[new]
        length, ref, at = longest_known(text[head], size[head], doc[head], window)
        r, s = parse(length, window)
        got = [head[r], s, length[r, s], doc[head[ref[r, s]]], place[head[ref[r, s]]] + at[r, s]]
        # a text that an earlier document has as a whole is one factor; those of the earliest are the texts' own
        whole = np.flatnonzero(doc > doc[head[of]])
        same = np.flatnonzero((doc == doc[head[of]]) & (head[of] != np.arange(len(of))))
        mine = np.argsort(r, kind="stable")
        n = np.bincount(r, minlength=len(head))
        copy = mine[each_window((np.cumsum(n) - n)[of[same]], n[of[same]])] if len(same) else same
        whole_ref = head[of[whole]]
        entry = np.concatenate((got[0], whole, np.repeat(same, n[of[same]])))
        fields = [np.concatenate((g, w, g[copy])) for g, w in zip(got[1:], (np.zeros(len(whole), np.int64), size[whole] + window - 1, doc[whole_ref], place[whole_ref]), strict=True)]
        by = np.lexsort((fields[0], entry))
        entry, fields = entry[by], [f[by] for f in fields]
        cut = np.cumsum([0, *sent])
        edge = np.searchsorted(entry, cut)
        return [(x["block"], x["key"], FOUND, pack(entry[a:z] - lo, *(f[a:z] for f in fields))) for x, lo, a, z in zip(rows, cut, edge, edge[1:], strict=False)]

    return run


def _remove(block_of, to_bucket):
    def run(key, docs, said):
        b = block_of(docs)
        b.shared(shared_marks(said))
        e = distinct(b)
        to = to_bucket(b, e)
        order = np.argsort(to, kind="stable")
        got = [[np.zeros(0, np.int64)] * 5]
        for payload, lo in zip(in_order(said, FOUND), np.flatnonzero(changes(order, to)), strict=True):
            entry, *fields = unpack(payload, *[np.int64] * 5)
            got.append([order[lo + entry], *fields])
        entry, *found = (np.concatenate([g[i] for g in got]) for i in range(5))
        by = np.argsort(entry, kind="stable")
        entry, found = entry[by], [f[by] for f in found]
        # every bundle of an entry has its factors; one whose text an earlier document of this block has is a factor whole
        whole = b.doc > e.doc[e.of] if len(e.of) else np.zeros(0, bool)
        own = np.flatnonzero(~whole)
        n = np.bincount(entry, minlength=len(e.size))
        pick = each_window((np.cumsum(n) - n)[e.of[own]], n[e.of[own]])
        bundle = np.concatenate((np.flatnonzero(whole), np.repeat(own, n[e.of[own]])))
        head = e.head[e.of[whole]]
        start = np.concatenate((b.first[whole], b.first[np.repeat(own, n[e.of[own]])] + found[0][pick]))
        length = np.concatenate((b.size[whole] + b.window - 1, found[1][pick]))
        ref_doc, ref_at = np.concatenate((b.doc[head], found[2][pick])), np.concatenate((b.places(head), found[3][pick]))
        return _result(b, b.row[bundle], start, length, ref_doc, ref_at)

    return run


def _result(b: _Words, row, start, length, ref_doc, ref_at) -> pa.Table:
    mask = covered(len(b.tokens), start, start + length)
    by = np.lexsort((start, start - ref_at, ref_doc, row))
    row, start, end, ref_doc, ref_at = row[by], start[by], (start + length)[by], ref_doc[by], ref_at[by]
    # factors of one reference that go on alike are one
    new = np.ones(len(by), bool)
    if len(by):
        line = np.cumsum(np.concatenate(([0], (row[1:] != row[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (start[1:] - ref_at[1:] != start[:-1] - ref_at[:-1]))))
        reach = np.maximum.accumulate(end + line * (len(b.tokens) + 1)) - line * (len(b.tokens) + 1)
        new[1:] = (line[1:] != line[:-1]) | (start[1:] > reach[:-1])
        head = np.flatnonzero(new)
        end = np.maximum.reduceat(end, head)
        row, start, ref_doc, ref_at = row[head], start[head], ref_doc[head], ref_at[head]
        by = np.lexsort((end, start, row))
        row, start, end, ref_doc, ref_at = row[by], start[by], end[by], ref_doc[by], ref_at[by]
    base = b.offsets[row] if len(row) else np.zeros(0, np.int64)
    factors = struct_lists(row, len(b.ids), {"start": start - base, "length": end - start, "ref_doc": ref_doc, "ref_start": ref_at})
    span_row, lo, hi = spans_of(mask, b.offsets)
    kept, (data, at) = [], b.bytes
    for i in range(len(b.ids)):
        words = data[at[i] : at[i + 1]].tobytes().split()
        m = mask[b.offsets[i] : b.offsets[i + 1]]
        kept.append(b" ".join(compress(words, (~m).tolist()) if m.any() else words))
    return pa.table({"doc_id": pa.array(b.ids, pa.int64()), "n_words": pa.array(np.diff(b.offsets), pa.int64()), "spans": struct_lists(span_row, len(b.ids), {"start": lo, "end": hi}), "factors": factors, "kept": pa.array(kept, pa.binary())})


def rlz_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, spans (removed word ranges), factors (start, length, ref_doc, ref_start) and kept (the other
    words, one space between) of every document."""
    d, blocks = blocked(docs, id_col, text_col, block_bytes)
    buckets = max(1, -(-blocks // 2))
    seed = min(SEED, window)
    to_bucket = route(buckets)

    def block_of(rows: pa.Table) -> _Words:
        return _Words(rows, window, buckets)

    width = 2 * window - seed - (window - seed) // 2
    spans = "array<struct<start:long,end:long>>"
    return over_blocks(
        d,
        send_marks(block_of, buckets),
        judge_marks(hot),
        send_entries(block_of, to_bucket, _payload),
        passing(_refer(window, width)),
        _remove(block_of, to_bucket),
        f"doc_id long, n_words long, spans {spans}, factors array<struct<start:long,length:long,ref_doc:long,ref_start:long>>, kept binary",
    )
