"""SimHash near duplicates by covering locality-sensitive hashing.

Every bit position has a vector of radius+1 bits; the table of a non-zero vector v keeps the positions whose vector has
an odd product with v. At most `radius` differing positions leave some v that is even with all of them, so every pair
within the radius collides in that table: no pair is missed, whatever the data.

Only distinct fingerprints enter the tables, 2**(radius+1) - 1 times each, in packed arrays. A bucket links what lies
within the radius and emits stars, never the pairs of a group; the stars are joined into components (components.py).

similar_texts() is for documents that differ in words or passages: groups of a Jaccard similarity of 0.8 or more of their
5-word shingles (lower-cased runs of letters and digits). The covering tables link most of them first, by fingerprints of
those shingles, each link checked by the shingles themselves; an exact prefix-filter join finds the rest. In any one order of all shingles,
two such sets share one of their first n - ceil(0.8 n) + 1; frequent ones (of a sample) come last in the order. Texts that
share one and aren't joined yet meet in blocks, and no pair is written out. First their sketches meet, and texts that no
text of another component may match by size and sketch go; then the sets of the others. There a text is its differences from
the shingles that most of the block have: two similar texts far from that centre share many of their differences, so those
are the ones looked up, the rarest first, and a loose group around one text costs little though all of it shares prefix
shingles. Blocks beyond a bound are cut into shares, each pair of which meets. No pair is missed. Texts and shingles are told
apart by 64 bits of hash.

Defined cases: null text counts as empty; texts without words have fingerprint zero, which links like any other; rows
with a null id take part and get the smallest id reachable; repeated rows share a fingerprint; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix, pack, small_batches, text_bytes, unpack
from .components import connected, local_components
from .windows import changes

#: Runs of up to so many fingerprints are compared shift by shift, longer ones from their middle outwards.
SHORT_RUN = 48
#: Bytes of packed fingerprints to a bucket.
BUCKET_BYTES = 8 << 20
#: Least bits of the sketches that rule pairs out; texts that are looked at for common shingles, and shingles kept of them.
SKETCH, SAMPLE, COMMON = 1024, 4_000, 100_000
#: Fingerprints and shingles dealt to buckets at once, over as many batches as that takes.
DEAL_FPS, DEAL_SHINGLES = 20_000, 400_000
#: Shingles of a block's texts that meet at once; a larger block is cut into shares.
MEET = 1 << 19
#: Differing bits of fingerprints that make two texts candidates.
RADIUS = 3
#: Texts to compare whose places are broadcast at most (about 60 bytes each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
_C = np.uint64(0xD1B54A32D192ED03)
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.add.reduce(bits, axis=0, dtype=np.uint32 if len(h) > 65535 else np.uint16)
    return int(np.packbits(total * 2 > len(h) if len(h) < 32768 else total.astype(np.int64) * 2 > len(h), bitorder="little").view(np.uint64)[0])


def shingle_fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of the word shingles, repeats included; A-Z lower-cased, words parted by ASCII white space."""
    w = text.lower().split()
    grams = map(b" ".join, zip(*(w[k:] for k in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)] if w else []
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, 42) for g in grams], np.uint64))


def _pieces(batches, rows: int = 256):
    """Batches of few rows: texts and sets of shingles are long, and a task's Python has little memory."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def content_words(text: bytes) -> list[str]:
    return _WORD.findall(text.decode("utf-8", "replace").lower())


class _Hashes(dict):
    """Hashes of words, worked out once each."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode(), 7)
        return h


_HASHES = _Hashes()


def word_shingles(words: list[str], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n, out = min(size, len(h)), np.zeros(max(0, len(h) - size + 1) or min(1, len(h)), np.uint64)
    for k in range(n):
        out = mix(out ^ h[k : k + len(out)]) + _C
    return np.unique(out)


def _signed(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for b in batches:
            known: dict[bytes, int] = {}
            out = []
            for t in b.column(1).to_pylist():
                f = known.get(t)
                if f is None:
                    f = known[t] = shingle_fingerprint(t)
                out.append(f)
            yield pa.record_batch([b.column(0), pa.array(_signed(out))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> np.ndarray:
    n = (1 << (radius + 1)) - 1
    vector = 1 + (mix(np.arange(64, dtype=np.uint64)) if n > 64 else np.arange(64, dtype=np.uint64)) % np.uint64(n)
    odd = (np.bitwise_count(vector[None, :] & np.arange(1, n + 1, dtype=np.uint64)[:, None]) & 1).astype(bool)
    return np.packbits(odd, axis=1, bitorder="little").view(np.uint64)[:, 0]


def _table_key(fp: np.ndarray, masks: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix((fp & masks[v]) + (v.astype(np.uint64) + np.uint64(1)) * _C)


def near_links(fp: np.ndarray, key: np.ndarray, radius: int) -> np.ndarray:
    """Component (as the smallest index) of each fingerprint, linking those of one key within the radius."""
    order = np.argsort(key)
    new = changes(order, key)
    starts = np.flatnonzero(new)
    size = np.diff(np.concatenate((starts, [len(order)])))
    run = np.cumsum(new) - 1
    a, b = [], []
    short = order[(size[run] > 1) & (size[run] <= SHORT_RUN)] if len(order) else order
    for shift in range(1, int(size[(size <= SHORT_RUN)].max(initial=1))):
        x, y = short[:-shift], short[shift:]
        hit = (key[x] == key[y]) & (np.bitwise_count(fp[x] ^ fp[y]) <= radius)
        a.append(x[hit])
        b.append(y[hit])
    for r in np.flatnonzero(size > SHORT_RUN):
        x, y = _outwards(fp, order[starts[r] : starts[r] + size[r]], radius)
        a.append(x)
        b.append(y)
    return local_components(len(fp), np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b]))


def _outwards(fp: np.ndarray, members: np.ndarray, radius: int):
    """Spanning links of a long run: from its middle, each newly reached fingerprint is held against the unreached only,
    so a run that lies close together takes one pass."""
    uniq, back = np.unique(fp[members], return_inverse=True)
    head = np.full(len(uniq), -1)
    head[back[::-1]] = members[::-1]
    a, b = [members], [head[back]]
    centre = np.uint64(majority(uniq))
    left = np.argsort(np.bitwise_count(uniq ^ centre), kind="stable")
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(uniq[left] ^ uniq[at]) <= radius
        if near.any():
            got = left[near]
            queue.extend(got.tolist())
            a.append(head[got])
            b.append(np.full(len(got), head[at]))
            left = left[~near]
    return np.concatenate(a), np.concatenate(b)


def _gathered(batches, least: int):
    """The first column, a run of at least so many values at a time."""
    held, n = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy().view(np.uint64))
        n += len(held[-1])
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _payloads(to: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """bucket, payload: the entries of each bucket as one packed blob."""
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(buckets + 1, dtype=np.uint64))
    rows = [(k, pack(*(c[order[i:j]] for c in columns))) for k, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "payload"])


def link_fingerprints(fps: DataFrame, radius: int) -> DataFrame:
    """fps: distinct fp (long). Returns node, root of fingerprints within reach of each other, but for the roots."""
    masks = covering_masks(radius)
    buckets = max(1, -(-fps.count() * len(masks) * 9 // BUCKET_BYTES))

    def deal(batches):
        for every in _gathered(batches, DEAL_FPS):
            for lo in range(0, len(every), DEAL_FPS):
                fp = np.tile(every[lo : lo + DEAL_FPS], len(masks))
                v = np.repeat(np.arange(len(masks)), len(every[lo : lo + DEAL_FPS]))
                yield _payloads((_table_key(fp, masks, v) >> np.uint64(32)) % np.uint64(buckets), buckets, fp, v.astype(np.uint16))

    def link(key, sent):
        got = [unpack(x, np.uint64, np.uint16) for x in sent["payload"].to_pylist()]
        fp, v = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]).astype(np.int64)
        root = near_links(fp, _table_key(fp, masks, v), radius)
        # one star a bucket: the same fingerprint may stand in several of its tables
        uniq, back = np.unique(fp, return_inverse=True)
        joined = local_components(len(uniq), back, back[root])
        far = np.flatnonzero(joined != np.arange(len(uniq)))
        return pa.table({"a": pa.array(_signed(uniq[far])), "b": pa.array(_signed(uniq[joined[far]]))})

    links = fps.mapInArrow(deal, "bucket long, payload binary").groupBy("bucket").applyInArrow(link, "a long, b long")
    return connected(links)


def simhash_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """doc_id, fp (long) and component_id (smallest id reachable over links of at most `radius` differing bits)."""
    marked = cut_lineage(fingerprints(docs, id_col, text_col))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = link_fingerprints(classes.select("fp"), radius)
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # components are many and small or one is large: minima first, then joined back
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = joined.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sketch(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each of 1,024 bins, in as many as there are shingles for long texts (a power of
    two). Every shingle that only one of two sets has changes one bit at most, so the differing bits of two sketches never
    outnumber those shingles."""
    bins = max(SKETCH, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles >> np.uint64(20)).astype(np.int64) % bins, minlength=bins) & 1 == 1).tobytes()


def _differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """Differing bits of pairs of sketches; the longer of two is folded to the shorter's bins."""
    out, size = np.zeros(len(x), np.int64), np.array([(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    for s, t in np.unique(size, axis=0):
        at = np.flatnonzero((size == (s, t)).all(axis=1))
        p, q = (np.frombuffer(b"".join(z[i] for i in at), np.uint64).reshape(len(at), -1, min(s, t) // 8) for z in (x, y))
        out[at] = np.bitwise_count(np.bitwise_xor.reduce(p, axis=1) ^ np.bitwise_xor.reduce(q, axis=1)).sum(axis=1)
    return out


def _node(words: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(words).encode(), 11)


def _common(base: DataFrame, n: int) -> np.ndarray:
    """Shingles that repeat in a sample, the most frequent last. Only the order of prefixes depends on it, no result."""

    def sample(batches):
        for b in batches:
            every = [word_shingles(content_words(x.as_py())) for x in b.column("text")]
            h, k = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
            yield pa.record_batch([pa.array(_signed(h)), pa.array(k.astype(np.int64))], ["h", "k"])

    some = base if n <= SAMPLE else base.sample(SAMPLE / n, seed=1)
    top = some.select("text").mapInArrow(sample, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").orderBy(F.desc("k"), "h").limit(COMMON)
    return np.array([r.h for r in top.collect()], np.int64).view(np.uint64)[::-1]


def _prefix(shingles: np.ndarray, known: np.ndarray, place: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of a set, in one order for all sets: two sets of a similarity of `least` share one of them."""
    size = len(shingles) - math.ceil(least * len(shingles) - 1e-9) + 1
    if not len(known) or not len(shingles):
        return shingles[:size]
    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
    return shingles[np.argsort(np.where(known[at] == shingles, place[at], 0), kind="stable")[:size]]


def _shared(base: DataFrame, classes: DataFrame, n: int, least: float) -> DataFrame:
    """h, node: the prefix shingles that two texts or more have."""
    common = _common(base, n)
    order = np.argsort(common)
    known, place = common[order], order + 1
    buckets = max(1, -(-int(classes.agg(F.sum("size")).first()[0] or 0) * 4 // BUCKET_BYTES))

    def deal(batches):
        done, h, node, n = set(), [], [], 0
        for b in batches:
            for x in b.column("text"):
                words = content_words(x.as_py())
                name = _node(words)
                if name not in done:
                    done.add(name)
                    h.append(_prefix(word_shingles(words), known, place, least))
                    node.append(np.full(len(h[-1]), name, np.uint64))
                    n += len(h[-1])
                if n >= DEAL_SHINGLES:
                    every = np.concatenate(h)
                    yield _payloads(mix(every) % np.uint64(buckets), buckets, every, np.concatenate(node))
                    done, h, node, n = set(), [], [], 0
        if n:
            every = np.concatenate(h)
            yield _payloads(mix(every) % np.uint64(buckets), buckets, every, np.concatenate(node))

    def meet(key, sent):
        got = [unpack(x, np.uint64, np.uint64) for x in sent["payload"].to_pylist()]
        h, node = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        order = np.lexsort((node, h))
        h, node = h[order], node[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
        h, node = h[new], node[new]
        same = h[1:] == h[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        return pa.table({"h": pa.array(_signed(h[keep])), "node": pa.array(_signed(node[keep]))})

    return cut_lineage(base.select("text").mapInArrow(deal, "bucket long, payload binary").groupBy("bucket").applyInArrow(meet, "h long, node long"))


def _sets(wanted: DataFrame, base: DataFrame, marked: DataFrame) -> DataFrame:
    """node, shingles: the packed sets of the wanted nodes."""
    place = marked.join(wanted, "node").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("of")).select("node", F.col("of.doc_id").alias("_id"), F.col("of.digest").alias("_digest"))

    def shingle(batches):
        for b in _pieces(batches):
            sets = [word_shingles(content_words(x.as_py())).tobytes() for x in b.column("text")]
            yield pa.record_batch([b.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    place = cut_lineage(place)
    place = F.broadcast(place) if place.count() <= BROADCAST_ROWS else place
    texts = base.join(place, F.col("digest").eqNullSafe(F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text")
    return cut_lineage(texts.mapInArrow(shingle, "node long, shingles binary").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, base: DataFrame, marked: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Those of the pairs a, b of nodes whose texts are at least so similar."""

    def possible(batches):
        for b in _pieces(batches):
            m, n = b.column("m").to_numpy(), b.column("n").to_numpy()
            far = _differing(b.column("x").to_pylist(), b.column("y").to_pylist())
            yield b.select(["a", "b"]).filter(pa.array(far <= (m + n) * ((1 - least) / (1 + least)) + 1e-6))

    one = classes.select(F.col("node").alias("a"), F.col("size").alias("m"), F.col("sketch").alias("x"))
    two = classes.select(F.col("node").alias("b"), F.col("size").alias("n"), F.col("sketch").alias("y"))
    near = cut_lineage(pairs.join(one, "a").join(two, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(possible, "a long, b long"))
    sets = _sets(near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))).distinct(), base, marked)

    def compare(batches):
        for b in _pieces(batches):
            hit = [similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= least for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    both = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return cut_lineage(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))


def may_match(sketches: list[bytes], size: np.ndarray, root: np.ndarray, least: float) -> np.ndarray:
    """Mask of the texts that some text of another root fits by size and sketch. Two that are known to stay aren't compared."""
    stay, most = np.zeros(len(size), bool), (1 - least) / (1 + least)
    bits = np.array([len(x) for x in sketches])
    for b in np.unique(bits):  # sizes that fit have sketches of one length, or the larger text one of twice that
        own, next_ = np.flatnonzero(bits == b), np.flatnonzero(bits == 2 * b)
        at = np.concatenate((own, next_))
        words = np.concatenate([np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches[i] for i in k), np.uint64).reshape(len(k), -1, b // 8), axis=1) for k in (own, next_) if len(k)])
        order = np.argsort(size[at], kind="stable")
        at, words = at[order], words[order]
        to = np.searchsorted(size[at], size[at] / least + 1e-6, "right")
        for k in np.flatnonzero(bits[at] == b):
            x, y = at[k], at[k + 1 : to[k]]
            new = np.flatnonzero((root[y] != root[x]) & ~(stay[x] & stay[y]))
            if len(new):
                far = np.bitwise_count(words[k + 1 + new] ^ words[k]).sum(axis=1, dtype=np.int64)
                near = y[new[far <= (size[x] + size[y[new]]) * most + 1e-6]]
                stay[near] = True
                stay[x] |= len(near) > 0
    return stay


def block_links(sets: list[np.ndarray], root: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links between sets of different roots that are at least so similar, as many as it takes to join all such sets.

    D(x) are the differences of x from the block's centre, the shingles that over half of its sets have. x and y are similar
    if |D(x)| + |D(y)| - 2 |D(x) & D(y)| is at most `most` times their sizes: slack(x) + slack(y) >= 0 is enough, otherwise
    they share -(slack(x) + slack(y)) / 2 differences or more, one of which is among the first of D(x) in any order."""
    n, most, eps = len(sets), (1 - least) / (1 + least), 1e-9
    size, label = np.array([len(x) for x in sets]), np.unique(root, return_inverse=True)[1]
    first = np.concatenate(([0], np.cumsum(size)))
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    who, count = np.repeat(np.arange(n), size), np.bincount(at, minlength=len(every))
    centre = count * 2 > n
    inside, absent = centre[at], np.ones((n, int(centre.sum())), bool)
    absent[who[inside], (np.cumsum(centre) - 1)[at[inside]]] = False
    x, e = np.nonzero(absent)
    x, e = np.concatenate((who[~inside], x)), np.concatenate((at[~inside], np.flatnonzero(centre)[e]))
    count = np.where(centre, n - count, count)
    differ = np.bincount(x, minlength=n)
    x, e = x[count[e] > 1], e[count[e] > 1]  # what no other set shares finds nothing, but comes first
    own = differ - np.bincount(x, minlength=n)
    mine, start = e[np.lexsort((e, count[e], x))], np.concatenate(([0], np.cumsum(np.bincount(x, minlength=n))))
    order = np.argsort(e, kind="stable")
    posts, post = x[order], np.concatenate(([0], np.cumsum(np.bincount(e, minlength=len(every)))))
    slack, links = size * most - differ, []

    def join(x: int, y: int) -> None:
        if label[x] != label[y]:
            links.append((int(x), int(y)))
            label[label == label[y]] = label[x]

    top = int(np.argmax(slack))
    for y in np.flatnonzero(slack + slack[top] >= -eps):
        join(top, y)
    head = int(np.argmax(label == np.argmax(np.bincount(label))))
    ahead, has = np.ones(n, bool), np.zeros(len(every), bool)
    for x in range(n):
        if label[x] == label[head]:
            continue
        ahead[x] = False
        other = ahead & (label != label[x]) & (np.minimum(size, size[x]) >= least * np.maximum(size, size[x]) - 1e-6)
        if not other.any():
            continue
        share = max(1, math.ceil(-(slack[x] + slack[other].max()) / 2 - eps))
        look = mine[start[x] : min(start[x + 1], start[x] + max(0, differ[x] - share + 1 - own[x]))]
        if not len(look):
            continue
        met = np.bincount(np.concatenate([posts[post[k] : post[k + 1]] for k in look]), minlength=n)
        near = np.flatnonzero(other & (met > 0) & (met >= -(slack[x] + slack) / 2 - (share - 1) - eps))
        if not len(near):
            continue
        has[at[first[x] : first[x + 1]]] = True
        both = np.array([np.count_nonzero(has[at[first[y] : first[y + 1]]]) for y in near])
        has[at[first[x] : first[x + 1]]] = False
        for y in near[both / (size[x] + size[near] - both) >= least]:
            join(x, y)
    return links


def _blocks(entries: DataFrame) -> DataFrame:
    """entries: h, node, size, root of all that share an h. Returns block, node, size, root such that two of one h and
    different roots are in some block: the h of one frequent root together, so that a text is in few blocks, or h by h
    where that is less. A block beyond MEET is cut into shares, each pair of which is a block."""
    weight = entries.groupBy("root").agg(F.count("*").alias("n"))
    most = entries.select("h", "root").distinct().join(weight, "root").groupBy("h").agg(F.max_by("root", F.struct("n", "root")).alias("c"))
    placed = cut_lineage(entries.join(most, "h"))
    together = placed.select("c", "node", "size", "root").distinct()
    parts, cost = F.ceil(F.sum("size") / MEET), F.sum("size") * F.greatest(F.lit(1), F.ceil(F.sum("size") / MEET) - 1)
    by_c = together.groupBy("c").agg(parts.alias("parts"), cost.alias("cost"))
    by_h = placed.groupBy("c", "h").agg(parts.alias("parts"), cost.alias("cost"))
    plan = by_c.join(by_h.groupBy("c").agg(F.sum("cost").alias("apart")), "c").select("c", "parts", (F.col("cost") <= F.col("apart")).alias("whole"))
    plan = cut_lineage(plan)
    rows = [F.col("parts"), F.col("node"), F.col("size"), F.col("root")]
    one = together.join(plan.where("whole"), "c").select(F.xxhash64("c").alias("key"), *rows)
    two = placed.join(by_h.join(plan.where("NOT whole").select("c"), "c").select("h", "parts"), "h").select(F.xxhash64("h", F.lit(1)).alias("key"), *rows)
    dealt = one.unionAll(two).withColumn("share", F.pmod(F.xxhash64("node", F.lit(5)), "parts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: (o != F.col("share")) | (F.col("parts") == 1))
    pair = dealt.withColumn("other", F.explode(others))
    return cut_lineage(pair.select(F.xxhash64("key", F.least("share", "other"), F.greatest("share", "other")).alias("block"), "node", "size", "root"))


def _by_block(rows: DataFrame, size: int, solve, schema: str) -> DataFrame:
    """What solve(block, node, size, root, payload) returns for every block of the rows, which have these columns; many
    small blocks go to one task call. size: bytes of all payloads."""
    buckets = max(1, -(-size // BUCKET_BYTES))

    def run(key, sent):
        block, node, n, root = (sent[c].to_numpy() for c in ("block", "node", "size", "root"))
        order, payload = np.argsort(block, kind="stable"), sent["payload"].combine_chunks()
        cut = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1], [True])))
        got = [solve(block[k], node[k], n[k], root[k], payload.take(pa.array(k))) for k in (order[i:j] for i, j in zip(cut, cut[1:], strict=False))]
        return pa.concat_tables(got)

    return rows.withColumn("bucket", F.pmod("block", F.lit(buckets))).select("bucket", "block", "node", "size", "root", "payload").groupBy("bucket").applyInArrow(run, schema)


def _met(blocks: DataFrame, base: DataFrame, marked: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """a, b: links that join all texts of the blocks that are at least so similar."""

    def sieve(block, node, size, root, sketches):
        k = np.flatnonzero(may_match(sketches.to_pylist(), size, root, least))
        return pa.table({"block": block[k], "node": node[k], "size": size[k], "root": root[k]})

    def link(block, node, size, root, sets):
        got = block_links([np.frombuffer(x.as_buffer(), np.uint64) for x in sets], root, least)
        x, y = np.array(got, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.maximum(node[x], node[y]), "b": np.minimum(node[x], node[y])})

    total = int(blocks.agg(F.sum(F.greatest(F.lit(SKETCH // 8), F.col("size") / 4))).first()[0] or 0)
    sketched = blocks.join(classes.select("node", F.col("sketch").alias("payload")), "node")
    left = cut_lineage(_by_block(sketched, total, sieve, "block long, node long, size long, root long"))
    total = int(left.agg(F.sum("size")).first()[0] or 0) * 8
    sets = _sets(left.select("node").distinct(), base, marked).withColumnRenamed("shingles", "payload")
    return cut_lineage(_by_block(left.join(sets, "node"), total, link, "a long, b long"))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, digest (MD5 of the text's bytes), root (long; the same for all rows of a group) for every row."""
    with small_batches(docs.sparkSession):
        return _similar_texts(docs, id_col, text_col, least)


def _similar_texts(docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    text = text_bytes(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))

    def mark(batches):
        for b in _pieces(batches):
            known: dict[str, tuple] = {}
            out = []
            for d, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = known.get(d)
                if got is None:
                    words = content_words(t)
                    shingles = word_shingles(words)
                    got = known[d] = (_node(words), len(shingles), _sketch(shingles), majority(shingles))
                out.append(got)
            yield pa.record_batch([b.column("doc_id"), b.column("digest"), pa.array(_signed([x[0] for x in out])), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary()), pa.array(_signed([x[3] for x in out]))], ["doc_id", "digest", "node", "size", "sketch", "fp"])

    marked = cut_lineage(base.mapInArrow(mark, "doc_id long, digest string, node long, size long, sketch binary, fp long"))
    classes = cut_lineage(marked.groupBy("node").agg(F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("fp").alias("fp")))
    # what the covering tables link, each text held against one of its component
    linked = link_fingerprints(classes.select("fp").distinct(), RADIUS)
    placed = classes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("node", "size", F.coalesce("root", "fp").alias("root"))
    lead = placed.groupBy("root").agg(F.min(F.struct("node", "size")).alias("q"))
    stars = placed.select("root", F.struct("node", "size").alias("p")).join(lead, "root").where("p.node <> q.node")
    shared = _shared(base, classes, marked.count(), least)
    sized = shared.join(classes.select("node", "size"), "node")
    fits = F.least("p.size", "q.size") >= F.greatest("p.size", "q.size") * F.lit(least) - 1e-6
    pair = [F.greatest("p.node", "q.node").alias("a"), F.least("p.node", "q.node").alias("b")]
    done = cut_lineage(stars.where(fits).select(*pair).distinct())
    links = _verified(done, base, marked, classes, least)
    roots = connected(links)
    labelled = sized.join(roots, "node", "left").select("h", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    rest = _met(_blocks(cut_lineage(labelled.join(mixed, "h"))), base, marked, classes, least)
    roots = connected(links.unionAll(rest))
    return marked.join(roots, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, group_id: the smallest id of the documents that are copies or near copies of each other, directly or
    through others."""
    rows = cut_lineage(similar_texts(docs, id_col, text_col, least))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("group_id")), "root").select("doc_id", "group_id")
