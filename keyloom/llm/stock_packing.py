"""Packing documents into sequences by cutting-stock column generation.

A document of n ids (with its end id) is cut into full pieces of the sequence length, half and
quarter ones, and a rest. Full pieces are sequences by themselves. The rests are a cutting-stock problem over their length histogram: a column is a multiset of
lengths that fits a sequence, its cost the padded length (a total that is a power of two isn't padded). The linear program
over columns is solved by revised simplex; columns are priced by a knapsack dynamic program over the duals. Columns are
rounded down, and what is left over goes best-fit, longest first.

The driver sees the histogram and the patterns only (bounded by the sequence length). Pieces are ranked within their
length, in shares of bounded size, so a length that a third of all documents have isn't ranked in one task; a piece's rank
tells its pattern, sequence and offset.

Defined cases: null text counts as empty and is a piece of one id, the end id; rows that share an id are packed each;
rows with a null id are packed too; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage
from .tokens import encode, vocabulary

#: Pieces that are ranked in one share.
SHARE = 4_000
#: Bound on the columns generated; the plan is feasible whenever it stops.
COLUMNS = 3000
#: Steps without a lower cost (few pieces, degenerate bases) after which the search ends.
STALL = 60
#: What a sequence costs beside its padded length, and the relative gap to the dual bound at which the search ends.
SEQUENCE, GAP = 16, 0.002


def padded(total: int, length: int) -> int:
    return total if total & (total - 1) == 0 else length


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, half and quarter sequences, then what is left. Longer rests
    would mostly stand alone, for want of partners that fit; and the fewer lengths, the sooner the program is solved."""
    out, at = [], 0
    for part in (length, length // 2, length // 4):
        while n - at >= part > 0:
            out.append((at, part))
            at += part
    return [*out, (at, n - at)] if at < n else out


def knapsack(values: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of filling exactly c, for every c, and the item last put in (-1: c can't be filled)."""
    best, last = np.full(length + 1, -np.inf), np.full(length + 1, -1)
    best[0] = 0.0
    ends = np.searchsorted(sizes, np.arange(length + 1), "right")
    for c in range(int(sizes[0]), length + 1):
        v = best[c - sizes[: ends[c]]]
        v += values[: ends[c]]
        j = v.argmax()
        if v[j] > -np.inf:
            best[c], last[c] = v[j], j
    return best, last


def greedy_columns(sizes: np.ndarray, demand: np.ndarray, length: int) -> list[np.ndarray]:
    """A first basis: the longest size that is left, filled up with the longest that fit, used until a size runs out.
    No column has a size that ran out before, so together they are triangular; each column stands for one size."""
    m = len(sizes)
    columns: list = [None] * m
    left = demand.astype(np.int64)
    while True:
        open_ = [i for i in range(m - 1, -1, -1) if columns[i] is None and left[i] > 0]
        if not open_:
            break
        column, room = np.zeros(m, np.int64), length
        for i in open_:
            if sizes[i] <= room:
                column[i] = min(room // sizes[i], left[i])
                room -= column[i] * sizes[i]
                if room < sizes[open_[-1]]:
                    break
        used = np.flatnonzero(column)
        times = left[used] // column[used]
        left[used] -= times.min() * column[used]
        columns[used[int(np.argmin(times))]] = column
        for i in used:  # fewer than one more column takes: left to the rounding
            if columns[i] is None and left[i] < column[i]:
                left[i] = 0
    for i in range(m):
        if columns[i] is None:
            columns[i] = np.zeros(m, np.int64)
            columns[i][i] = 1
    return columns


def invert(columns: list[np.ndarray]) -> np.ndarray:
    """Inverse of the basis, by Gauss-Jordan steps with row exchange."""
    m = len(columns)
    a = np.hstack([np.array(columns, float).T, np.eye(m)])
    for k in range(m):
        p = k + int(np.argmax(np.abs(a[k:, k])))
        a[[k, p]] = a[[p, k]]
        a[k] /= a[k, k]
        rows = np.flatnonzero(a[:, k])
        rows = rows[rows != k]
        a[rows] -= np.outer(a[rows, k], a[k])
    return a[:, m:]


def generate_columns(sizes: np.ndarray, demand: np.ndarray, length: int) -> list[tuple[np.ndarray, int, float]]:
    """(items of each size, total, times used) of the linear program's last basis.

    The cost of a column is its padded length and SEQUENCE more, so of two plans without padding the one of fewer
    sequences is better. The search ends once the dual bound is within GAP of the cost.
    """
    m = len(sizes)
    worth = np.array([padded(c, length) + SEQUENCE for c in range(length + 1)], float)
    columns = greedy_columns(sizes, demand, length)
    cost = np.array([worth[int(c @ sizes)] for c in columns])
    inverse = invert(columns)
    amount = inverse @ demand
    if amount.min() < -1e-6:  # sizes of which a few are left over tip the balance: begin with a size to a column
        columns = [np.eye(1, m, i, dtype=np.int64)[0] * max(1, length // sizes[i]) for i in range(m)]
        cost = np.array([worth[int(c @ sizes)] for c in columns])
        inverse = np.diag([1.0 / c[i] for i, c in enumerate(columns)])
        amount = inverse @ demand
    amount = np.maximum(amount, 0.0)
    total, since = np.inf, 0
    for step in range(COLUMNS):
        if cost @ amount < total * (1 - 1e-6):
            total, since = cost @ amount, step
        if step - since >= STALL:
            break
        duals = cost @ inverse
        if not np.isfinite(duals).all():  # the basis has come too near to a singular one; amounts so far still hold
            break
        best, last = knapsack(duals, sizes, length)
        reach = best[1:] / worth[1:]  # the duals over the largest reach are feasible: a bound on any plan's cost
        if reach.max() <= 1 + GAP:
            break
        c = int(np.argmax(best[1:] - worth[1:])) + 1
        column, t = np.zeros(m, np.int64), c
        if last[c] < 0:
            break
        while t:
            column[last[t]] += 1
            t -= sizes[last[t]]
        d = inverse @ column
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, amount / np.where(ok, d, 1.0), np.inf)
        out = int(np.argmin(ratio))
        pivot = inverse[out] / d[out]
        inverse -= np.outer(d, pivot)
        inverse[out] = pivot
        columns[out], cost[out] = column, worth[c]
        amount = amount - d * ratio[out]
        amount[out] = ratio[out]
        amount = np.maximum(amount, 0.0)
        if step % 200 == 199:  # rounding errors don't add up
            inverse = invert(columns)
            amount = np.maximum(inverse @ demand, 0.0)
    return [(c, int(c @ sizes), float(x)) for c, x in zip(columns, amount, strict=True)]


@dataclass
class Plan:
    """Slots, for each length in order of rank: `each` of them in every one of `times` sequences from `sequence` on."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray


def plan_patterns(histogram: dict[int, int], length: int) -> Plan:
    """Patterns for all pieces, each filled to the last."""
    sizes = np.array(sorted(s for s in histogram if s < length), np.int64)
    demand = np.array([histogram[s] for s in sizes], np.int64)
    patterns: list[tuple[dict[int, int], int]] = []
    if histogram.get(length):
        patterns.append(({length: 1}, histogram[length]))
    left = demand.copy()
    for column, _, amount in generate_columns(sizes, demand.astype(float), length) if len(sizes) else []:
        times = int(amount + 1e-6)
        if times:
            times = min(times, *(int(left[i] // column[i]) for i in np.flatnonzero(column)))
        if times > 0:
            left -= times * column
            patterns.append(({int(sizes[i]): int(column[i]) for i in np.flatnonzero(column)}, times))
    # the rest, a few for each pattern: longest first into the fullest sequence that takes it
    room: dict[int, list[dict[int, int]]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        s = int(sizes[i])
        for _ in range(int(left[i])):
            free = next((f for f in range(s, length) if room.get(f)), None)
            items = room[free].pop() if free is not None else {}
            items[s] = items.get(s, 0) + 1
            room.setdefault((length if free is None else free) - s, []).append(items)
    patterns += [(items, 1) for f in sorted(room) for items in room[f]]
    out, sequence, used = [], 0, dict.fromkeys(histogram, 0)
    for items, times in patterns:
        offset = 0
        for s in sorted(items, reverse=True):
            out.append((s, used[s], items[s], sequence, offset))
            used[s] += items[s] * times
            offset += s * items[s]
        sequence += times
    cols = np.array(sorted(out), np.int64).reshape(-1, 5).T
    return Plan(*cols)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the piece of that length and rank."""
    wide = np.int64(1) << 44
    at = np.searchsorted(plan.length * wide + plan.rank, length * wide + rank, "right") - 1
    k = rank - plan.rank[at]
    return plan.sequence[at] + k // plan.each[at], plan.offset[at] + k % plan.each[at] * length


def cut_pieces(docs: DataFrame, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", **vocab) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""
    vocab = vocab or vocabulary()

    def run(batches):
        for b in batches:
            rows, starts, lens, sums, totals = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.append(encode(t, **vocab), np.uint32(end_id))
                n = len(ids)
                for s, k in cuts(n, length):
                    rows.append(i)
                    starts.append(s)
                    lens.append(k)
                    sums.append(zlib.crc32(ids[s : s + k]))
                    totals.append(n)
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lens, sums, totals))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, length: int = 1024, end_id: int = 0, **vocab) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = cut_lineage(cut_pieces(docs, length, end_id, **vocab))
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.collect()}  # at most `length` rows
    plan = plan_patterns(histogram, length)
    shares = {s: -(-n // SHARE) for s, n in histogram.items()}
    share_of = np.ones(length + 1, np.int64)
    for s, k in shares.items():
        share_of[s] = k
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    share = F.pmod(F.xxhash64(*names), F.element_at(F.lit(share_of.tolist()), (F.col("length") + 1).cast("int")))
    dealt = pieces.withColumn("share", share)
    # the ranks of the shares before: a row for every SHARE pieces, joined by the keys that the ranking is dealt by
    ahead = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    begin = dealt.groupBy("length", "share").agg(F.count("*").alias("n")).select("length", "share", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    w = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.join(begin, ["length", "share"]).select(*names, (F.col("begin") + F.row_number().over(w) - 1).cast("long").alias("rank"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                sequence, offset = place(plan, b.column("length").to_numpy(), b.column("rank").to_numpy())
                yield pa.record_batch([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
