"""Commands whose outcome depends on the one before, replayed in order: rate limits, locks, compare-and-set.

A log is dealt by key and sorted within its partitions by key, time and sequence; each task carries the state of one key at
a time from row to row and batch to batch. So memory doesn't grow with a key's history, and a lost task is replayed from
its shuffle input. The commands of one key are a chain by nature and stay in one task.

Defined cases: rows with a null key are one key; equal times go by sequence; an empty log gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: step(state or None, row) gives the new state (None: nothing is held) and the reply.
Step = Callable[[tuple | None, dict], tuple[tuple | None, tuple]]


def replay(log: DataFrame, step: Step, reply: str) -> DataFrame:
    """log: seq, ts_ms, key and what step reads. Returns seq, key and the reply's columns, as the schema `reply` names them."""
    names, kinds = zip(*(part.split() for part in reply.split(",")), strict=True)
    kinds = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]

    def run(batches):
        key, state, begun = None, None, False
        for b in batches:
            out = []
            for row in b.to_pylist():
                if not begun or row["key"] != key:
                    key, state, begun = row["key"], None, True
                state, said = step(state, row)
                out.append(said)
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            if out:
                yield pa.record_batch([b.column("seq"), b.column("key"), *columns], ["seq", "key", *names])

    dealt = log.repartition("key").sortWithinPartitions("key", "ts_ms", "seq")
    return dealt.mapInArrow(run, f"seq long, key string, {reply}")


def ratelimit(log: DataFrame, window_ms: int, most: int) -> DataFrame:
    """log: seq, ts_ms, key, n (tokens asked for). allowed, used, remaining, reset_ms of every request.

    Two windows are held: what was used in this one, and in the last, of which the share that is still within a window's
    length counts. A request that would go beyond the limit uses nothing.
    """

    def step(state, row):
        now, n = row["ts_ms"], row["n"]
        used, began, last = state or (0, now, 0)
        age = now - began
        if age >= window_ms:
            used, began, last, age = 0, now, used if age < 2 * window_ms else 0, 0
        share = max(0.0, 1 - age / window_ms)
        total = used + math.floor(last * share + 0.5)
        allowed = total + n <= most
        if allowed:
            used, total = used + n, total + n
        return (used, began, last), (int(allowed), total, max(0, most - total), max(0, began + window_ms - now))

    return replay(log, step, "allowed long, used long, remaining long, reset_ms long")


def locks(log: DataFrame) -> DataFrame:
    """log: seq, ts_ms, key, cmd (lock, unlock or extend), owner, ttl_ms. done: 1 or 0.

    A lock is free once its time is over. Its owner may take it again, which renews it, extend it and give it back; giving
    back a free lock is done as well, extending one isn't.
    """

    def step(state, row):
        now, owner = row["ts_ms"], row["owner"]
        held = state if state and state[1] > now else None
        if held and held[0] != owner:
            return held, (0,)
        if row["cmd"] == "unlock":
            return None, (1,)
        if row["cmd"] == "extend" and not held:
            return None, (0,)
        return (owner, now + row["ttl_ms"]), (1,)

    return replay(log, step, "done long")


def compare_and_set(log: DataFrame) -> DataFrame:
    """log: seq, ts_ms, key, expected, new. Null expected: the key doesn't exist yet. swapped: 1 or 0, and the value then."""

    def step(state, row):
        value = state[0] if state else None
        swap = value == row["expected"]
        value = row["new"] if swap else value
        return (value,), (int(swap), value)

    return replay(log, step, "swapped long, value string")
