"""URL rules by a cascade of Bloom filters.

The corpus's key universe is every pair of a host suffix (at a dot) and a path prefix (of a length that some rule has) of
its urls. The first filter holds the listed keys; it is sized against the universe so that about as many unlisted keys as
listed ones pass it by mistake. The next filter holds these, the next the listed keys that pass that one by mistake, and
so on until none is left. A key is listed if the first level that it fails is an even one: exact for every key of the
universe, from a few bits for each rule, without a join. One cascade holds the allow rules, one the block rules.

The host is what stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; the path goes on up to `?`,
`#` or the end. A rule fits its host and subdomains where the path starts with the rule's. The longest rule wins (host and
path together, then the longer host). Where no rule fits, the url is in no list: allow.

Defined cases: null or no `://`: empty host and path, no rule, allow; repeated rows are judged each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bound on mistaken keys gathered to build the second level, for each rule and in all; beyond it the first level grows.
MISTAKES = 16
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def candidate_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every rule that could fit, longest first."""
    if not host:
        return []
    labels = host.split(".")
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    keys = [(len(h) + n, len(h), h + path[:n]) for h in suffixes for n in lengths if n <= len(path)]
    return [k[2] for k in sorted(keys, reverse=True)]


class Bloom:
    def __init__(self, keys, rate: float, seed: int):
        keys = list(keys)
        self.seed, n = seed, max(1, len(keys))
        self.size = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.size / n * math.log(2)))
        self.bits = np.zeros(self.size, bool)
        for k in keys:
            self.bits[self._places(k)] = True

    def _places(self, key: str) -> list[int]:
        h = xxhash.xxh128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b = h >> 64, h & 0xFFFFFFFFFFFFFFFF | 1
        return [(a + i * b) % self.size for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p] for p in self._places(key))


@dataclass
class Cascade:
    levels: list[Bloom]

    def __contains__(self, key: str) -> bool:
        for i, level in enumerate(self.levels):
            if key not in level:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def deeper_levels(first: Bloom, listed: set[str], mistaken: set[str]) -> Cascade:
    """mistaken: all unlisted keys of the universe that pass the first level."""
    levels, pro, con = [first], set(mistaken), set(listed)
    while pro:
        level = Bloom(pro, 0.5, len(levels))
        levels.append(level)
        pro, con = {k for k in con if k in level}, pro
    return Cascade(levels)


def _keys_of(urls, lengths):
    seen = {}
    for u in urls:
        k = split_url(u)
        if k not in seen:
            seen[k] = candidate_keys(*k, lengths)
    return seen


def build_cascade(urls: DataFrame, listed: set[str], lengths: list[int]) -> Cascade:
    """urls: one column. The universe is never gathered: each task tells its number of keys, then the mistaken ones."""

    def count(batches):
        for b in batches:
            yield pa.record_batch([pa.array([sum(map(len, _keys_of(b.column(0).to_pylist(), lengths).values()))], pa.int64())], ["n"])

    universe = urls.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 1
    rate = min(0.5, max(1, len(listed)) / universe)
    while True:
        first = Bloom(listed, rate, 0)

        def mistaken(batches, first=first):
            for b in batches:
                keys = {k for ks in _keys_of(b.column(0).to_pylist(), lengths).values() for k in ks}
                yield pa.record_batch([pa.array([k for k in keys if k in first and k not in listed], pa.string())], ["key"])

        bound = MISTAKES * (len(listed) + 8)
        got = urls.mapInArrow(mistaken, "key string").distinct().limit(bound + 1).collect()
        if len(got) <= bound:
            return deeper_levels(first, listed, {r[0] for r in got})
        rate /= 16


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """rules: (verdict, host and path). Returns page_id, host, path, rule, verdict for every row."""
    lengths = sorted({len(r[r.index("/") :]) for _, r in rules})
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    cascades = {v: build_cascade(base.select("url"), {r for w, r in rules if w == v}, lengths) for v in ("block", "allow") if any(w == v for w, _ in rules)}

    def run(batches):
        for b in batches:
            out = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = next(((k, v) for k in candidate_keys(host, path, lengths) for v, c in cascades.items() if k in c), (None, "allow"))
                out.append((host, path, rule, verdict))
            yield pa.record_batch([b.column(0), *(pa.array([o[i] for o in out], pa.string()) for i in range(4))], ["page_id", "host", "path", "rule", "verdict"])

    return base.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
