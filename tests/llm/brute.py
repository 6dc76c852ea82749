"""Brute-force versions, for small tables."""

import hashlib


def drop_windows(docs, tokens_of, window):
    """id -> (tokens, mask of removed ones); docs: (id, text) pairs."""
    rows = [(i, tokens_of(t)) for i, t in docs]
    first = {}
    for i, t in rows:
        for k in range(len(t) - window + 1):
            w = tuple(t[k : k + window])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - window + 1):
            if first[tuple(t[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((i, t, gone))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()
