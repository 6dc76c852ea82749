import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from keyloom.llm import stock_packing as S
from keyloom.llm.tokens import encode, vocabulary


def check_sequences(pieces, length):
    by = defaultdict(list)
    for n, q, o in pieces:
        by[q].append((o, n))
    padding = 0
    for items in by.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= length
        padding += S.padded(at, length) - at
    return padding


@pytest.mark.parametrize("seed,top", [(1, 1024), (2, 300), (3, 5), (4, 1024)])
def test_plan(seed, top):
    r = random.Random(seed)
    lengths = [k for _ in range(3000 if seed < 4 else 3) for _, k in S.cuts(min(top, max(1, int(r.lognormvariate(6, 1)))), 1024)]
    hist = defaultdict(int)
    for n in lengths:
        hist[n] += 1
    plan = S.plan_patterns(dict(hist), 1024)
    n = np.array([s for s, k in hist.items() for _ in range(k)])
    rank = np.array([i for k in hist.values() for i in range(k)])
    q, o = S.place(plan, n, rank)
    padding = check_sequences(zip(n, q, o), 1024)
    assert padding <= 0.005 * sum(lengths) + 2048


def test_knapsack():
    sizes, values = np.array([3, 5]), np.array([4.0, 7.0])
    best, last = S.knapsack(values, sizes, 11)
    assert best[11] == 15 and best[10] == 14 and best[4] == -np.inf


def test_pack(spark):
    r = random.Random(9)
    docs = [(1, None), (2, ""), (2, ""), (None, "x y"), (5, "long " * 5000)] + [(10 + i, " ".join("word%d" % r.randrange(50) for _ in range(r.randrange(400)))) for i in range(80)]
    S.SHARE, was = 2, S.SHARE
    got = S.pack_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    S.SHARE = was
    check_sequences([(g.length, g.sequence_id, g.offset) for g in got], 1024)
    pieces = defaultdict(list)
    for g in got:
        pieces[g.doc_id].append(g)
    for i, t in docs:
        ids = np.append(encode(t or "", **vocabulary()), np.uint32(0))
        own = sorted(pieces[i], key=lambda g: g.start)
        if i != 2:
            assert [(g.start, g.length) for g in own] == S.cuts(len(ids), 1024) and sum(g.length for g in own) == len(ids)
        for g in own:
            assert g.ids_crc32 == zlib.crc32(ids[g.start : g.start + g.length].astype("<u4").tobytes()) and g.doc_tokens == len(ids)
    assert len(pieces[2]) == 2
    assert S.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
