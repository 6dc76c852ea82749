import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm.suffix_dedup import suffix_array_dedup
from keyloom.llm.substring_dedup import rlz_dedup
from keyloom.llm.windows import multikey_quicksort

from .brute import drop_windows, sha


def corpus(seed, alphabet, unit):
    r = random.Random(seed)
    passages = [unit.join(r.choice(alphabet) for _ in range(r.randint(40, 120))) for _ in range(6)]
    docs = [(1, None), (2, ""), (3, "é ñ" * 30), (4, "é ñ" * 31), (4, "é ñ" * 31)]
    for i in range(5, 60):
        parts = [r.choice(passages)[r.randint(0, 30) :] if r.random() < 0.5 else unit.join(r.choice(alphabet) for _ in range(r.randint(1, 90))) for _ in range(r.randint(1, 4))]
        docs.append((i, unit.join(parts)))
    docs += [(100 + i, docs[10][1]) for i in range(5)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(5)


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh \n"])
def test_suffix_array(spark, alphabet, hot):
    docs = corpus(1, alphabet, "")
    got = suffix_array_dedup(frame(spark, docs), block_bytes=900, hot=hot, ranges=3).collect()
    want = [(i, len(t), sum(g), sha(bytes(x for x, y in zip(t, g) if not y))) for i, t, g in drop_windows(docs, lambda t: (t or "").encode(), 50)]
    have = [(r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), sha(bytes(r.kept))) for r in got]
    assert sorted(have) == sorted(want)
    assert sum(w[2] for w in want) > 1000
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("alphabet", [["a", "b"], ["w%d" % i for i in range(40)]])
def test_rlz(spark, alphabet, hot):
    docs = corpus(2, alphabet, " ")
    got = rlz_dedup(frame(spark, docs), block_bytes=3000, hot=hot).collect()
    want = [(i, len(t), sum(g), sha(b" ".join(x for x, y in zip(t, g) if not y))) for i, t, g in drop_windows(docs, lambda t: (t or "").encode().split(), 50)]
    have = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), sha(bytes(r.kept))) for r in got]
    assert sorted(have) == sorted(want)
    assert sum(w[2] for w in want) > 1000
    texts = {i: (t or "").split() for i, t in docs}
    for r in got:
        for f in r.factors:
            assert f.length >= 50 and f.ref_doc < r.doc_id
            assert texts[r.doc_id][f.start : f.start + f.length] == texts[f.ref_doc][f.ref_start : f.ref_start + f.length]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(none).count() == 0
    assert rlz_dedup(none).count() == 0


@pytest.mark.parametrize("most", [3, 1 << 50])
def test_quicksort(most):
    rows = np.random.default_rng(5).integers(0, most, (3000, 4)).astype(np.uint64)
    assert rows[multikey_quicksort(rows)].tolist() == sorted(rows.tolist())
    assert len(multikey_quicksort(rows[:0])) == 0


def test_null_and_shared_ids(spark):
    """Null ids count as the largest; rows of one id don't outdate each other, wherever they are dealt."""
    r = random.Random(9)
    passage = " ".join(r.choice("abcdefghij") for _ in range(200))
    docs = [(None, passage)] * 3 + [(None, passage + " x")] + [(5, passage)] * 3 + [(5, "y " + passage)]
    for op in (suffix_array_dedup, rlz_dedup):
        got = op(frame(spark, docs), block_bytes=300).collect()
        assert len(got) == 8
        assert all((len(x.kept) < 60) == (x.doc_id is None) for x in got)


def test_very_long_words(spark):
    r = random.Random(4)
    long = " ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(100_000))
    docs = [(1, long), (2, long[5000:] + "\x1c\x85 z"), (3, "\x0b" + " ".join(long.split()[:150]) + "\x0c")]
    got = {x.doc_id: x for x in rlz_dedup(frame(spark, docs), block_bytes=50_000).collect()}
    assert got[1].spans == [] and len(got[2].kept) < 60 and got[3].kept == b"" and got[3].n_words == 150
    assert got[2].n_words == len((long[5000:] + "\x1c\x85 z").encode().split())


def test_null_id_and_very_long(spark):
    long = "".join(random.Random(3).choice("abcdef ") for _ in range(300_000))
    docs = [(7, long), (None, long[1000:200_000])]
    got = {r.doc_id: r for r in suffix_array_dedup(frame(spark, docs), block_bytes=50_000).collect()}
    assert len(got[None].kept) == 0 and len(got[7].kept) == len(long)
