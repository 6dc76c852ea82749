import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from keyloom.llm import rans_tokens as R
from keyloom.llm.tokens import encode, vocabulary

V = vocabulary()
ODD = ["", " ", "\n\n \t x", "it's <|endoftext|> here", "a" * 5000, "日本語 ١٢٣ ⅷ", "naïve café x　y", "🙂🙂 ok", "l'été, n°5 ½ ²", "x\u0085y\x1cz", "​zero", "“q” – — … €5"]


def test_same_ids_as_the_library():
    t = Tokenizer.from_file(V["vocab"])
    r = random.Random(3)
    texts = ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x24F), r.randrange(0x2010, 0x205E), 32, 10])) for _ in range(200)) for _ in range(400)]
    for x in texts:
        assert encode(x, **V).tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("n,m", [(1, 1), (5, 3), (70_000, 40_000), (100_000, 7), (R.BLOCK, 2)])
def test_round_trip(n, m):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), m).astype(np.uint32)
    cut = np.sort(r.integers(0, n + 1, 4))
    docs = [(10 * i, x) for i, x in enumerate(np.split(ids, cut))]
    data = R.encode_segment(docs)
    d, k, back = R.decode_segment(data)
    assert d.tolist() == [i for i, _ in docs] and k.tolist() == [len(x) for _, x in docs] and (back == ids).all()
    blocks = -(-n // R.BLOCK)
    assert (R.decode_segment(data, range(blocks - 1, blocks))[2] == ids[(blocks - 1) * R.BLOCK :]).all()
    bad = bytearray(data)
    bad[len(bad) // 2] ^= 1
    with pytest.raises(R.Corrupt):
        R.decode_segment(bytes(bad))


def test_frequencies_of_many_rare_ids():
    ids = np.concatenate([np.arange(60_000), np.zeros(10, int)]).astype(np.uint32)
    s, f = R.frequencies(ids)
    assert f.sum() == 1 << R.BITS and f.min() >= 1 and len(s) == 60_000


@pytest.mark.parametrize("small", [False, True])
def test_files(spark, small, monkeypatch):
    if small:  # several files, several segments in each
        monkeypatch.setattr(R, "FILE_BYTES", 2000)
        monkeypatch.setattr(R, "SEGMENT", 10)
    docs = [(7, None), (None, "last"), (3, "one two"), (3, "one two"), *((100 + i, x) for i, x in enumerate(ODD))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = R.encode_and_read_back(df, read=R.read_checksums).collect()
    back = {x.start: x.ids for x in R.encode_and_read_back(df).collect()}
    want, at = [], 0
    t = Tokenizer.from_file(V["vocab"])
    for i, x in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda g: g[1]) == want
    assert [(len(back[g[1]]), zlib.crc32(np.array(back[g[1]], "<u4").tobytes())) for g in want] == [g[2:] for g in want]
    assert R.encode_and_read_back(spark.createDataFrame([], "doc_id long, text string")).count() == 0
