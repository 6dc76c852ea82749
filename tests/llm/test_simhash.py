import random

import numpy as np
import pyarrow as pa
import xxhash

from keyloom.llm import simhash_lsh
from keyloom.llm.common import SMALL_BATCH, small_batches
from keyloom.llm.components import local_components
from keyloom.llm.simhash_lsh import _differing, _sketch, block_links, covering_masks, link_fingerprints, may_match, near_duplicate_groups, near_links, simhash_near_duplicates, similarity, word_shingles


def brute_fp(text):
    w = bytes((text or "").encode()).lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_every_pair_within_the_radius_collides():
    for radius in (1, 2, 3, 7):
        masks = covering_masks(radius)
        r = random.Random(radius)
        for _ in range(2000):
            diff = np.uint64(sum(1 << k for k in r.sample(range(64), radius)))
            assert ((masks & diff) == 0).any()


def test_sketches_bound_differences():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 900, 1024, 1025, 5000, 40_000)]
    sets += [np.unique(np.concatenate((s[len(s) // 10 :], s[:3] + np.uint64(1 << 22)))) for s in sets]
    pairs = [(a, b) for a in sets for b in sets]
    far = _differing([_sketch(a) for a, _ in pairs], [_sketch(b) for _, b in pairs])
    assert all(d <= len(np.setxor1d(a, b)) for d, (a, b) in zip(far, pairs, strict=True))
    other = np.unique(r.integers(0, 1 << 63, 40_000, dtype=np.uint64))
    assert _differing([_sketch(sets[6])], [_sketch(other)])[0] > (40_000 + 40_000) / 9  # unrelated long texts are told apart


def test_long_runs():
    r = random.Random(5)
    fp = np.array([sum(1 << k for k in r.sample(range(14), r.randint(0, 5))) for _ in range(400)], np.uint64)
    got = near_links(fp, np.zeros(400, np.uint64), 2)
    assert got.tolist() == brute_components([int(x) for x in fp], 2)


def test_components(spark):
    r = random.Random(1)
    words = ["w%d" % i for i in range(300)]
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One  two"), (None, "one TWO")]
    for i in range(10, 200):
        base = [r.choice(words) for _ in range(r.choice([r.randint(1, 60), 700]))]
        docs.append((i, " ".join(base)))
        for k in range(r.randint(0, 2)):
            c = list(base)
            c[r.randrange(len(c))] = "x"
            docs.append((1000 + 10 * i + k, "\n".join(c).upper()))
    got = simhash_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    fps = [brute_fp(t) for _, t in docs]
    roots = brute_components(fps, 2)
    least = {}
    for (i, _), c in zip(docs, roots):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(i), f, least.get(c)) for (i, _), f, c in zip(docs, fps, roots))
    assert sorted((str(x.doc_id), x.fp & (2**64 - 1), x.component_id) for x in got) == want
    assert len({w[2] for w in want}) < len(want) - 20


def test_link_fingerprints_of_a_chain(spark):
    chain = [(1 << k) - 1 for k in range(0, 60, 2)]
    got = {x.node: x.root for x in link_fingerprints(spark.createDataFrame([(c,) for c in chain], "fp long"), 2).collect()}
    assert got == {c: 0 for c in chain[1:]}


def test_near_copies(spark):
    r = random.Random(2)
    words = ["%s%s" % (a, b) for a in "alpha beta gamma delta sigma omega".split() for b in range(200)]
    docs, want = [(1, None), (2, ""), (3, "ß")], {1: 1, 2: 1, 3: 3}
    for i in range(60):
        base = [r.choice(words) for _ in range(120)]
        docs.append((10 * i + 10, " ".join(base)))
        want[10 * i + 10] = 10 * i + 10
        if i % 2:
            c = list(base)
            c[60] = "edited"
            docs.append((10 * i + 11, ", ".join(c).title()))
            want[10 * i + 11] = 10 * i + 10
    hot = [r.choice(words) for _ in range(200)]
    for i in range(700):
        c = list(hot)
        if i:
            c[r.randrange(200)] = "e%d" % i
        docs.append((5000 + i, " ".join(c)))
        want[5000 + i] = 5000
    got = {x.doc_id: x.group_id for x in near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_near_duplicates(none).count() == 0
    assert near_duplicate_groups(none).count() == 0


def test_near_copies_among_many_linked_texts(spark):
    r = random.Random(3)
    words = ["word%d" % k for k in range(80)]
    docs, want = [], {}
    for i in range(1100):  # the same words in another order: linked by words, but not similar
        docs.append((i, " ".join(r.sample(words, 80))))
        want[i] = i
    for k in range(12):
        of = 90 * k
        c = docs[of][1].split()
        c[40] = "edited"
        docs.append((2000 + k, " ".join(c)))
        want[2000 + k] = of
    got = {x.doc_id: x.group_id for x in near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == want


def test_block_edits(spark):
    r = random.Random(4)
    vocabulary = ["word%d" % k for k in range(5000)]
    weights = [1 / (k + 1) for k in range(5000)]
    docs, pairs = [], []
    for i in range(120):
        base = r.choices(vocabulary, weights, k=r.choice([60, 300, 1000]))
        n, fresh = len(base), lambda k: r.choices(vocabulary, weights, k=k)
        at = r.randrange(n // 2)
        copy = [base + fresh(n // 10), base[: n * 9 // 10], base + fresh(n * 18 // 100), base[: n * 82 // 100], base[:at] + fresh(n * 9 // 100) + base[at + n * 9 // 100 :]][i % 5]
        docs += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
        if similarity(*(word_shingles(w) for w in (base, copy))) >= 0.8:
            pairs.append(2 * i)
    got = {x.doc_id: x.group_id for x in near_duplicate_groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert len(pairs) > 90 and got == {i: i - 1 if i - 1 in pairs else i for i, _ in docs}


def loose_group(r, n, size, edits):
    """Texts of one base, each with words of its own in places; where there are many, most pairs stay below 0.8."""
    base = ["b%d" % k for k in range(size)]
    out = []
    for i in range(n):
        c = list(base)
        for at in r.sample(range(size), r.choice(edits)):
            c[at] = "own%d_%d" % (i, at)
        out.append(c)
    return out


def joined(sets, root):
    """Components (as the smallest index) of texts of one root or of a similarity of 0.8, by all pairs."""
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if root[i] == root[j] or similarity(sets[i], sets[j]) >= 0.8]
    return local_components(len(sets), *np.array([*pairs, (0, 0)]).T)


def test_blocks_join_what_all_pairs_join():
    r = random.Random(5)
    for n, size, edits in ((2, 8, [0, 1]), (40, 30, [0, 1, 2, 9]), (60, 100, [1, 2, 3, 4, 5]), (60, 300, [3, 9, 20]), (30, 1030, [20, 90])):
        texts = loose_group(r, n, size, edits)
        texts += [t[: r.randrange(len(t)) + 1] for t in texts[::3]] + [t + ["more%d" % k for k in range(size // 9)] for t in texts[::4]]
        sets = [word_shingles(t) for t in texts]
        for root in (np.arange(len(sets)), np.array([r.randrange(len(sets)) for _ in sets])):
            want, links = joined(sets, root), block_links(sets, root, 0.8)
            assert all(similarity(sets[x], sets[y]) >= 0.8 for x, y in links)
            a, b = np.array([*links, *zip(range(len(sets)), [list(root).index(x) for x in root], strict=True)]).T
            assert (local_components(len(sets), a, b) == want).all()
            stay = may_match([_sketch(x) for x in sets], np.array([len(x) for x in sets]), root, 0.8)
            assert all(stay[x] and stay[y] for x, y in links)


def test_a_loose_group_writes_no_pairs(spark, monkeypatch):
    """Many texts share prefix shingles and aren't similar: they meet in blocks, whole or in shares, and every link is found."""
    r = random.Random(6)
    texts = loose_group(r, 260, 130, [1, 2, 6, 9, 9, 9, 9])
    sets = [word_shingles(t) for t in texts]
    want = joined(sets, np.arange(len(sets)))
    assert 40 < len(set(want)) < 250
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    compared, verified = [], simhash_lsh._verified
    monkeypatch.setattr(simhash_lsh, "_verified", lambda pairs, *a: compared.append(pairs.count()) or verified(pairs, *a))
    for meet in (1 << 19, 9_000):
        monkeypatch.setattr(simhash_lsh, "MEET", meet, raising=False)
        compared.clear()
        got = {x.doc_id: x.group_id for x in near_duplicate_groups(docs).collect()}
        assert got == dict(enumerate(want.tolist()))
        assert sum(compared) <= len(texts), "pairs written out to be compared"


def test_small_batches_bound_bytes_and_come_back(spark):
    """A batch ends by its bytes, and the session's own settings are the same afterwards, set or not."""
    rows, size = SMALL_BATCH
    was = spark.conf.get(rows, None)
    spark.conf.set(rows, "3000")
    try:

        def count(batches):
            for b in batches:
                yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

        long_rows = spark.range(2000).repartition(1).selectExpr("repeat('x', 20000) AS text").mapInArrow(count, "n long")
        with small_batches(spark):
            inside = [r.n for r in long_rows.collect()]
        assert max(inside) < 300 and sum(inside) == 2000
        assert spark.conf.get(rows) == "3000" and spark.conf.get(size, None) is None
    finally:
        spark.conf.unset(rows) if was is None else spark.conf.set(rows, was)
