import numpy as np

from keyloom.llm.ads_ann import adaptive_scan, nearest_neighbours, rotation


def brute(rows, k=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 24]
    out = {}
    for q, x in good:
        if q % 100 == 0:
            d = sorted({(float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in good if i != q})
            out[q] = d[:k]
    return out


def recall(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in nearest_neighbours(df, "vec_id % 100 = 0").orderBy("query_id", "rank").collect():
        own = got.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1 and r.vec_id != r.query_id
        own.append((r.score, r.vec_id))
    want = brute(rows, k)
    assert set(got) == {q for q, d in want.items() if d}
    hit = n = 0
    for q, w in want.items():
        assert got.get(q, []) == sorted(got.get(q, [])) and len(got.get(q, [])) == len(w)
        true = {i: d for d, i in w}
        hit += sum(i in true for _, i in got.get(q, []))
        n += len(w)
        for d, i in got.get(q, []):
            if i in true:
                assert abs(true[i] - d) < 1e-9
    return hit / max(1, n)


def f32(x):
    return [float(np.float32(y)) for y in x]


def test_recall(spark):
    r = np.random.default_rng(0)
    centres = r.standard_normal((30, 24))
    rows = [(i, f32(centres[r.integers(30)] + 0.3 * r.standard_normal(24))) for i in range(6000)]
    assert recall(spark, rows) >= 0.95


def test_odd_vectors_and_hot_ones(spark):
    r = np.random.default_rng(1)
    hot = f32(r.standard_normal(24))
    rows = [(i, hot if i % 3 == 0 else f32(r.standard_normal(24))) for i in range(900)]
    rows += [(1000, None), (1100, []), (1200, [0.0] * 24), (1300, [None] * 24), (1400, [float("nan")] * 24), (1500, [float("inf")] * 24), (1600, [1.0] * 3), (None, hot), (1700, [-0.0, *hot[1:]]), (1800, hot), (1800, hot)]
    assert recall(spark, rows) >= 0.9


def test_recall_without_clusters(spark):
    r = np.random.default_rng(4)
    rows = [(i, f32(x / np.linalg.norm(x))) for i, x in enumerate(r.standard_normal((4000, 24)))]
    assert recall(spark, rows) >= 0.93


def test_doubles_stay_doubles(spark):
    r = np.random.default_rng(6)
    base = r.standard_normal(24)
    rows = [(i, (base + i * 1e-12 * np.eye(24)[0]).tolist()) for i in range(40)] + [(100, [1e39, *[0.0] * 23])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    for q in (0, 100):
        got = nearest_neighbours(df, "vec_id % 100 = 0").where(f"query_id = {q}").orderBy("rank").collect()
        assert [(x.score, x.vec_id) for x in got] == want[q]


def test_few(spark):
    assert recall(spark, [(0, [1.0] * 24)]) == 0
    assert recall(spark, [(0, [1.0] * 24), (100, [2.0] * 24), (5, [2.0] * 24)]) == 1
    assert nearest_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0").count() == 0


def test_scan_keeps_the_near_ones():
    r = np.random.default_rng(2)
    x, q = r.standard_normal((2000, 64)).astype(np.float32), r.standard_normal(64).astype(np.float32)
    t = rotation(64)
    y = x @ t
    d = ((x - q) ** 2).sum(axis=1)
    bound = np.sort(d)[20]
    alive = adaptive_scan(q, q @ t, [y[:, i : i + 16] for i in range(0, 64, 16)], bound)
    assert len(set(np.flatnonzero(d <= bound)) - set(alive)) <= 1 and len(alive) <= 30
