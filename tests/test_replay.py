import random

from keyloom.operators import others
from keyloom.plans import replay


def test_ratelimit_of_known_requests(spark):
    times = [0, 100, 200, 300, 1000, 1100, 1500, 1900, 2500]
    log = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(times)], "seq long, ts_ms long, key string, n long")
    got = [tuple(r)[2:] for r in replay.ratelimit(log, 1000, 3).orderBy("seq").collect()]
    assert got == [(1, 1, 2, 1000), (1, 2, 1, 900), (1, 3, 0, 800), (0, 3, 0, 700), (0, 3, 0, 1000), (0, 3, 0, 900), (1, 3, 0, 500), (1, 2, 1, 100), (1, 3, 0, 1000)]


def test_locks(spark):
    rows = [(0, 0, "lock", "a", 1), (1, 10, "lock", "b", 0), (2, 20, "extend", "b", 0), (3, 50, "lock", "a", 1), (4, 140, "extend", "a", 1), (5, 150, "unlock", "b", 0), (6, 160, "unlock", "a", 1), (7, 170, "extend", "a", 0), (8, 180, "lock", "b", 1), (9, 280, "lock", "a", 1), (10, 290, "unlock", "b", 0)]
    log = spark.createDataFrame([(s, t, "k", c, o, 100) for s, t, c, o, _ in rows], "seq long, ts_ms long, key string, cmd string, owner string, ttl_ms long")
    assert [r.done for r in replay.locks(log).orderBy("seq").collect()] == [r[4] for r in rows]


def test_state_is_carried_over_batches_and_kept_apart_by_key(spark):
    r = random.Random(3)
    rows = [(i, i // 2, r.choice(["a", "b", None]), r.choice([None, "1", "2"]), r.choice(["1", "2"])) for i in range(400)]
    held, want = {}, {}
    for seq, _, key, expected, new in rows:
        swap = held.get(key) == expected
        if swap:
            held[key] = new
        want[seq] = (key, int(swap), held.get(key))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    log = spark.createDataFrame(rows, "seq long, ts_ms long, key string, expected string, new string").repartition(5)
    got = {x.seq: (x.key, x.swapped, x.value) for x in replay.compare_and_set(log).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got == want
    assert replay.compare_and_set(log.limit(0)).count() == 0
    none = spark.createDataFrame([(1, 1, "k", None, None)], log.schema)
    assert tuple(replay.compare_and_set(none).first()) == (1, "k", 1, None)


def test_sketch_sizes():
    assert others.bloom_size(100, 0.01) == (959, 7) and others.cms_size(0.001, 0.01) == (2719, 5)
