import hashlib

from pyspark.sql import functions as F

from keyloom.functions.columns import byte_range, geo_score, glob, slot
from keyloom.operators import documents, hashes, lists, others, sets, strings, zsets
from keyloom.sources import keyspace
from keyloom.streaming import consume


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_byte_range(spark):
    for start, stop, want in ((0, -1, "hello"), (-3, -1, "llo"), (1, 2, "el"), (4, 2, ""), (0, 99, "hello"), (9, 12, "")):
        assert bytes(one(spark, byte_range(F.lit("hello"), start, stop))) == want.encode()
    assert one(spark, byte_range(F.lit(""), 0, -1)) == b""
    assert one(spark, byte_range(F.lit("é"), 0, 0)) == b"\xc3"
    assert not one(spark, glob(F.lit("abc\n"), "abc"))


def test_glob(spark):
    for pattern, key, want in (("a*c", "abbc", True), ("a?c", "abc", True), ("a[bd]c", "acc", False), ("a[^x]c", "abc", True), ("a\\*c", "a*c", True), ("a.c", "abc", False)):
        assert one(spark, glob(F.lit(key), pattern)) is want


def test_slot_follows_the_tag(spark):
    assert one(spark, slot(F.lit("{u1}:a"))) == one(spark, slot(F.lit("{u1}:b")))
    assert one(spark, slot(F.lit("{}a"))) != one(spark, slot(F.lit("{}b")))


def test_geo_score_of_known_places(spark):
    assert one(spark, geo_score(F.lit(13.361389), F.lit(38.115556))) == 3476004292229755


def test_incrby_overflow_and_text(spark):
    kv = spark.createDataFrame([("a", "9223372036854775807"), ("b", "x"), ("c", "5")], "key string, value string")
    by = spark.createDataFrame([(k, 1) for k in "abcd"], "key string, n long")
    assert {r.key: r.value for r in strings.incrby(kv, by).collect()} == {"a": None, "b": None, "c": 6, "d": 1}


def test_zadd(spark):
    z = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 5.0)], "key string, member string, score double")
    new = spark.createDataFrame([("k", "b", 3.0), ("k", "c", 2.0)], "key string, member string, score double")
    for only, want in (("", {"a": 1, "b": 3, "c": 2}), ("NX", {"a": 1, "b": 5, "c": 2}), ("XX", {"a": 1, "b": 3}), ("GT", {"a": 1, "b": 5, "c": 2}), ("LT", {"a": 1, "b": 3, "c": 2})):
        assert {r.member: r.score for r in zsets.zadd(z, new, only).collect()} == want


def test_hll_of_a_thousand(spark):
    r = others.hll_registers(spark.range(1000).withColumn("k", F.lit("k")), "k", F.col("id"))
    assert r.count() == 973 and others.pfcount(r, "k").first().n in range(980, 1021)


def test_hincrby_missing_field(spark):
    hf = spark.createDataFrame([("k", "a", "1")], "key string, field string, value string")
    assert hashes.hincrby(hf, "z", 4).first().value == 4


def test_streaming_rate(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = consume.rate(consume.follow(spark, str(tmp_path / "in")), "1 day").writeStream.format("memory").queryName("rate").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from rate").first()[0] == e.count()


def test_negative_stop_before_the_first_place(spark):
    le = spark.createDataFrame([("k", i, v) for i, v in enumerate("abc")], "key string, pos long, value string")
    assert [r.value for r in lists.lrange(le, 0, -100).collect()] == ["a"]
    assert lists.lindex(le, -100).count() == 0 and lists.lindex(le, -1).first().value == "c"
    assert {r.pos: r.value for r in lists.lset(le, -100, "x").collect()} == {0: "x", 1: "b", 2: "c"}
    assert [r.value for r in lists.rpop(le, 5).orderBy("pos").collect()] == ["a", "b", "c"]
    z = spark.createDataFrame([("k", v, float(i)) for i, v in enumerate("abc")], "key string, member string, score double")
    assert [r.member for r in zsets.zrange(z, 0, -100).collect()] == ["a"]
    assert [r.member for r in zsets.zrange(z, -2, -1).orderBy("rank").collect()] == ["b", "c"]


def test_glob_classes(spark):
    for pattern, key, want in (("a[!x]c", "abc", True), ("a[!b]c", "abc", False), ("a[b-d]c", "acc", True), ("a[]c", "a]c", False), ("a[&&]c", "a&c", True), ("*" * 1025, "a", False)):
        assert one(spark, glob(F.lit(key), pattern)) is want


def test_geo_of_known_places(spark):
    g = spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669), ("s", "Rome", 12.496366, 41.902782)], "key string, member string, lng double, lat double")
    held = others.geoadd(g)
    assert {r.member: r.geohash for r in others.geohash(held).collect()} == {"Palermo": "sqc8b49rnys", "Catania": "sqdtr74hyu0", "Rome": "sr2ykk5t6ks"}
    pairs = spark.createDataFrame([("s", "Palermo", "Catania"), ("s", "Palermo", "Rome"), ("s", "Rome", "none")], "key string, a string, b string")
    far = {(r.a, r.b): r.metres and round(r.metres, 4) for r in others.geodist_members(others.geopos(held), pairs).collect()}
    assert far == {("Palermo", "Catania"): 166227.2258, ("Palermo", "Rome"): 427508.8143, ("Rome", "none"): None}


def test_json_setters_leave_others_alone(spark):
    jd = spark.createDataFrame([("a", '{"k": 5, "s": "h\\"i", "l": [1], "o": {"x": 1.5}}'), ("b", "[1]"), ("c", None), ("d", "{}")], "key string, doc string")
    docs = lambda df: {r.key: r.doc for r in df.collect()}
    assert docs(documents.json_del(jd, "s")) == {"a": '{"k":5,"l":[1],"o":{"x":1.5}}', "b": "[1]", "c": None, "d": "{}"}
    assert docs(documents.json_set(jd, "k", "7", "XX"))["d"] == "{}" and docs(documents.json_set(jd, "k", "7", "NX"))["d"] == '{"k":7}'
    assert docs(documents.json_clear(jd, "o"))["a"] == '{"k":5,"l":[1],"o":{},"s":"h\\"i"}'
    assert docs(documents.json_arrappend(jd, "l", "2"))["a"] == '{"k":5,"l":[1,2],"o":{"x":1.5},"s":"h\\"i"}'


def test_msetnx_is_all_or_nothing(spark):
    kv = spark.createDataFrame([("a", "1")], "key string, value string")
    new = spark.createDataFrame([("a", "2"), ("b", "2")], "key string, value string")
    assert strings.msetnx(kv, new).count() == 1
    assert {r.key: r.value for r in strings.msetnx(kv, new.where("key = 'b'")).collect()} == {"a": "1", "b": "2"}


def test_cuckoo_del(spark):
    e = spark.createDataFrame([("x",), ("x",), ("y",)], "e string")
    left = others.cuckoo_del(others.cuckoo_cells(e, F.col("e"), 64), e.where("e = 'x'").limit(1).unionAll(e.where("e = 'y'")), 64)
    assert {r.e: r.n for r in others.cuckoo_count(left, e.distinct(), 64).collect()} == {"x": 1, "y": 0}


def test_set_pairs_are_dealt_by_the_size_of_the_files(spark, tmp_path):
    pairs = spark.range(40_000).select((F.col("id") % 50).alias("l_suppkey"), (F.col("id") % 20_000).alias("l_partkey"))
    pairs.repartition(24).write.parquet(str(tmp_path / "lineitem.parquet"))
    tasks = [r["count"] for r in keyspace.sm(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 20_000 and max(tasks) < 1_000


def test_random_members_are_ordered_by_bytes(spark):
    sm = spark.createDataFrame([("k", str(i)) for i in range(200)] + [("l", "x")], "key string, member string")
    picked = sets.srandmember(sm, 5, 1)
    first = sorted((str(i) for i in range(200)), key=lambda m: hashlib.md5(f"1/{m}".encode()).hexdigest())[:5]
    assert sorted(map(tuple, picked.collect())) == sorted([("k", m) for m in first] + [("l", "x")])
    assert "unhex" in picked._jdf.queryExecution().optimizedPlan().toString()


def test_sadd_does_not_sort_the_sets(spark):
    sm = spark.range(400_000).select(F.concat(F.lit("supp:"), F.col("id") % 100).alias("key"), F.col("id").cast("string").alias("member"))
    new = spark.createDataFrame([("supp:1", "1"), ("supp:1", "x"), ("supp:1", "x"), ("none", "1")], "key string, member string")
    added = sets.sadd(sm, new)
    got = added.collect()
    assert len(got) == len(set(got)) == 400_002 and {("supp:1", "x"), ("none", "1")} <= set(map(tuple, got))
    assert "LeftSemi, BuildRight" in added._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_quantiles_of_large_groups(spark):
    one = spark.range(30_000)
    i = F.col("id")
    rows = [(F.lit("even"), i * 7919 % 30_011 / 8), (F.lit("few"), (i % 3).cast("double")), (F.lit("far"), F.pow(F.lit(-1.5), i % 1_000)), (F.lit("nan"), F.when(i % 50 == 0, F.lit(float("nan"))).otherwise(-i)), (F.lit("gaps"), F.when(i % 2 == 0, i / 3)), (F.lit(None), i / 7), (F.lit("none"), F.lit(None))]
    values = spark.createDataFrame([("small", 1.0), ("small", 2.0)], "k string, x double")
    for k, x in rows:
        values = values.unionByName(one.select(k.cast("string").alias("k"), x.cast("double").alias("x")))
    plain = lambda df: sorted(str(tuple(r)) for r in df.collect())
    for at, ranked in (([0.0, 0.5, 1.0], 1_000), ([0.001, 0.99], 20_000)):  # 15,000 rows of "gaps" count
        got = others.quantiles(values, "k", "x", at, ranked)
        want = values.groupBy("k").agg(*(F.percentile("x", q).alias(f"q{round(q * 100)}") for q in at))
        assert got.columns == want.columns and plain(got) == plain(want)
