"""More registered queries: expiry on every family, bounds, stores, replies in sequence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import lists as L
from ..operators import others as O
from ..operators import sets as S
from ..operators import streams as X
from ..operators import strings as T
from ..operators import timed as E
from ..operators import zsets as Z
from ..sources import keyspace as K
from .catalogue import _NOW, _fields_expiring, query

_L = f"(expire_at_ms = 0 OR expire_at_ms > {_NOW})"
_N = ", n AS (SELECT 'order:' || range * 3 AS key, 'new' AS value FROM range(400))"


def _new(spark):
    return spark.range(400).select(F.concat(F.lit("order:"), (F.col("id") * 3).cast("string")).alias("key"), F.lit("new").alias("value"))


def _put_sql(at, only="TRUE"):
    ok = f"o AS (SELECT n.key, n.value, l.expire_at_ms AS old FROM n LEFT JOIN l ON n.key = l.key), w AS (SELECT key, value, {at} AS expire_at_ms FROM o WHERE {only})"
    return f"{_N}, l AS (SELECT * FROM ex WHERE {_L}), {ok} SELECT * FROM l WHERE key NOT IN (SELECT key FROM w) UNION ALL SELECT * FROM w"


def _put(name, at_sql, only_sql="TRUE", **how):
    def f(spark, d):
        return E.put(K.expiring(spark, d), _new(spark), _NOW, **how)

    f.__name__ = name
    query(_put_sql(at_sql, only_sql), "ex")(f)


_put("str_set_ex", f"{_NOW + 90_000}", expire_at_ms=_NOW + 90 * 1000)
_put("str_set_px", f"{_NOW + 1500}", expire_at_ms=_NOW + 1500)
_put("str_set_exat", "900000000000", expire_at_ms=900_000_000 * 1000)
_put("str_set_pxat", "900000000001", expire_at_ms=900_000_000_001)
_put("str_set_xx", "0", "old IS NOT NULL", only="XX")
_put("str_set_nx_px", f"{_NOW + 50}", "old IS NULL", only="NX", expire_at_ms=_NOW + 50)
_put("str_set_keepttl", "coalesce(old, 0)", keep_ttl=True)
_put("str_setex", f"{_NOW + 7000}", expire_at_ms=_NOW + 7 * 1000)
_put("str_psetex", f"{_NOW + 7}", expire_at_ms=_NOW + 7)


@query(f"{_N} SELECT n.key, l.value FROM n LEFT JOIN (SELECT * FROM ex WHERE {_L}) l ON n.key = l.key", "ex")
def str_set_get(spark, d):
    return E.get(K.expiring(spark, d), _new(spark).select("key"), _NOW)


@query(f"{_N} SELECT n.key, l.value FROM n LEFT JOIN (SELECT * FROM ex WHERE {_L}) l ON n.key = l.key", "ex")
def str_getdel(spark, d):
    return E.get(K.expiring(spark, d), _new(spark).select("key"), _NOW)


@query(f"{_N} SELECT key, value, expire_at_ms FROM ex WHERE {_L} AND key NOT IN (SELECT key FROM n)", "ex")
def str_getdel_remaining(spark, d):
    return E.without(K.expiring(spark, d), _new(spark).select("key"), _NOW)


@query(f"{_N} SELECT key, value, CASE WHEN key IN (SELECT key FROM n) THEN {_NOW + 60_000} ELSE expire_at_ms END AS expire_at_ms FROM ex WHERE {_L}", "ex")
def str_getex(spark, d):
    return E.retime(K.expiring(spark, d), _new(spark).select("key"), _NOW, _NOW + 60 * 1000)


@query(f"{_N} SELECT key, value, CASE WHEN key IN (SELECT key FROM n) THEN 0 ELSE expire_at_ms END AS expire_at_ms FROM ex WHERE {_L}", "ex")
def str_getex_persist(spark, d):
    return E.retime(K.expiring(spark, d), _new(spark).select("key"), _NOW, 0)


def _expire(name, at, only, may):
    def f(spark, d):
        return O.expire(K.expiring(spark, d), at, only, _NOW)

    f.__name__ = name
    query(f"SELECT key, value, CASE WHEN {may} THEN {at} ELSE expire_at_ms END AS expire_at_ms FROM ex WHERE {_L}", "ex")(f)


_expire("expire_seconds", _NOW + 30 * 1000, "", "TRUE")
_expire("expire_pexpire", _NOW + 30, "", "TRUE")
_expire("expire_at_seconds", 890_000_000 * 1000, "", "TRUE")
_expire("expire_xx", 900_000_000_000, "XX", "expire_at_ms <> 0")
_expire("expire_lt", 900_000_000_000, "LT", "expire_at_ms = 0 OR 900000000000 < expire_at_ms")


@query(f"SELECT key, CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {_NOW} THEN -2 ELSE (expire_at_ms - {_NOW}) // 1000 END AS ttl FROM ex", "ex")
def key_ttl_seconds(spark, d):
    return E.ttl_seconds(K.expiring(spark, d), _NOW)


@query(f"SELECT key, CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {_NOW} THEN -2 ELSE expire_at_ms // 1000 END AS at FROM ex", "ex")
def key_expiretime(spark, d):
    return E.expiry_time(K.expiring(spark, d), _NOW)


@query(f"SELECT key, CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {_NOW} THEN -2 ELSE expire_at_ms END AS at FROM ex", "ex")
def key_pexpiretime(spark, d):
    return E.expiry_time(K.expiring(spark, d), _NOW, 1)


_F = f"CASE field WHEN 'segment' THEN {_NOW + 5000} WHEN 'nation' THEN {_NOW - 1} ELSE 0 END"


@query("SELECT key, field, CASE field WHEN 'segment' THEN 5 WHEN 'nation' THEN -2 ELSE -1 END AS ttl FROM hf", "hf")
def hash_httl_seconds(spark, d):
    return E.ttl_seconds(_fields_expiring(spark, d), _NOW)


@query(f"SELECT key, field, CASE field WHEN 'segment' THEN {(_NOW + 5000) // 1000} WHEN 'nation' THEN -2 ELSE -1 END AS at FROM hf", "hf")
def hash_hexpiretime(spark, d):
    return E.expiry_time(_fields_expiring(spark, d), _NOW)


@query(f"SELECT key, field, value, CASE field WHEN 'name' THEN {_NOW + 2500} ELSE {_F} END AS expire_at_ms FROM hf WHERE field <> 'nation'", "hf")
def hash_hpexpire(spark, d):
    return E.retime_fields(_fields_expiring(spark, d), ["name", "nation"], _NOW, _NOW + 2500)


@query(f"SELECT key, field, value, CASE field WHEN 'segment' THEN 0 ELSE {_F} END AS expire_at_ms FROM hf WHERE field <> 'nation'", "hf")
def hash_hgetex_persist(spark, d):
    return E.retime_fields(_fields_expiring(spark, d), ["segment"], _NOW, 0)


@query(f"SELECT key, field, value, {_F} AS expire_at_ms FROM hf WHERE field = 'segment' UNION ALL SELECT key, 'name', 'x', {_NOW + 1000} FROM hf WHERE field = 'name'", "hf")
def hash_hsetex(spark, d):
    new = K.hf(spark, d).where("field = 'name'").select("key", "field", F.lit("x").alias("value"))
    return E.set_fields(_fields_expiring(spark, d), new, _NOW, _NOW + 1000)


@query("SELECT key, field, value FROM hf WHERE field = 'name'", "hf")
def hash_hgetdel(spark, d):
    return E.take_fields(_fields_expiring(spark, d), ["name", "nation"], _NOW)[0]


@query(f"SELECT key, field, value, {_F} AS expire_at_ms FROM hf WHERE field = 'segment'", "hf")
def hash_hgetdel_remaining(spark, d):
    return E.take_fields(_fields_expiring(spark, d), ["name", "nation"], _NOW)[1]


# counters


def _numbers(spark, d):
    return K.hf(spark, d).where("field = 'nation'").select("key", "value")


@query("SELECT key, CAST(value AS BIGINT) - 1 AS value FROM hf WHERE field = 'nation'", "hf")
def str_decr(spark, d):
    kv = _numbers(spark, d)
    return T.incrby(kv, kv.select("key", F.lit(-1).alias("n")))


@query("SELECT key, CAST(value AS BIGINT) - 7 AS value FROM hf WHERE field = 'nation'", "hf")
def str_decrby(spark, d):
    kv = _numbers(spark, d)
    return T.incrby(kv, kv.select("key", F.lit(-7).alias("n")))


@query("SELECT seq, key, count(*) OVER (PARTITION BY key ORDER BY seq) AS reply FROM log", "log")
def str_incr_replies(spark, d):
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return K.cmdlog(spark, d).select("seq", "key", F.count("*").over(w).alias("reply"))


@query("SELECT seq, key, lag(cmd) OVER (PARTITION BY key ORDER BY seq) AS old, cmd AS value FROM log", "log")
def str_getset_log(spark, d):
    return K.cmdlog(spark, d).select("seq", "key", F.lag("cmd").over(Window.partitionBy("key").orderBy("seq")).alias("old"), F.col("cmd").alias("value"))


# sets and sorted sets


@query("SELECT member FROM sm WHERE key = 'supp:1'", "sm")
def set_smembers(spark, d):
    return S.members(K.sm(spark, d), "supp:1")


_MORE = " UNION ALL SELECT key, member FROM sm"


@query("SELECT 'dst' AS key, member FROM sm WHERE key = 'supp:1' INTERSECT SELECT 'dst', member FROM sm WHERE key = 'supp:2'" + _MORE, "sm")
def set_sinterstore(spark, d):
    sm = K.sm(spark, d)
    return S.store(sm, "dst", S.sinter(sm, ["supp:1", "supp:2"]))


@query("SELECT DISTINCT 'dst' AS key, member FROM sm WHERE key IN ('supp:1', 'supp:2')" + _MORE, "sm")
def set_sunionstore(spark, d):
    sm = K.sm(spark, d)
    return S.store(sm, "dst", S.sunion(sm, ["supp:1", "supp:2"]))


@query("SELECT key, member, score, rev AS rank FROM zr", "zr")
def zset_zrevrank(spark, d):
    return Z.zrank(K.zm(spark, d), reverse=True)


@query("SELECT key, count(*) FILTER (score > (SELECT max(score) FROM zm WHERE key = 'user:1') AND score <= 200000) AS n FROM zm GROUP BY key", "zm")
def zset_zcount_exclusive(spark, d):
    zm = K.zm(spark, d)
    low = zm.where("key = 'user:1'").agg(F.max("score")).first()[0]
    return Z.zcount_bounds(zm, f"({low!r}" if low is not None else "(inf", "200000")


@query("SELECT key, member, score FROM zm WHERE score < 50000", "zm")
def zset_zrangebyscore_inf(spark, d):
    return Z.between_bounds(K.zm(spark, d), "-inf", "(50000")


@query("SELECT key, member, score FROM zr WHERE rev >= 2", "zr")
def zset_zpopmax_remaining(spark, d):
    return Z.zrank(K.zm(spark, d), reverse=True).where("rank >= 2").select("key", "member", "score")


# lists


@query("SELECT key, pos - 2 AS pos, value FROM le WHERE pos >= 2", "le")
def list_lpop_remaining(spark, d):
    return L.ltrim(K.le(spark, d), 2, -1)


@query("SELECT key, pos, value FROM ln WHERE pos < n - 2", "ln")
def list_rpop_remaining(spark, d):
    le = K.le(spark, d)
    kept = le.join(L.rpop(le, 2).select("key", "pos"), ["key", "pos"], "left_anti")
    return kept.select("key", "pos", "value")


# streams


@query("SELECT key, ms, seq, event_id, value FROM xs WHERE (ms > 1704153600000 OR (ms = 1704153600000 AND seq >= 1)) AND ms < 1705000000000", "xs")
def stream_xrange_ids(spark, d):
    return X.xrange_ids(K.xs(spark, d), (1_704_153_600_000, 1), (1_704_999_999_999, (1 << 62)))


@query("SELECT key, max(ms) AS ms, max_by(seq, (ms, seq)) AS seq FROM xs GROUP BY key", "xs")
def stream_xgroup_create(spark, d):
    return X.last_ids(K.xs(spark, d))


# keys


_TYPES = "SELECT 'kv' AS type, key FROM kv UNION SELECT 'sm', key FROM sm UNION SELECT 'zm', key FROM zm"


def _families(spark, d):
    return {"kv": K.kv(spark, d), "sm": K.sm(spark, d), "zm": K.zm(spark, d)}


@query(f", t AS ({_TYPES}), w AS (SELECT unnest(['cust:1', 'supp:1', 'user:1', 'user:4', 'nothing']) AS key) SELECT w.key, coalesce(t.type, 'none') AS type FROM w LEFT JOIN t ON w.key = t.key", "kv sm zm")
def key_type(spark, d):
    return E.type_of(_families(spark, d), spark.createDataFrame([(k,) for k in ("cust:1", "supp:1", "user:1", "user:4", "nothing")], "key string"))


@query("SELECT DISTINCT key FROM zm WHERE key > 'user:2' ORDER BY key LIMIT 10", "zm")
def key_scan_type(spark, d):
    return E.scan_type(_families(spark, d), "zm", "user:2", 10)


@query("SELECT key FROM kv WHERE regexp_matches(key, '^cust:1.*5$')", "kv")
def key_keys_pattern(spark, d):
    return T.scan(K.kv(spark, d), "cust:1*5", count=1 << 30)


@query("SELECT key FROM kv WHERE key >= 'cust:2' AND key < 'cust:3'", "kv")
def key_range_scan(spark, d):
    return K.kv(spark, d).where((F.col("key") >= "cust:2") & (F.col("key") < "cust:3")).select("key")


@query("SELECT key, value FROM kv WHERE NOT starts_with(key, 'cust:1')", "kv")
def key_prefix_delete(spark, d):
    return K.kv(spark, d).where(~F.startswith("key", F.lit("cust:1")))


@query("SELECT key FROM kv ORDER BY md5('3/' || key), key LIMIT 1", "kv")
def key_randomkey(spark, d):
    return K.kv(spark, d).select("key").orderBy(F.md5(F.concat(F.lit("3/"), "key")), "key").limit(1)


@query(f"SELECT count(*) AS n FROM ex WHERE {_L}", "ex")
def key_dbsize(spark, d):
    return O.alive(K.expiring(spark, d), _NOW).agg(F.count("*").alias("n"))


# bits and sketches


@query("SELECT key, min(o) AS pos FROM (SELECT k.key, r.range AS o FROM (SELECT DISTINCT key FROM bits) k, range(20000) r WHERE NOT EXISTS (SELECT 1 FROM bits b WHERE b.key = k.key AND b.off = r.range)) GROUP BY key", "bits")
def bit_bitpos_zero(spark, d):
    return O.bitpos_zero(K.bits(spark, d))


@query("SELECT key, count(*) FILTER (off BETWEEN 5 AND 29) AS n FROM bits GROUP BY key", "bits")
def bit_bitcount_bits(spark, d):
    return K.bits(spark, d).groupBy("key").agg(F.count_if(F.col("offset").between(5, 29)).alias("n"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT user_id FROM events)", "")
def bloom_card(spark, d):
    return K.read(spark, d, "events").agg(F.countDistinct("user_id").alias("n"))


@query("SELECT event_type, count(*) AS n, count(*) >= 0 AND row_number() OVER (ORDER BY count(*) DESC, event_type) <= 3 AS listed FROM events GROUP BY event_type", "")
def topk_query_count(spark, d):
    n = K.read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    top = O.topk(K.read(spark, d, "events"), "event_type", 3).select("event_type").withColumn("in", F.lit(True))
    return n.join(F.broadcast(top), "event_type", "left").select("event_type", "n", F.coalesce("in", F.lit(False)).alias("listed"))


@query("SELECT event_type AS key, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value) = 11", "")
def tdigest_byrank(spark, d):
    out = O.by_rank(K.read(spark, d, "events"), "event_type", "value", 10)
    return out.select(F.col("event_type").alias("key"), "value")


_KM = "2 * 6371.0 * asin(sqrt(pow(sin((radians(20.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * pow(sin((radians(10.0) - radians(lng)) / 2), 2)))"


@query(f"SELECT key, member, round({_KM}, 4) AS km, round({_KM} / 1.609344, 4) AS mi FROM geo", "geo")
def geo_geodist_units(spark, d):
    return O.geodist(K.geo(spark, d), 10.0, 20.0).select("key", "member", F.round(F.col("metres") / 1000, 4).alias("km"), F.round(F.col("metres") / 1609.344, 4).alias("mi"))


@query(f"SELECT key, member, round({_KM}, 3) AS km FROM geo WHERE {_KM} <= 4000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY {_KM}, member) <= 3", "geo")
def geo_search_nearest(spark, d):
    w = Window.partitionBy("key").orderBy("metres", "member")
    near = O.geodist(K.geo(spark, d), 10.0, 20.0).where("metres <= 4000000").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return near.select("key", "member", F.round(F.col("metres") / 1000, 3).alias("km"))


@query(f"SELECT 'near' AS key, member, lng, lat FROM geo WHERE {_KM} <= 4000", "geo")
def geo_searchstore(spark, d):
    geo = K.geo(spark, d)
    near = O.geodist(geo, 10.0, 20.0).where("metres <= 4000000")
    return geo.join(near, ["key", "member"], "left_semi").select(F.lit("near").alias("key"), "member", "lng", "lat")
