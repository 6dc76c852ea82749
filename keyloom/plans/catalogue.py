"""Registered queries over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as J
from ..operators import hashes as H
from ..operators import lists as L
from ..operators import others as O
from ..operators import sets as S
from ..operators import streams as X
from ..operators import strings as T
from ..operators import zsets as Z
from ..sources import keyspace as K
from . import fold, replay

QUERIES = {}
ORACLE_SQL = {}

# the keyspace in SQL, as common table expressions
_CTE = {
    "kv": "SELECT 'cust:' || c_custkey AS key, c_name AS value FROM customer",
    "hf": "SELECT 'cust:' || c_custkey AS key, unnest(['name', 'nation', 'segment']) AS field, unnest([c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment]) AS value FROM customer",
    "le": "SELECT 'order:' || l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS value FROM lineitem",
    "ln": "SELECT key, pos, value, count(*) OVER (PARTITION BY key) AS n FROM le",
    "sm": "SELECT DISTINCT 'supp:' || l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS member FROM lineitem",
    "zm": "SELECT 'user:' || o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS member, o_totalprice AS score FROM orders",
    "zr": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev FROM zm",
    "xs": "SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 1000 ORDER BY event_id) - 1 AS seq, event_id, value FROM events",
    "jd": "SELECT 'ev:' || event_id AS key, props AS doc FROM events",
    "geo": "SELECT 'nation:' || c_nationkey AS key, CAST(c_custkey AS VARCHAR) AS member, (c_custkey * 37 % 36000) / 100.0 - 180 AS lng, (c_custkey * 53 % 17000) / 100.0 - 85 AS lat FROM customer",
    "bits": "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS key, user_id AS off FROM events",
    "ex": "SELECT 'order:' || o_orderkey AS key, o_orderstatus AS value, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE epoch_us(o_orderdate) // 1000 + 2592000000 END AS expire_at_ms FROM orders",
    "log": "SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, 'u:' || user_id AS key, event_type AS cmd, value AS arg FROM events",
}
_NEEDS = {"ln": ["le"], "zr": ["zm"]}
_NOW = 883_612_800_000  # 1998-01-01


def query(sql=None, uses=""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            names = list(dict.fromkeys(n for u in uses.split() for n in [*_NEEDS.get(u, []), u]))
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in names) + " " if names else "") + sql
        return f

    return add


@query("SELECT key, member, score, rev AS rank FROM zr WHERE rev < 3", "zr")
def zset_zrevrange_top3(spark, d):
    return Z.zrange(K.zm(spark, d), 0, 2, reverse=True).select("key", "member", "score", "rank")


# strings


@query("SELECT key, octet_length(encode(value)) AS len FROM kv", "kv")
def str_strlen(spark, d):
    return T.strlen(K.kv(spark, d))


@query("SELECT key, right(value, 4) AS value FROM kv", "kv")
def str_getrange(spark, d):
    return T.getrange(K.kv(spark, d), -4, -1).select("key", F.decode("value", "UTF-8").alias("value"))


@query("SELECT w.ord, w.key, kv.value FROM (SELECT range AS ord, 'cust:' || (range * 7) AS key FROM range(500)) w LEFT JOIN kv ON w.key = kv.key", "kv")
def str_mget(spark, d):
    wanted = spark.range(500).select(F.col("id").alias("ord"), F.concat(F.lit("cust:"), (F.col("id") * 7).cast("string")).alias("key"))
    return T.mget(K.kv(spark, d), wanted)


@query("SELECT key, value || '!' AS value FROM kv", "kv")
def str_append(spark, d):
    return T.append(K.kv(spark, d), "!")


@query("SELECT key, left(value, 2) || 'XYZ' || substr(value, 6) AS value FROM kv", "kv")
def str_setrange(spark, d):
    return T.setrange(K.kv(spark, d), 2, "XYZ").select("key", F.decode("value", "UTF-8").alias("value"))


@query("SELECT key, value FROM kv UNION ALL SELECT key, 'new' FROM (SELECT 'cust:' || range AS key FROM range(100000, 100020) UNION ALL SELECT 'cust:' || range FROM range(5)) n WHERE key NOT IN (SELECT key FROM kv)", "kv")
def str_setnx(spark, d):
    new = spark.range(100_000, 100_020).unionAll(spark.range(5)).select(F.concat(F.lit("cust:"), F.col("id").cast("string")).alias("key"), F.lit("new").alias("value"))
    return T.setnx(K.kv(spark, d), new)


@query("SELECT 'cust:' || o_custkey AS key, CAST(c_nationkey AS BIGINT) + count(*) AS value FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey, c_nationkey")
def str_incrby(spark, d):
    c = K.read(spark, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    by = K.read(spark, d, "orders").select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.lit(1).cast("long").alias("n"))
    return T.incrby(c, by)


@query("SELECT key FROM kv WHERE regexp_full_match(key, 'cust:1[0-4].*') AND key > 'cust:10' ORDER BY key LIMIT 25", "kv")
def key_scan_glob(spark, d):
    return T.scan(K.kv(spark, d), "cust:1[0-4]*", "cust:10", 25)


@query("SELECT 'string' AS type, count(DISTINCT key) AS keys FROM kv UNION ALL SELECT 'hash', count(DISTINCT key) FROM hf UNION ALL SELECT 'list', count(DISTINCT key) FROM le UNION ALL SELECT 'set', count(DISTINCT key) FROM sm UNION ALL SELECT 'zset', count(DISTINCT key) FROM zm UNION ALL SELECT 'stream', count(DISTINCT key) FROM xs", "kv hf le sm zm xs")
def key_type_counts(spark, d):
    return O.key_types(string=K.kv(spark, d), hash=K.hf(spark, d), list=K.le(spark, d), set=K.sm(spark, d), zset=K.zm(spark, d), stream=K.xs(spark, d))


# time to live


@query(f"SELECT key, CASE WHEN expire_at_ms = 0 THEN -1 WHEN expire_at_ms <= {_NOW} THEN -2 ELSE expire_at_ms - {_NOW} END AS ttl_ms FROM ex", "ex")
def key_ttl(spark, d):
    return O.ttl(K.expiring(spark, d), _NOW)


@query(f"SELECT key, value, expire_at_ms FROM ex WHERE expire_at_ms = 0 OR expire_at_ms > {_NOW}", "ex")
def expire_live_filter(spark, d):
    return O.alive(K.expiring(spark, d), _NOW)


@query(f"SELECT key, value, 0 AS expire_at_ms FROM ex WHERE expire_at_ms = 0 OR expire_at_ms > {_NOW}", "ex")
def expire_persist(spark, d):
    return O.persist(K.expiring(spark, d), _NOW)


# hashes


@query("SELECT key, value FROM hf WHERE field = 'segment'", "hf")
def hash_hget(spark, d):
    return H.hget(K.hf(spark, d), "segment")


@query("SELECT key, max(value) FILTER (field = 'name') AS name, max(value) FILTER (field = 'none') AS none FROM hf GROUP BY key", "hf")
def hash_hmget(spark, d):
    return H.hmget(K.hf(spark, d), ["name", "none"])


@query("SELECT key, string_agg(field || '=' || value, ';' ORDER BY field) AS fields FROM hf GROUP BY key", "hf")
def hash_hgetall(spark, d):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return H.hgetall(K.hf(spark, d)).select("key", F.array_join(pairs, ";").alias("fields"))


@query("SELECT key, count(*) AS n FROM hf GROUP BY key", "hf")
def hash_hlen(spark, d):
    return H.hlen(K.hf(spark, d))


@query("SELECT key, field, value FROM hf WHERE field <> 'name'", "hf")
def hash_hdel(spark, d):
    return H.hdel(K.hf(spark, d), ["name"])


@query("SELECT key, octet_length(encode(value)) AS len FROM hf WHERE field = 'segment'", "hf")
def hash_hstrlen(spark, d):
    return H.hstrlen(K.hf(spark, d), "segment")


@query("SELECT key, CAST(max(value) FILTER (field = 'nation') AS BIGINT) + 5 AS value FROM hf GROUP BY key", "hf")
def hash_hincrby(spark, d):
    return H.hincrby(K.hf(spark, d), "nation", 5)


# lists


@query("SELECT key, count(*) AS n FROM le GROUP BY key", "le")
def list_llen(spark, d):
    return L.llen(K.le(spark, d))


@query("SELECT key, pos, value FROM ln WHERE pos BETWEEN greatest(n - 3, 0) AND greatest(n - 2, 0)", "ln")
def list_lrange(spark, d):
    return L.lrange(K.le(spark, d), -3, -2)


@query("SELECT key, value FROM ln WHERE pos = n - 1", "ln")
def list_lindex_neg(spark, d):
    return L.lindex(K.le(spark, d), -1)


@query("SELECT key, min(pos) AS pos FROM le WHERE value = '7' GROUP BY key", "le")
def list_lpos(spark, d):
    return L.lpos(K.le(spark, d), "7")


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM (SELECT *, row_number() OVER (PARTITION BY key, value = '7' ORDER BY pos) AS k FROM le) WHERE value <> '7' OR k > 1", "le")
def list_lrem(spark, d):
    return L.lrem(K.le(spark, d), 1, "7")


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM ln WHERE pos BETWEEN 1 AND n - 2", "ln")
def list_ltrim(spark, d):
    return L.ltrim(K.le(spark, d), 1, -2)


@query("SELECT key, pos, value FROM le WHERE pos < 2", "le")
def list_lpop(spark, d):
    return L.lpop(K.le(spark, d), 2)


@query("SELECT key, pos, value FROM ln WHERE pos >= n - 2", "ln")
def list_rpop(spark, d):
    return L.rpop(K.le(spark, d), 2)


@query("SELECT key, pos, CASE WHEN pos = n - 1 THEN 'last' ELSE value END AS value FROM ln", "ln")
def list_lset(spark, d):
    return L.lset(K.le(spark, d), -1, "last")


# sets

_TWO = ["supp:1", "supp:2"]


@query("SELECT member FROM sm WHERE key = 'supp:1' INTERSECT SELECT member FROM sm WHERE key = 'supp:2'", "sm")
def set_sinter(spark, d):
    return S.sinter(K.sm(spark, d), _TWO)


@query("SELECT member FROM sm WHERE key = 'supp:1' UNION SELECT member FROM sm WHERE key = 'supp:2'", "sm")
def set_sunion(spark, d):
    return S.sunion(K.sm(spark, d), _TWO)


@query("SELECT member FROM sm WHERE key = 'supp:1' EXCEPT SELECT member FROM sm WHERE key = 'supp:2'", "sm")
def set_sdiff(spark, d):
    return S.sdiff(K.sm(spark, d), _TWO)


@query("SELECT least(count(*), 5) AS n FROM (SELECT member FROM sm WHERE key = 'supp:1' INTERSECT SELECT member FROM sm WHERE key = 'supp:2')", "sm")
def set_sintercard(spark, d):
    return S.sintercard(K.sm(spark, d), _TWO, 5)


@query("SELECT key, count(*) AS n FROM sm GROUP BY key", "sm")
def set_scard(spark, d):
    return S.scard(K.sm(spark, d))


@query("SELECT p.key, p.member, CASE WHEN sm.member IS NULL THEN 0 ELSE 1 END AS is_member FROM (SELECT 'supp:' || (range % 10) AS key, CAST(range AS VARCHAR) AS member FROM range(300)) p LEFT JOIN sm ON p.key = sm.key AND p.member = sm.member", "sm")
def set_smismember(spark, d):
    probes = spark.range(300).select(F.concat(F.lit("supp:"), (F.col("id") % 10).cast("string")).alias("key"), F.col("id").cast("string").alias("member"))
    return S.smismember(K.sm(spark, d), probes)


@query("SELECT key, member FROM sm QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('1/' || member), member) <= 3", "sm")
def set_srandmember(spark, d):
    return S.srandmember(K.sm(spark, d), 3, seed=1)


# sorted sets


@query("SELECT key, member, score, rank FROM zr", "zr")
def zset_zrank(spark, d):
    return Z.zrank(K.zm(spark, d))


@query("SELECT key, member, score, rank FROM zr WHERE rev < 2", "zr")
def zset_zrange_neg(spark, d):
    return Z.zrange(K.zm(spark, d), -2, -1)


@query("SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS k FROM zm WHERE score BETWEEN 50000 AND 150000) WHERE k BETWEEN 2 AND 4", "zm")
def zset_zrangebyscore_limit(spark, d):
    return Z.zrangebyscore(K.zm(spark, d), 50_000, 150_000, 1, 3)


@query("SELECT key, count(*) FILTER (score BETWEEN 50000 AND 150000) AS n FROM zm GROUP BY key", "zm")
def zset_zcount(spark, d):
    return Z.zcount(K.zm(spark, d), 50_000, 150_000)


@query("SELECT key, count(*) AS n FROM zm GROUP BY key", "zm")
def zset_zcard(spark, d):
    return Z.zcard(K.zm(spark, d))


@query("SELECT p.key, p.member, zm.score FROM (SELECT 'user:' || (range % 50) AS key, CAST(range AS VARCHAR) AS member FROM range(1000)) p LEFT JOIN zm ON p.key = zm.key AND p.member = zm.member", "zm")
def zset_zmscore(spark, d):
    probes = spark.range(1000).select(F.concat(F.lit("user:"), (F.col("id") % 50).cast("string")).alias("key"), F.col("id").cast("string").alias("member"))
    return Z.zscore(K.zm(spark, d), probes)


@query("SELECT key, member, score + 1.5 AS score FROM zm", "zm")
def zset_zincrby(spark, d):
    z = K.zm(spark, d)
    return Z.zincrby(z, z.select("key", "member", F.lit(1.5).alias("n")))


@query("SELECT key, member, greatest(score, 100000.0) AS score FROM zm", "zm")
def zset_zadd_gt(spark, d):
    z = K.zm(spark, d)
    return Z.zadd(z, z.select("key", "member", F.lit(100_000.0).alias("score")), "GT")


@query("SELECT key, member, score, rank FROM zr WHERE rank = 0", "zr")
def zset_zpopmin(spark, d):
    return Z.zpopmin(K.zm(spark, d))


@query("SELECT key, member, score FROM zr WHERE rank > 0", "zr")
def zset_zpopmin_remaining(spark, d):
    return Z.zpopmin_rest(K.zm(spark, d))


# streams

_FROM, _TO = 1_704_067_200_000, 1_704_110_400_000


@query(f"SELECT key, ms, seq, event_id, value FROM xs WHERE ms BETWEEN {_FROM} AND {_TO}", "xs")
def stream_xrange(spark, d):
    return X.xrange(K.xs(spark, d), _FROM, _TO)


@query("SELECT key, ms, seq, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM xs) WHERE r <= 5", "xs")
def stream_xrevrange(spark, d):
    return X.xrange(K.xs(spark, d), 0, 1 << 60, count=5, reverse=True)


@query("SELECT key, count(*) AS n FROM xs GROUP BY key", "xs")
def stream_xlen(spark, d):
    return X.xlen(K.xs(spark, d))


@query(f"SELECT key, ms, seq, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS r FROM xs WHERE ms > {_TO} OR (ms = {_TO} AND seq > 0)) WHERE r <= 4", "xs")
def stream_xread_cursor(spark, d):
    return X.xread(K.xs(spark, d), _TO, 0, 4)


@query("SELECT key, ms, seq, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r FROM xs) WHERE r <= 10", "xs")
def stream_xtrim_maxlen(spark, d):
    return X.xtrim(K.xs(spark, d), 10)


@query("SELECT key, count(*) AS n, min(ms) AS first_ms, arg_min(seq, ms * 1000 + seq) AS first_seq, max(ms) AS last_ms, arg_max(seq, ms * 1000 + seq) AS last_seq FROM xs GROUP BY key", "xs")
def stream_xinfo(spark, d):
    return X.xinfo(K.xs(spark, d))


@query("SELECT key, ms, seq, event_id, value FROM xs WHERE event_id % 3 <> 0", "xs")
def stream_pending_after_ack(spark, d):
    x = K.xs(spark, d)
    return X.pending(x, x.where("event_id % 3 = 0").select("key", "ms", "seq"), ["key", "ms", "seq"])


# JSON, geo, bitmaps


@query("SELECT key, json_extract_string(doc, '$.k') AS value FROM jd", "jd")
def json_get(spark, d):
    return O.json_get(K.jd(spark, d), "$.k")


@query("SELECT key, CASE json_type(doc, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' END AS type FROM jd", "jd")
def json_type(spark, d):
    return O.json_type(K.jd(spark, d), "$.k")


@query("SELECT key, CAST(json_extract_string(doc, '$.k') AS BIGINT) + 3 AS value FROM jd", "jd")
def json_numincrby(spark, d):
    return O.json_numincrby(K.jd(spark, d), "k", 3)


@query("SELECT key, len(json_keys(doc)) AS n FROM jd", "jd")
def json_objlen(spark, d):
    return O.json_objlen(K.jd(spark, d))


_CELL = ", c AS (SELECT key, member, CAST(round((lat + 90) / 180 * 67108863) AS BIGINT) AS y, CAST(round((lng + 180) / 360 * 67108863) AS BIGINT) AS x FROM geo), sc AS (SELECT key, member, CAST(list_sum(list_transform(range(26), lambda i: (((y >> i) & 1) << (2 * i)) + (((x >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS score FROM c)"


@query(_CELL + " SELECT key, member, score FROM sc", "geo")
def geo_encode(spark, d):
    return O.geoadd(K.geo(spark, d)).select("key", "member", "score")


_HAV = "2 * 6371000.0 * asin(sqrt(pow(sin((radians(20.0) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(20.0)) * pow(sin((radians(10.0) - radians(lng)) / 2), 2)))"


@query(f"SELECT key, member, round({_HAV}, 3) AS metres FROM geo", "geo")
def geo_geodist(spark, d):
    return O.geodist(K.geo(spark, d), 10.0, 20.0).select("key", "member", F.round("metres", 3).alias("metres"))


@query(f"SELECT key, member, round({_HAV}, 3) AS metres FROM geo WHERE {_HAV} <= 2000000", "geo")
def geo_search_radius(spark, d):
    return O.geosearch(K.geo(spark, d), 10.0, 20.0, 2_000_000).select("key", "member", F.round("metres", 3).alias("metres"))


@query("SELECT key, count(*) AS n FROM bits GROUP BY key", "bits")
def bit_bitcount(spark, d):
    return O.bitcount(K.bits(spark, d))


@query('SELECT key, min(off) AS "offset" FROM bits GROUP BY key', "bits")
def bit_bitpos(spark, d):
    return O.bitpos(K.bits(spark, d))


@query("SELECT off AS \"offset\" FROM bits WHERE key = '2024-01-01' INTERSECT SELECT off FROM bits WHERE key = '2024-01-02'", "bits")
def bit_bitop_and(spark, d):
    return O.bitop(K.bits(spark, d), "AND", ["2024-01-01", "2024-01-02"])


# sketches

_HLL = """, m AS (SELECT event_type, md5(CAST(user_id AS VARCHAR)) AS m FROM events),
p AS (SELECT event_type, CAST('0x' || substr(m, 13, 4) AS BIGINT) AS lo, CAST('0x' || substr(m, 1, 12) AS BIGINT) AS hi FROM m),
r AS (SELECT event_type, lo & 16383 AS idx, max(CASE WHEN ((hi << 2) | (lo >> 14)) = 0 THEN 51 ELSE 51 - length(bin((hi << 2) | (lo >> 14))) END) AS rank FROM p GROUP BY ALL),
z AS (SELECT event_type, sum(pow(2.0, -rank)) + (16384 - count(*)) AS z, 16384 - count(*) AS v FROM r GROUP BY event_type)
SELECT event_type, CAST(round(CASE WHEN 0.7213 / (1 + 1.079 / 16384.0) * 16384.0 * 16384.0 / z <= 2.5 * 16384 AND v > 0 THEN 16384.0 * ln(16384.0 / v) ELSE 0.7213 / (1 + 1.079 / 16384.0) * 16384.0 * 16384.0 / z END) AS BIGINT) AS n FROM z"""


@query(_HLL, "log")
def hll_pfcount_exact(spark, d):
    return O.pfcount(O.hll_registers(K.read(spark, d, "events"), "event_type", F.col("user_id")), "event_type")


_CMS = """, cells AS (SELECT row, CAST('0x' || substr(md5(row || ':' || l_partkey), 1, 12) AS BIGINT) % 512 AS col, count(*) AS n FROM lineitem, range(4) t(row) GROUP BY ALL)
SELECT e, min(coalesce(n, 0)) AS n FROM (SELECT CAST(p AS VARCHAR) AS e, row, CAST('0x' || substr(md5(row || ':' || p), 1, 12) AS BIGINT) % 512 AS col FROM range(200) a(p), range(4) t(row)) q
LEFT JOIN cells USING (row, col) GROUP BY e"""


@query(_CMS, "log")
def cms_query(spark, d):
    cells = O.cms_cells(K.read(spark, d, "lineitem"), F.col("l_partkey"), 512, 4)
    return O.cms_query(cells, spark.range(200).select(F.col("id").cast("string").alias("e")), 512, 4)


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 10")
def topk_exact(spark, d):
    return O.topk(K.read(spark, d, "lineitem"), "l_partkey", 10)


@query("SELECT range AS c_custkey, CASE WHEN range IN (SELECT c_custkey FROM customer) THEN 1 ELSE 0 END AS maybe FROM range(100)")
def bloom_membership(spark, d):
    return O.bloom_maybe(K.read(spark, d, "customer"), "c_custkey", spark.range(100).withColumnRenamed("id", "c_custkey"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice, 0.99), 4) AS q99 FROM lineitem GROUP BY l_returnflag")
def quantile_exact(spark, d):
    q = O.quantiles(K.read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", [0.5, 0.99])
    return q.select("l_returnflag", F.round("q50", 4).alias("q50"), F.round("q99", 4).alias("q99"))


@query("SELECT l_returnflag, round(count(*) FILTER (l_extendedprice <= 30000) / count(*), 9) AS share FROM lineitem GROUP BY l_returnflag")
def cdf_exact(spark, d):
    return O.cdf(K.read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 30_000).select("l_returnflag", F.round("share", 9).alias("share"))


# the log


@query("SELECT key, cmd, count(*) AS n FROM log GROUP BY key, cmd", "log")
def fold_counters(spark, d):
    return fold.counters(K.cmdlog(spark, d))


@query("SELECT key, arg_max(arg, seq) AS value, max(seq) AS seq FROM log GROUP BY key", "log")
def fold_last_write(spark, d):
    return fold.last_write(K.cmdlog(spark, d))


@query("SELECT key, arg_min(arg, seq) AS value FROM log GROUP BY key", "log")
def fold_first_write(spark, d):
    return fold.first_write(K.cmdlog(spark, d))


@query("SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key, cmd ORDER BY seq DESC) = 1", "log")
def fold_compact(spark, d):
    return fold.compact(K.cmdlog(spark, d), ["key", "cmd"])


_RATE = """, b AS (SELECT key, ts_ms // 3600000 AS bucket, count(*) AS n FROM log GROUP BY ALL),
p AS (SELECT *, lag(bucket) OVER w AS pb, lag(n) OVER w AS pn FROM b WINDOW w AS (PARTITION BY key ORDER BY bucket)),
e AS (SELECT key, bucket, n, CAST(n + CASE WHEN pb = bucket - 1 THEN pn ELSE 0 END * 0.5 AS DOUBLE) AS estimate FROM p)
SELECT *, CAST(estimate <= 2 AS BIGINT) AS allowed FROM e"""


@query(_RATE, "log")
def ratelimit_buckets(spark, d):
    return O.ratelimit_windows(K.cmdlog(spark, d), 3_600_000, 2)


@query("SELECT key, seq, coalesce(lead(ts_ms) OVER (PARTITION BY key ORDER BY ts_ms, seq) - ts_ms, -1) AS held_ms FROM log", "log")
def lock_intervals(spark, d):
    return O.lock_spans(K.cmdlog(spark, d))


# writes, cursors and moves


def _named(spark, prefix, start, stop, value="new"):
    return spark.range(start, stop).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key"), F.lit(value).alias("value"))


_NEW = "n AS (SELECT 'cust:' || range AS key, 'new' AS value FROM range(140, 170))"


@query(f", {_NEW} SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT key, value FROM n", "kv")
def str_mset(spark, d):
    return T.mset(K.kv(spark, d), _named(spark, "cust:", 140, 170))


@query(f", {_NEW} SELECT key, value FROM kv UNION ALL SELECT key, value FROM n WHERE NOT EXISTS (SELECT 1 FROM kv JOIN n USING (key))", "kv")
def str_msetnx(spark, d):
    return T.msetnx(K.kv(spark, d), _named(spark, "cust:", 140, 170))


@query(f", {_NEW} SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM n)", "kv")
def key_del(spark, d):
    return T.delete(K.kv(spark, d), _named(spark, "cust:", 140, 170).select("key"))


@query(f", {_NEW} SELECT count(*) AS n FROM n WHERE key IN (SELECT key FROM kv)", "kv")
def key_exists(spark, d):
    return T.exists(K.kv(spark, d), _named(spark, "cust:", 140, 170).select("key"))


@query("SELECT 'cust:' || c_custkey AS key, c_acctbal + 0.5 AS value FROM customer")
def str_incrbyfloat(spark, d):
    return T.incrbyfloat(K.read(spark, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_acctbal").cast("string").alias("value")), 0.5)


@query(f", {_NEW} SELECT n.key, kv.value AS old, n.value FROM n LEFT JOIN kv USING (key)", "kv")
def str_getset(spark, d):
    return T.getset(K.kv(spark, d), _named(spark, "cust:", 140, 170))


@query("SELECT 'cust:' || c_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 'x' ELSE c_mktsegment END AS value, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS swapped FROM customer")
def str_cas(spark, d):
    kv = K.read(spark, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_mktsegment").alias("value"))
    return T.cas(kv, kv.select("key", F.lit("BUILDING").alias("expected"), F.lit("x").alias("new")))


def _names(spark):
    return spark.range(20).select(F.concat(F.lit("cust:"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("cust:"), (F.col("id") + 100).cast("string")).alias("to"))


_NAMES = "names AS (SELECT 'cust:' || range AS key, 'cust:' || (range + 100) AS dst FROM range(20))"


@query(f", {_NAMES}, m AS (SELECT key, dst, value FROM names JOIN kv USING (key)) SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM m UNION ALL SELECT dst FROM m) UNION ALL SELECT dst, value FROM m", "kv")
def key_rename(spark, d):
    return T.rename(K.kv(spark, d), _names(spark))


@query(f", {_NAMES}, m AS (SELECT key, dst, value FROM names JOIN kv USING (key) WHERE dst NOT IN (SELECT key FROM kv)) SELECT key, value FROM kv WHERE key NOT IN (SELECT key FROM m) UNION ALL SELECT dst, value FROM m", "kv")
def key_renamenx(spark, d):
    return T.rename(K.kv(spark, d), _names(spark), only_new=True)


@query(f", {_NAMES}, m AS (SELECT dst, value FROM names JOIN kv USING (key)) SELECT key, value FROM kv WHERE key NOT IN (SELECT dst FROM m) UNION ALL SELECT dst, value FROM m", "kv")
def key_copy_replace(spark, d):
    return T.copy(K.kv(spark, d), _names(spark), replace=True)


@query("SELECT key, octet_length(encode(key)) + octet_length(encode(value)) AS bytes FROM kv", "kv")
def key_memory_usage(spark, d):
    return T.memory_usage(K.kv(spark, d))


@query("SELECT split_part(key, ':', 1) AS prefix, count(*) AS n FROM kv GROUP BY ALL", "kv")
def key_prefixes(spark, d):
    return T.prefixes(K.kv(spark, d))


@query("SELECT CAST('0x' || substr(md5(key), 1, 8) AS BIGINT) % 1024 AS slot, count(*) AS n FROM kv GROUP BY ALL", "kv")
def key_slots(spark, d):
    return T.keyslots(K.kv(spark, d))


@query(f"SELECT key, value, CASE WHEN expire_at_ms = 0 OR 900000000000 > expire_at_ms THEN 900000000000 ELSE expire_at_ms END AS expire_at_ms FROM ex WHERE expire_at_ms = 0 OR expire_at_ms > {_NOW}", "ex")
def expire_gt(spark, d):
    return O.expire(K.expiring(spark, d), 900_000_000_000, "GT", _NOW)


@query(f"SELECT key, value, CASE WHEN expire_at_ms = 0 THEN 900000000000 ELSE expire_at_ms END AS expire_at_ms FROM ex WHERE expire_at_ms = 0 OR expire_at_ms > {_NOW}", "ex")
def expire_nx(spark, d):
    return O.expire(K.expiring(spark, d), 900_000_000_000, "NX", _NOW)


def _tier(spark):
    return _named(spark, "cust:", 100, 200, "gold").select("key", F.lit("segment").alias("field"), "value")


_TIER = "n AS (SELECT 'cust:' || range AS key, 'segment' AS field, 'gold' AS value FROM range(100, 200))"


@query(f", {_TIER} SELECT * FROM hf WHERE (key, field) NOT IN (SELECT key, field FROM n) UNION ALL SELECT * FROM n", "hf")
def hash_hset(spark, d):
    return H.hset(K.hf(spark, d), _tier(spark))


@query(f", {_TIER} SELECT * FROM hf UNION ALL SELECT * FROM n WHERE (key, field) NOT IN (SELECT key, field FROM hf)", "hf")
def hash_hsetnx(spark, d):
    return H.hset(K.hf(spark, d), _tier(spark), only_new=True)


@query("SELECT key, 1 AS found FROM hf GROUP BY key", "hf")
def hash_hexists(spark, d):
    return H.hexists(K.hf(spark, d), "segment")


@query("SELECT key, field FROM hf", "hf")
def hash_hkeys(spark, d):
    return H.hkeys(K.hf(spark, d))


@query("SELECT key, value FROM hf", "hf")
def hash_hvals(spark, d):
    return H.hvals(K.hf(spark, d))


@query("SELECT key, CAST(max(value) FILTER (field = 'nation') AS DOUBLE) + 0.25 AS value FROM hf GROUP BY key", "hf")
def hash_hincrbyfloat(spark, d):
    return H.hincrbyfloat(K.hf(spark, d), "nation", 0.25)


@query("SELECT key, field, value FROM hf WHERE field IN ('name', 'nation') QUALIFY row_number() OVER (PARTITION BY key ORDER BY field) = 2", "hf")
def hash_hscan(spark, d):
    return H.hscan(K.hf(spark, d), cursor=1, count=1, match="na*")


@query("SELECT key, field, value FROM hf QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('1/' || field), field) <= 2", "hf")
def hash_hrandfield(spark, d):
    return H.hrandfield(K.hf(spark, d), 2, seed=1)


def _items(spark):
    return spark.range(300).select(F.concat(F.lit("order:"), (F.col("id") % 100).cast("string")).alias("key"), F.col("id").alias("ord"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("value"))


_ITEMS = "i AS (SELECT 'order:' || (range % 100) AS key, range AS ord, 'n' || range AS value FROM range(300))"


@query(f", {_ITEMS} SELECT key, row_number() OVER (PARTITION BY key ORDER BY side, pos) - 1 AS pos, value FROM (SELECT key, 1 AS side, pos, value FROM le UNION ALL SELECT key, 2, ord, value FROM i)", "le")
def list_rpush(spark, d):
    return L.push(K.le(spark, d), _items(spark))


@query(f", {_ITEMS} SELECT key, row_number() OVER (PARTITION BY key ORDER BY side, pos) - 1 AS pos, value FROM (SELECT key, 1 AS side, pos, value FROM le UNION ALL SELECT key, 0, -ord, value FROM i WHERE key IN (SELECT key FROM le))", "le")
def list_lpushx(spark, d):
    return L.push(K.le(spark, d), _items(spark), left=True, only_old=True)


@query(", found AS (SELECT key, min(pos) AS p FROM le WHERE value = '7' GROUP BY key) SELECT key, pos + CASE WHEN pos > p THEN 1 ELSE 0 END AS pos, value FROM le LEFT JOIN found USING (key) UNION ALL SELECT key, p + 1, 'in' FROM found", "le")
def list_linsert_after(spark, d):
    return L.linsert(K.le(spark, d), "7", "in", after=True)


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM (SELECT key, pos, value FROM le WHERE key <> 'order:1' OR pos > 0 UNION ALL SELECT 'order:2', 1000000, value FROM le WHERE key = 'order:1' AND pos = 0)", "le")
def list_lmove(spark, d):
    return L.lmove(K.le(spark, d), "order:1", "order:2")


@query("SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM (SELECT key, pos, value FROM ln WHERE key <> 'order:1' OR pos < n - 1 UNION ALL SELECT 'order:2', -1, value FROM ln WHERE key = 'order:1' AND pos = n - 1)", "ln")
def list_rpoplpush(spark, d):
    return L.lmove(K.le(spark, d), "order:1", "order:2", from_left=False, to_left=True)


@query("SELECT key, pos FROM le WHERE value = '7' QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) <= 2", "le")
def list_lpos_rank(spark, d):
    return L.lpos_all(K.le(spark, d), "7", rank=-1, count=2)


def _parts(spark):
    return spark.range(400).select(F.concat(F.lit("supp:"), (F.col("id") % 12).cast("string")).alias("key"), F.col("id").cast("string").alias("member"))


_PARTS = "p AS (SELECT 'supp:' || (range % 12) AS key, CAST(range AS VARCHAR) AS member FROM range(400))"


@query(f", {_PARTS} SELECT key, member FROM sm UNION SELECT key, member FROM p", "sm")
def set_sadd(spark, d):
    return S.sadd(K.sm(spark, d), _parts(spark))


@query(f", {_PARTS} SELECT key, member FROM sm EXCEPT SELECT key, member FROM p", "sm")
def set_srem(spark, d):
    return S.srem(K.sm(spark, d), _parts(spark))


@query("SELECT key, member FROM sm WHERE NOT (key = 'supp:1' AND member = '7') UNION SELECT 'supp:2', member FROM sm WHERE key = 'supp:1' AND member = '7'", "sm")
def set_smove(spark, d):
    return S.smove(K.sm(spark, d), "supp:1", "supp:2", "7")


@query("SELECT key, member FROM sm WHERE key <> 'supp:3' UNION ALL (SELECT 'supp:3', member FROM sm WHERE key = 'supp:1' EXCEPT SELECT 'supp:3', member FROM sm WHERE key = 'supp:2')", "sm")
def set_sdiffstore(spark, d):
    s = K.sm(spark, d)
    return S.store(s, "supp:3", S.sdiff(s, _TWO))


@query("SELECT key, member FROM sm WHERE starts_with(member, '1') QUALIFY row_number() OVER (PARTITION BY key ORDER BY member) BETWEEN 6 AND 15", "sm")
def set_sscan(spark, d):
    return S.sscan(K.sm(spark, d), 5, 10, "1*")


@query("SELECT key, member FROM sm QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('1/' || member), member) > 2", "sm")
def set_spop(spark, d):
    return S.spop(K.sm(spark, d), 2, seed=1)


@query("SELECT key, member, score FROM zm WHERE CAST(member AS BIGINT) >= 100", "zm")
def zset_zrem(spark, d):
    return Z.zrem(K.zm(spark, d), K.zm(spark, d).where("cast(member AS BIGINT) < 100").select("key", "member"))


@query("SELECT key, member, score, rev AS rank FROM zr WHERE rev < 2", "zr")
def zset_zpopmax(spark, d):
    return Z.zpopmax(K.zm(spark, d), 2)


@query("SELECT key, member, score FROM zm WHERE score BETWEEN 50000 AND 150000 QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) BETWEEN 2 AND 3", "zm")
def zset_zrevrangebyscore(spark, d):
    return Z.zrevrangebyscore(K.zm(spark, d), 150_000, 50_000, 1, 2)


@query("SELECT key, member, score FROM zm QUALIFY row_number() OVER (PARTITION BY key ORDER BY member) BETWEEN 3 AND 6", "zm")
def zset_zscan(spark, d):
    return Z.zscan(K.zm(spark, d), 2, 4)


@query("SELECT key, member, score FROM zm QUALIFY row_number() OVER (PARTITION BY key ORDER BY md5('1/' || member), member) <= 3", "zm")
def zset_zrandmember(spark, d):
    return Z.zrandmember(K.zm(spark, d), 3, seed=1)


_XS = "key, ms, seq, event_id, value"


@query(f"SELECT {_XS} FROM xs WHERE event_id % 5 <> 0", "xs")
def stream_xdel(spark, d):
    x = K.xs(spark, d)
    return X.xdel(x, x.where("event_id % 5 = 0").select("key", "ms", "seq"))


@query(f"SELECT {_XS} FROM xs WHERE ms >= {_TO}", "xs")
def stream_xtrim_minid(spark, d):
    return X.xtrim_minid(K.xs(spark, d), _TO)


@query(f", old AS (SELECT * FROM xs WHERE event_id % 2 = 0), top AS (SELECT key, max(ms) AS top FROM old GROUP BY key) SELECT {_XS} FROM old UNION ALL SELECT {_XS} FROM xs LEFT JOIN top USING (key) WHERE event_id % 2 = 1 AND (top IS NULL OR ms > top OR (ms = top AND seq > (SELECT max(seq) FROM old WHERE old.key = xs.key AND old.ms = top)))", "xs")
def stream_xadd(spark, d):
    x = K.xs(spark, d)
    return X.xadd(x.where("event_id % 2 = 0"), x.where("event_id % 2 = 1"))


@query(f", g AS (SELECT key, grp, {_FROM} + 3600000 * length(grp) AS last FROM (SELECT DISTINCT key FROM xs), (VALUES ('a'), ('bb')) v(grp)) SELECT {_XS}, grp FROM xs JOIN g USING (key) WHERE ms > last OR (ms = last AND seq > 0) QUALIFY row_number() OVER (PARTITION BY key, grp ORDER BY ms, seq) <= 7", "xs")
def stream_xreadgroup(spark, d):
    x = K.xs(spark, d)
    groups = x.select("key").distinct().withColumn("grp", F.explode(F.array(F.lit("a"), F.lit("bb"))))
    cursors = groups.select("key", "grp", (F.lit(_FROM) + F.length("grp") * 3_600_000).alias("ms"), F.lit(0).cast("long").alias("seq"))
    return X.xreadgroup(x, cursors, 7)


@query(f"SELECT {_XS} FROM xs WHERE event_id % 3 <> 0 AND ms >= {_TO}", "xs")
def stream_xreadgroup_pending(spark, d):
    x = K.xs(spark, d)
    return X.xreadgroup_again(x, x.where("event_id % 3 = 0").select("key", "ms", "seq"), _TO)


@query("SELECT key, '{\"k\":7}' AS doc FROM jd", "jd")
def json_set(spark, d):
    return J.json_set(K.jd(spark, d), "k", "7")


@query("SELECT key, '{\"k\":' || json_extract_string(doc, '$.k') || ',\"z\":\"q\"}' AS doc FROM jd", "jd")
def json_set_nx(spark, d):
    return J.json_set(K.jd(spark, d), "z", '"q"', "NX")


@query("SELECT key, '{}' AS doc FROM jd", "jd")
def json_del(spark, d):
    return J.json_del(K.jd(spark, d), "k")


@query("SELECT key, '{\"k\":0}' AS doc FROM jd", "jd")
def json_clear(spark, d):
    return J.json_clear(K.jd(spark, d), "k")


_FLAGS = "SELECT 'n:' || c_custkey AS key, '{\"l\":[' || c_custkey || ',2],\"on\":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || ',\"s\":\"' || c_name || '\"}' AS doc FROM customer"


def _flags(spark, d):
    c = K.read(spark, d, "customer")
    k = F.col("c_custkey").cast("string")
    on = F.when(F.col("c_custkey") % 2 == 0, "true").otherwise("false")
    return c.select(F.concat(F.lit("n:"), k).alias("key"), F.concat(F.lit('{"l":['), k, F.lit(',2],"on":'), on, F.lit(',"s":"'), "c_name", F.lit('"}')).alias("doc"))


@query(f"SELECT key, CASE WHEN contains(doc, ':true') THEN replace(doc, ':true', ':false') ELSE replace(doc, ':false', ':true') END AS doc FROM ({_FLAGS})")
def json_toggle(spark, d):
    return J.json_toggle(_flags(spark, d), "on")


@query(f"SELECT key, replace(doc, ',2]', ',2,3]') AS doc FROM ({_FLAGS})")
def json_arrappend(spark, d):
    return J.json_arrappend(_flags(spark, d), "l", "3")


@query(f"SELECT key, json_array_length(doc, '$.l') AS n FROM ({_FLAGS})")
def json_arrlen(spark, d):
    return J.json_arrlen(_flags(spark, d), "l")


@query(f"SELECT key, length(json_extract_string(doc, '$.s')) AS n FROM ({_FLAGS})")
def json_strlen(spark, d):
    return J.json_strlen(_flags(spark, d), "s")


@query(f"SELECT key, unnest(json_keys(doc)) AS field FROM ({_FLAGS})")
def json_objkeys(spark, d):
    return J.json_objkeys(_flags(spark, d))


@query("SELECT w.ord, w.key, json_extract(doc, '$.k') AS value FROM (SELECT range AS ord, 'ev:' || (range * 7) AS key FROM range(300)) w LEFT JOIN jd USING (key)", "jd")
def json_mget(spark, d):
    wanted = spark.range(300).select(F.col("id").alias("ord"), F.concat(F.lit("ev:"), (F.col("id") * 7).cast("string")).alias("key"))
    return J.json_mget(K.jd(spark, d), wanted, "k")


@query("SELECT key, member, lng, lat FROM geo WHERE abs(lat - 20.0) <= 3000000 / 2 / 111320.0 AND abs(lng - 10.0) <= 4000000 / 2 / (111320.0 * cos(radians(20.0)))", "geo")
def geo_search_box(spark, d):
    return O.geosearch_box(K.geo(spark, d), 10.0, 20.0, 4_000_000, 3_000_000)


def _between(lng, lat):
    return f"2 * 6371000.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians({lng}) - radians({lat})) / 2), 2)))"


@query(f"SELECT a.key, a.member, round({_between('b.lng', 'a.lng')}, 3) AS metres FROM geo a JOIN geo b ON a.key = b.key AND b.member = '7' WHERE {_between('b.lng', 'a.lng')} <= 9000000 QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY metres, a.member) <= 3", "geo")
def geo_search_member(spark, d):
    return O.geosearch_member(K.geo(spark, d), "7", 9_000_000, 3).select("key", "member", F.round("metres", 3).alias("metres"))


@query(_CELL + " SELECT key, member, array_to_string(list_transform(range(11), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(((CAST(score AS HUGEINT) * 8) // pow(32, 10 - i)::HUGEINT) % 32 AS INT) + 1, 1)), '') AS geohash FROM sc", "geo")
def geo_hash(spark, d):
    return O.geohash(O.geoadd(K.geo(spark, d)))


@query("SELECT key, member, round(lng, 4) AS lng, round(lat, 4) AS lat FROM geo", "geo")
def geo_geopos(spark, d):
    return O.geopos(O.geoadd(K.geo(spark, d))).select("key", "member", F.round("lng", 4).alias("lng"), F.round("lat", 4).alias("lat"))


@query('SELECT key, off AS "offset" FROM bits UNION SELECT DISTINCT key, 5 FROM bits', "bits")
def bit_setbit(spark, d):
    return O.setbit(K.bits(spark, d), 5, True)


@query("SELECT key, max(CAST(off = 5 AS BIGINT)) AS bit FROM bits GROUP BY key", "bits")
def bit_getbit(spark, d):
    return O.getbit(K.bits(spark, d), 5)


@query("SELECT key, count(*) FILTER (off // 8 >= 1 AND off // 8 <= greatest(m // 8 - 1, 0)) AS n FROM (SELECT *, max(off) OVER (PARTITION BY key) AS m FROM bits) GROUP BY key", "bits")
def bit_bitcount_range(spark, d):
    return O.bitcount_range(K.bits(spark, d), 1, -2)


@query('SELECT off AS "offset" FROM bits WHERE key IN (\'2024-01-01\', \'2024-01-02\') GROUP BY off HAVING count(*) = 1', "bits")
def bit_bitop_xor(spark, d):
    return O.bitop(K.bits(spark, d), "XOR", ["2024-01-01", "2024-01-02"])


@query('SELECT key, off AS "offset" FROM (SELECT key, unnest(range(0, max(off) // 8 * 8 + 8)) AS off FROM bits GROUP BY key) EXCEPT SELECT key, off FROM bits', "bits")
def bit_bitop_not(spark, d):
    return O.bitnot(K.bits(spark, d))


@query(_HLL.replace("event_type, md5", "'all' AS event_type, md5").replace("event_type,", "event_type,", 1), "log")
def hll_pfmerge(spark, d):
    parts = O.hll_registers(K.read(spark, d, "events"), "event_type", F.col("user_id"))
    return O.pfcount(O.pfmerge(parts.withColumn("event_type", F.lit("all")), "event_type"), "event_type")


@query(""", c AS (SELECT row, CAST('0x' || substr(md5(row || ':' || l_partkey), 1, 12) AS BIGINT) % 512 AS col, sum(CASE WHEN l_returnflag = 'R' THEN 3 ELSE -1 END) AS n FROM lineitem, range(4) t(row) WHERE l_returnflag IN ('R', 'N') GROUP BY ALL)
SELECT row, col, greatest(n, 0) AS n FROM c""", "log")
def cms_merge(spark, d):
    li = K.read(spark, d, "lineitem")
    return O.cms_merge([(O.cms_cells(li.where(F.col("l_returnflag") == f), F.col("l_partkey"), 512, 4), w) for f, w in (("R", 3), ("N", -1))])


@query("SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY l_suppkey, l_partkey QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_partkey) <= 3")
def topk_by_key(spark, d):
    return O.topk_by(K.read(spark, d, "lineitem"), "l_suppkey", "l_partkey", 3)


def _cuckoo(e):
    at = lambda x, i: f"CAST('0x' || substr(md5({x}), {i}, 8) AS BIGINT)"
    return f"SELECT {e} AS e, {at(e, 1)} % 65535 + 1 AS mark, {at(e, 9)} % 1024 AS one, xor(one, {at('CAST(mark AS VARCHAR)', 1)} % 1024) AS two"


@query(f", c AS (SELECT mark, least(one, two) AS low, greatest(one, two) AS high, count(*) AS n FROM ({_cuckoo('CAST(l_partkey AS VARCHAR)')} FROM lineitem) GROUP BY ALL), p AS ({_cuckoo('CAST(range AS VARCHAR)')} FROM range(200)) SELECT e, coalesce(n, 0) AS n FROM p LEFT JOIN c ON p.mark = c.mark AND least(one, two) = low AND greatest(one, two) = high", "log")
def cuckoo_count(spark, d):
    cells = O.cuckoo_cells(K.read(spark, d, "lineitem"), F.col("l_partkey"), 1024)
    return O.cuckoo_count(cells, spark.range(200).select(F.col("id").cast("string").alias("e")), 1024)


@query("SELECT l_returnflag, count(*) FILTER (l_quantity < 20) AS below, count(*) FILTER (l_quantity > 20) AS above FROM lineitem GROUP BY ALL")
def tdigest_rank(spark, d):
    return O.rank_of(K.read(spark, d, "lineitem"), "l_returnflag", "l_quantity", 20)


@query("SELECT l_returnflag, l_extendedprice AS value FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) = 11")
def tdigest_byrevrank(spark, d):
    return O.by_rank(K.read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", 10, reverse=True)


@query(", c AS (SELECT l_returnflag, l_quantity AS v, count(*) AS w FROM lineitem GROUP BY ALL), u AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v) AS u, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM c), p AS (SELECT *, greatest(least(u, t * 0.9) - greatest(u - w, t * 0.1), 0) AS p FROM u) SELECT l_returnflag, round(CAST(sum(v * p) / sum(p) AS DOUBLE), 6) AS mean FROM p GROUP BY ALL", "log")
def tdigest_trimmed_mean(spark, d):
    out = O.trimmed_mean(K.read(spark, d, "lineitem"), "l_returnflag", "l_quantity", 0.1, 0.9)
    return out.select("l_returnflag", F.round("mean", 6).alias("mean"))


@query("SELECT l_returnflag, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY ALL")
def tdigest_extremes(spark, d):
    return O.extremes(K.read(spark, d, "lineitem"), "l_returnflag", "l_extendedprice")


@query("SELECT event_id, event_type AS channel, p AS pattern FROM events, (VALUES ('c*', '^c'), ('*e[!x]*', 'e[^x]'), ('view', '^view$')) v(p, r) WHERE regexp_matches(event_type, r)")
def pubsub_patterns(spark, d):
    e = K.read(spark, d, "events").select("event_id", F.col("event_type").alias("channel"))
    return O.publish_patterns(e, ["c*", "*e[!x]*", "view"])


@query("SELECT channel, coalesce(n, 0) AS n FROM (VALUES ('click'), ('none')) c(channel) LEFT JOIN (SELECT event_type AS channel, count(DISTINCT user_id) AS n FROM events GROUP BY ALL) USING (channel)")
def pubsub_numsub(spark, d):
    subs = K.read(spark, d, "events").select(F.col("event_type").alias("channel"), F.col("user_id").alias("subscriber"))
    return O.numsub(subs, spark.createDataFrame([("click",), ("none",)], "channel string"))


@query("SELECT seq, '__keyspace@0__:' || key AS channel, cmd AS message FROM log UNION ALL SELECT seq, '__keyevent@0__:' || cmd, key FROM log", "log")
def keyspace_notifications(spark, d):
    return O.keyspace_events(K.cmdlog(spark, d))


@query('SELECT range AS shard, range * 256 AS "first", range * 256 + 255 AS "last" FROM range(4)')
def cluster_slots(spark, d):
    return O.slot_ranges(spark.range(1024).select(F.col("id").alias("slot"), F.floor(F.col("id") / 256).alias("shard")))


# commands that depend on those before them


@query()
def replay_ratelimit(spark, d):
    return replay.ratelimit(K.cmdlog(spark, d).select("seq", "ts_ms", "key", F.lit(1).cast("long").alias("n")), 86_400_000, 2)


@query()
def replay_locks(spark, d):
    cmd = F.when(F.col("cmd") == "error", "unlock").when(F.col("cmd") == "view", "extend").otherwise("lock")
    owner = F.concat(F.lit("o"), (F.col("seq") % 3).cast("string"))
    return replay.locks(K.cmdlog(spark, d).select("seq", "ts_ms", "key", cmd.alias("cmd"), owner.alias("owner"), F.lit(86_400_000).cast("long").alias("ttl_ms")))


_CAS_SQL = ", s AS (SELECT seq, key, cmd, row_number() OVER (PARTITION BY key ORDER BY ts_ms, seq) AS r FROM log) SELECT seq, key, CAST(r = 1 AS BIGINT) AS swapped, first_value(cmd) OVER (PARTITION BY key ORDER BY r) AS value FROM s"


@query(_CAS_SQL, "log")
def replay_set_if_missing(spark, d):
    return replay.compare_and_set(K.cmdlog(spark, d).select("seq", "ts_ms", "key", F.lit(None).cast("string").alias("expected"), F.col("cmd").alias("new")))


def _fields_expiring(spark, d):
    return K.hf(spark, d).withColumn("expire_at_ms", F.when(F.col("field") == "segment", F.lit(_NOW + 5000)).when(F.col("field") == "nation", F.lit(_NOW - 1)).otherwise(F.lit(0)).cast("long"))


@query("SELECT key, field, CASE field WHEN 'segment' THEN 5000 WHEN 'nation' THEN -2 ELSE -1 END AS ttl_ms FROM hf", "hf")
def hash_httl(spark, d):
    return H.httl(_fields_expiring(spark, d), _NOW)


@query(f"SELECT key, field, value, CASE field WHEN 'segment' THEN {_NOW + 9} WHEN 'nation' THEN {_NOW - 1} ELSE {_NOW + 9} END AS expire_at_ms FROM hf", "hf")
def hash_hexpire(spark, d):
    return H.hexpire(_fields_expiring(spark, d), ["name", "segment"], _NOW + 9)


@query("SELECT key, field, value, 0 AS expire_at_ms FROM hf WHERE field <> 'nation'", "hf")
def hash_hpersist_live(spark, d):
    return O.alive(H.hexpire(_fields_expiring(spark, d), ["segment"], 0), _NOW)


from . import commands  # noqa: E402, F401  more queries, registered by it
