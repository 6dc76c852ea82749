"""The driver's tables as a keyspace: strings, hashes, lists, sets, sorted sets, streams, JSON, geo, bits and a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def millis(ts):
    """Timestamps load without a zone; taken as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def _key(prefix: str, col: str):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def kv(spark, d) -> DataFrame:
    """key, value: the name of each customer."""
    return read(spark, d, "customer").select(_key("cust:", "c_custkey").alias("key"), F.col("c_name").alias("value"))


def hf(spark, d) -> DataFrame:
    """key, field, value: each customer as a hash."""
    c = read(spark, d, "customer")
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(x).cast("string").alias("value")) for f, x in (("name", "c_name"), ("nation", "c_nationkey"), ("segment", "c_mktsegment"))))
    return c.select(_key("cust:", "c_custkey").alias("key"), F.inline(fields))


def le(spark, d) -> DataFrame:
    """key, pos, value: the parts of each order, as a list. Lines aren't unique, so the place is a rank."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return read(spark, d, "lineitem").select(_key("order:", "l_orderkey").alias("key"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("l_partkey").cast("string").alias("value"))


#: Fixed value: partitions for each split of the files, 16 MB of file each at Spark's splits of 128 MB.
DEALT = 8


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows as they are read, dealt by columns over a number of partitions that grows with the files. What a task then holds
    keeps its size, as it wouldn't with a fixed number; Spark's own merging of partitions leaves these alone."""
    return rows.repartition(DEALT * rows.rdd.getNumPartitions(), *by)


def sm(spark, d) -> DataFrame:
    """key, member: the parts each supplier delivers, as a set. Pairs seldom repeat within a split, so they are dealt out
    before they are made distinct, not gathered in each split first."""
    pairs = read(spark, d, "lineitem").select(_key("supp:", "l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member"))
    return dealt(pairs, "key", "member").distinct()


def zm(spark, d) -> DataFrame:
    """key, member, score: each customer's orders by price, as a sorted set."""
    return read(spark, d, "orders").select(_key("user:", "o_custkey").alias("key"), F.col("o_orderkey").cast("string").alias("member"), F.col("o_totalprice").alias("score"))


def xs(spark, d) -> DataFrame:
    """key, ms, seq, event_id, value: events of each type, as a stream."""
    e = read(spark, d, "events").withColumn("ms", millis(F.col("ts")))
    w = Window.partitionBy("event_type", "ms").orderBy("event_id")
    return e.select(F.col("event_type").alias("key"), "ms", (F.row_number().over(w) - 1).cast("long").alias("seq"), "event_id", "value")


def jd(spark, d) -> DataFrame:
    """key, doc: the properties of each event, as JSON text."""
    return read(spark, d, "events").select(_key("ev:", "event_id").alias("key"), F.col("props").alias("doc"))


def geo(spark, d) -> DataFrame:
    """key, member, lng, lat: customers at made-up places."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(_key("nation:", "c_nationkey").alias("key"), k.cast("string").alias("member"), ((k * 37 % 36000) / 100 - 180).alias("lng"), ((k * 53 % 17000) / 100 - 85).alias("lat"))


def bits(spark, d) -> DataFrame:
    """key, offset: users seen on each day, as a bitmap."""
    return read(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("key"), F.col("user_id").alias("offset")).distinct()


def expiring(spark, d) -> DataFrame:
    """key, value, expire_at_ms: orders that live for thirty days; 0 is for ever."""
    o = read(spark, d, "orders")
    return o.select(_key("order:", "o_orderkey").alias("key"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderstatus") == "F", F.lit(0)).otherwise(millis(F.col("o_orderdate")) + 30 * 86_400_000).cast("long").alias("expire_at_ms"))


def cmdlog(spark, d) -> DataFrame:
    """seq, ts_ms, key, cmd, arg: events as a log of commands on the users' keys."""
    e = read(spark, d, "events")
    return e.select(F.col("event_id").alias("seq"), millis(F.col("ts")).alias("ts_ms"), _key("u:", "user_id").alias("key"), F.col("event_type").alias("cmd"), F.col("value").alias("arg"))
