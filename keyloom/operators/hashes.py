"""Hash commands over hf(key, field, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import glob, last_of


def hget(hf: DataFrame, field: str) -> DataFrame:
    return hf.where(F.col("field") == field).select("key", "value")


def hmget(hf: DataFrame, fields: list[str]) -> DataFrame:
    """A column for each field, null where a key lacks it."""
    return hf.groupBy("key").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def hgetall(hf: DataFrame) -> DataFrame:
    """All fields and values of a key in field order, as one map."""
    return hf.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def hlen(hf: DataFrame) -> DataFrame:
    return hf.groupBy("key").agg(F.count("*").alias("n"))


def hkeys(hf: DataFrame) -> DataFrame:
    return hf.select("key", "field")


def hstrlen(hf: DataFrame, field: str) -> DataFrame:
    return hget(hf, field).select("key", F.octet_length("value").cast("long").alias("len"))


def hdel(hf: DataFrame, fields: list[str]) -> DataFrame:
    return hf.where(~F.col("field").isin(fields))


def hincrby(hf: DataFrame, field: str, n: int) -> DataFrame:
    """Every key's field plus n; a missing field begins at 0; one that is no integer gives null, as does an overflow."""
    held = F.max(F.when(F.col("field") == field, F.col("value")))
    number = F.when(held.isNull(), F.lit(0).cast("long")).otherwise(held.try_cast("long"))
    return hf.groupBy("key").agg(F.try_add(number, F.lit(n).cast("long")).alias("value"))


def hset(hf: DataFrame, new: DataFrame, only_new: bool = False) -> DataFrame:
    """new: key, field, value. Sets fields; with only_new those that don't exist."""
    by = ["key", "field"]
    new = last_of(new, by, "value")
    return hf.unionByName(new.join(hf, by, "left_anti")) if only_new else hf.join(new, by, "left_anti").unionByName(new)


def hexists(hf: DataFrame, field: str) -> DataFrame:
    return hf.groupBy("key").agg(F.max((F.col("field") == field).cast("long")).alias("found"))


def hvals(hf: DataFrame) -> DataFrame:
    return hf.select("key", "value")


def hincrbyfloat(hf: DataFrame, field: str, n: float) -> DataFrame:
    """Every key's field plus n; a missing field begins at 0, one that isn't a number gives null."""
    held = F.max(F.when(F.col("field") == field, F.col("value")))
    return hf.groupBy("key").agg(held.alias("v")).select("key", F.when(F.col("v").isNull(), n).otherwise(F.expr("try_cast(v AS DOUBLE)") + n).alias("value"))


def hscan(hf: DataFrame, cursor: int = 0, count: int = 10, match: str = "*") -> DataFrame:
    """So many fields of each key from a place on, in field order."""
    w = Window.partitionBy("key").orderBy("field")
    found = hf.where(glob(F.col("field"), match)).withColumn("r", F.row_number().over(w))
    return found.where((F.col("r") > cursor) & (F.col("r") <= cursor + count)).select("key", "field", "value")


def hrandfield(hf: DataFrame, count: int, seed: int) -> DataFrame:
    """So many fields of each key, by a seeded hash."""
    w = Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit(f"{seed}/"), "field")), "field")
    return hf.withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).select("key", "field", "value")


def httl(hf: DataFrame, now_ms: int) -> DataFrame:
    """hf with expire_at_ms. Milliseconds left of each field; -1 without a time to live, -2 if expired."""
    e = F.col("expire_at_ms")
    return hf.select("key", "field", F.when(e == 0, -1).when(e <= now_ms, -2).otherwise(e - now_ms).cast("long").alias("ttl_ms"))


def hexpire(hf: DataFrame, fields: list[str], at_ms: int) -> DataFrame:
    """at_ms 0 takes the time to live away (HPERSIST)."""
    return hf.withColumn("expire_at_ms", F.when(F.col("field").isin(fields), F.lit(at_ms).cast("long")).otherwise(F.col("expire_at_ms")))
