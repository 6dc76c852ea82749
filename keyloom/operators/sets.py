"""Set commands over sm(key, member)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import glob


def members(sm: DataFrame, key: str) -> DataFrame:
    return sm.where(F.col("key") == key).select("member")


def scard(sm: DataFrame) -> DataFrame:
    return sm.groupBy("key").agg(F.count("*").alias("n"))


def sinter(sm: DataFrame, keys: list[str]) -> DataFrame:
    """One pass: members that go with all of the keys."""
    n = len(set(keys))
    return sm.where(F.col("key").isin(keys)).groupBy("member").agg(F.countDistinct("key").alias("n")).where(F.col("n") == n).select("member")


def sintercard(sm: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = F.count("*")
    return sinter(sm, keys).agg((F.least(n, F.lit(limit)) if limit else n).cast("long").alias("n"))


def sunion(sm: DataFrame, keys: list[str]) -> DataFrame:
    return sm.where(F.col("key").isin(keys)).select("member").distinct()


def sdiff(sm: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first key that no other key has."""
    return reduce(lambda a, k: a.join(members(sm, k), "member", "left_anti"), keys[1:], members(sm, keys[0]))


def smismember(sm: DataFrame, probes: DataFrame) -> DataFrame:
    """probes: key, member."""
    return probes.join(sm.withColumn("hit", F.lit(1)), ["key", "member"], "left").select("key", "member", F.coalesce("hit", F.lit(0)).cast("long").alias("is_member"))


def srandmember(sm: DataFrame, count: int, seed: int) -> DataFrame:
    """So many members of each key, by a seeded hash. Its bytes sort as its digits do and take half the room."""
    w = Window.partitionBy("key").orderBy(F.unhex(F.md5(F.concat(F.lit(f"{seed}/"), "member"))), "member")
    return sm.withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).select("key", "member")


def sadd(sm: DataFrame, new: DataFrame) -> DataFrame:
    """What is new is held against those of its members that the sets have, so the sets aren't sorted for it."""
    new = new.select("key", "member").distinct()
    held = sm.join(new, ["key", "member"], "left_semi")
    return sm.unionByName(new.join(held, ["key", "member"], "left_anti"))


def srem(sm: DataFrame, gone: DataFrame) -> DataFrame:
    return sm.join(gone, ["key", "member"], "left_anti")


def smove(sm: DataFrame, src: str, dst: str, member: str) -> DataFrame:
    """Nothing moves where src lacks the member."""
    one = sm.where((F.col("key") == src) & (F.col("member") == member))
    return sadd(srem(sm, one), one.select(F.lit(dst).alias("key"), "member"))


def store(sm: DataFrame, dst: str, found: DataFrame) -> DataFrame:
    """SINTERSTORE, SUNIONSTORE, SDIFFSTORE: the members found become the set dst, over what it held."""
    return sm.where(F.col("key") != dst).unionByName(found.select(F.lit(dst).alias("key"), "member"))


def sscan(sm: DataFrame, cursor: int = 0, count: int = 10, match: str = "*") -> DataFrame:
    """So many members of each key from a place on, in member order."""
    w = Window.partitionBy("key").orderBy("member")
    found = sm.where(glob(F.col("member"), match)).withColumn("r", F.row_number().over(w))
    return found.where((F.col("r") > cursor) & (F.col("r") <= cursor + count)).select("key", "member")


def spop(sm: DataFrame, count: int, seed: int) -> DataFrame:
    """The sets without so many members of each key, chosen by a seeded hash."""
    return srem(sm, srandmember(sm, count, seed))
