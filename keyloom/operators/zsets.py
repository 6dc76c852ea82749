"""Sorted-set commands over zm(key, member, score); the order is by score, then member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import glob, index_range, last_of


def _order(reverse: bool):
    return [F.desc("score"), F.desc("member")] if reverse else ["score", "member"]


def zrank(zm: DataFrame, reverse: bool = False) -> DataFrame:
    w = Window.partitionBy("key").orderBy(*_order(reverse))
    return zm.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def zrange(zm: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Ranks start to stop. Negative ranks count from the other end, so short ranges at either end are limited in each
    task before the shuffle."""
    if start >= 0 and stop >= 0:
        return zrank(zm, reverse).where(F.col("rank").between(start, stop))
    n = zm.groupBy("key").agg(F.count("*").alias("n"))
    lo, hi = index_range(F.col("n"), start, stop)
    return zrank(zm, reverse).join(n, "key").where(F.col("rank").between(lo, hi)).drop("n")


def zrangebyscore(zm: DataFrame, low: float, high: float, offset: int = 0, count: int | None = None) -> DataFrame:
    inside = zrank(zm.where(F.col("score").between(low, high)))
    return inside.where((F.col("rank") >= offset) & (F.col("rank") < offset + count if count is not None else F.lit(True))).select("key", "member", "score")


def zcount(zm: DataFrame, low: float, high: float) -> DataFrame:
    return zm.groupBy("key").agg(F.count_if(F.col("score").between(low, high)).alias("n"))


def zcard(zm: DataFrame) -> DataFrame:
    return zm.groupBy("key").agg(F.count("*").alias("n"))


def zscore(zm: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(zm, ["key", "member"], "left").select("key", "member", "score")


def zincrby(zm: DataFrame, by: DataFrame) -> DataFrame:
    """by: key, member, n."""
    return zm.unionByName(by.withColumnRenamed("n", "score")).groupBy("key", "member").agg(F.sum("score").alias("score"))


def zadd(zm: DataFrame, new: DataFrame, only: str = "") -> DataFrame:
    """only: "" overwrites, "NX" adds, "XX" changes, "GT"/"LT" keep the greater or smaller score."""
    both = zm.withColumnRenamed("score", "old").join(last_of(new, ["key", "member"], "score").withColumnRenamed("score", "new"), ["key", "member"], "full")
    pick = {"": F.coalesce("new", "old"), "NX": F.coalesce("old", "new"), "XX": F.when(F.col("old").isNotNull(), F.coalesce("new", "old")), "GT": F.greatest("old", "new"), "LT": F.least("old", "new")}[only]
    return both.select("key", "member", pick.alias("score")).where("score IS NOT NULL")


def zpopmin(zm: DataFrame, count: int = 1) -> DataFrame:
    return zrange(zm, 0, count - 1)


def zpopmin_rest(zm: DataFrame, count: int = 1) -> DataFrame:
    return zrank(zm).where(F.col("rank") >= count).select("key", "member", "score")


def zrem(zm: DataFrame, gone: DataFrame) -> DataFrame:
    return zm.join(gone, ["key", "member"], "left_anti")


def zpopmax(zm: DataFrame, count: int = 1) -> DataFrame:
    return zrange(zm, 0, count - 1, reverse=True)


def zrevrangebyscore(zm: DataFrame, high: float, low: float, offset: int = 0, count: int | None = None) -> DataFrame:
    inside = zrank(zm.where(F.col("score").between(low, high)), reverse=True)
    return inside.where((F.col("rank") >= offset) & (F.col("rank") < offset + count if count is not None else F.lit(True))).select("key", "member", "score")


def zscan(zm: DataFrame, cursor: int = 0, count: int = 10, match: str = "*") -> DataFrame:
    """So many members of each key from a place on, in member order."""
    w = Window.partitionBy("key").orderBy("member")
    found = zm.where(glob(F.col("member"), match)).withColumn("r", F.row_number().over(w))
    return found.where((F.col("r") > cursor) & (F.col("r") <= cursor + count)).select("key", "member", "score")


def zrandmember(zm: DataFrame, count: int, seed: int) -> DataFrame:
    """So many members of each key, by a seeded hash."""
    w = Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit(f"{seed}/"), "member")), "member")
    return zm.withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).select("key", "member", "score")


def inside(low: str, high: str):
    """Scores within bounds as commands write them: a number, "(" before one that is left out, -inf, +inf."""
    s = F.col("score")
    above = s > float(low[1:]) if low.startswith("(") else s >= float(low)
    below = s < float(high[1:]) if high.startswith("(") else s <= float(high)
    return above & below


def between_bounds(zm: DataFrame, low: str, high: str) -> DataFrame:
    return zm.where(inside(low, high)).select("key", "member", "score")


def zcount_bounds(zm: DataFrame, low: str, high: str) -> DataFrame:
    return zm.groupBy("key").agg(F.count_if(inside(low, high)).alias("n"))
