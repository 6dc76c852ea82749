"""List commands over le(key, pos, value); pos is the place from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import index_range


def _counted(le: DataFrame) -> DataFrame:
    """Sizes are aggregated and joined back: a long list isn't held in one window."""
    return le.join(le.groupBy("key").agg(F.count("*").alias("n")), "key")


def llen(le: DataFrame) -> DataFrame:
    return le.groupBy("key").agg(F.count("*").alias("n"))


def lrange(le: DataFrame, start: int, stop: int) -> DataFrame:
    if start >= 0 and stop >= 0:
        return le.where(F.col("pos").between(start, stop)).select("key", "pos", "value")
    lo, hi = index_range(F.col("n"), start, stop)
    return _counted(le).where(F.col("pos").between(lo, hi)).select("key", "pos", "value")


def lindex(le: DataFrame, index: int) -> DataFrame:
    if index >= 0:
        return lrange(le, index, index).select("key", "value")
    return _counted(le).where(F.col("pos") == F.col("n") + index).select("key", "value")


def lpos(le: DataFrame, value: str) -> DataFrame:
    """First place of the value."""
    return le.where(F.col("value") == value).groupBy("key").agg(F.min("pos").alias("pos"))


def _again(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("pos")
    return df.select("key", (F.row_number().over(w) - 1).cast("long").alias("pos"), "value")


def lrem(le: DataFrame, count: int, value: str) -> DataFrame:
    """Removes the first (count > 0), last (count < 0) or all (0) elements of that value."""
    same = F.col("value") == value
    if count:
        w = Window.partitionBy("key", same).orderBy(F.col("pos") if count > 0 else F.desc("pos"))
        kept = le.withColumn("k", F.row_number().over(w)).where(~same | (F.col("k") > abs(count)))
    else:
        kept = le.where(~same)
    return _again(kept)


def ltrim(le: DataFrame, start: int, stop: int) -> DataFrame:
    return _again(lrange(le, start, stop))


def lpop(le: DataFrame, count: int = 1) -> DataFrame:
    return lrange(le, 0, count - 1)


def rpop(le: DataFrame, count: int = 1) -> DataFrame:
    return lrange(le, -count, -1)


def lset(le: DataFrame, index: int, value: str) -> DataFrame:
    """A place before the first is the first; one after the last changes nothing."""
    at = F.col("pos") == (F.greatest(F.col("n") + index, F.lit(0)) if index < 0 else F.lit(index))
    return _counted(le).select("key", "pos", F.when(at, F.lit(value)).otherwise(F.col("value")).alias("value"))


def push(le: DataFrame, new: DataFrame, left: bool = False, only_old: bool = False) -> DataFrame:
    """new: key, ord, value. Appends in order, or puts one after the other before the first; with only_old (LPUSHX,
    RPUSHX) to lists that exist. Places are counted anew."""
    if only_old:
        new = new.join(le.select("key").distinct(), "key", "left_semi")
    side = F.lit(0 if left else 2)
    place = -F.col("ord") if left else F.col("ord")
    both = le.select("key", F.lit(1).alias("side"), "pos", "value").unionByName(new.select("key", side.alias("side"), place.cast("long").alias("pos"), "value"))
    w = Window.partitionBy("key").orderBy("side", "pos")
    return both.select("key", (F.row_number().over(w) - 1).cast("long").alias("pos"), "value")


def linsert(le: DataFrame, pivot: str, value: str, after: bool = False) -> DataFrame:
    """Beside the first element of that value; lists without it stay."""
    at = lpos(le, pivot).withColumnRenamed("pos", "at")
    new = at.select("key", (F.col("at") + (1 if after else 0)).alias("pos"), F.lit(value).alias("value"))
    moved = le.join(at, "key", "left").select("key", F.when(F.col("pos") >= F.col("at") + (1 if after else 0), F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"), "value")
    return moved.unionByName(new)


def lmove(le: DataFrame, src: str, dst: str, from_left: bool = True, to_left: bool = False) -> DataFrame:
    """One element of src to an end of dst; without src nothing moves."""
    one = (lpop if from_left else rpop)(le.where(F.col("key") == src))
    rest = le.join(one.select("key", "pos"), ["key", "pos"], "left_anti")
    return push(rest, one.select(F.lit(dst).alias("key"), F.lit(0).alias("ord"), "value"), to_left)


def lpos_all(le: DataFrame, value: str, rank: int = 1, count: int = 0) -> DataFrame:
    """Places of the value from its rank-th match on (below 0: from the end backwards); count 0 is all of them."""
    w = Window.partitionBy("key").orderBy(F.col("pos") if rank > 0 else F.desc("pos"))
    found = le.where(F.col("value") == value).withColumn("r", F.row_number().over(w)).where(F.col("r") >= abs(rank))
    return (found.where(F.col("r") < abs(rank) + count) if count else found).select("key", "pos")
