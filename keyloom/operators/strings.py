"""String commands over kv(key, value), for all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import byte_range, glob, last_of, slot


def strlen(kv: DataFrame) -> DataFrame:
    return kv.select("key", F.octet_length("value").cast("long").alias("len"))


def getrange(kv: DataFrame, start: int, stop: int) -> DataFrame:
    return kv.select("key", byte_range(F.col("value"), start, stop).alias("value"))


def mget(kv: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: ord, key. One row for each, null where there is no such key."""
    return wanted.join(kv, "key", "left").select("ord", "key", "value")


def scan(kv: DataFrame, match: str = "*", cursor: str = "", count: int = 10) -> DataFrame:
    """The next keys after the cursor, in order."""
    return kv.where((F.col("key") > cursor) & glob(F.col("key"), match)).select("key").orderBy("key").limit(count)


def append(kv: DataFrame, suffix: str) -> DataFrame:
    return kv.select("key", F.concat(F.coalesce("value", F.lit("")), F.lit(suffix)).alias("value"))


def setrange(kv: DataFrame, offset: int, text: str) -> DataFrame:
    """Overwrites from an offset on; what is short of it is filled with zero bytes."""
    b = F.encode("value", "UTF-8")
    wide = F.when(F.octet_length(b) < offset, F.rpad(b, offset, F.lit(b"\0"))).otherwise(b)
    return kv.select("key", F.overlay(wide, F.encode(F.lit(text), "UTF-8"), F.lit(offset + 1)).alias("value"))


def setnx(kv: DataFrame, new: DataFrame) -> DataFrame:
    """new: key, value. Only keys that don't exist are set."""
    return kv.unionByName(last_of(new, ["key"], "value").join(kv, "key", "left_anti"))


def incrby(kv: DataFrame, by: DataFrame) -> DataFrame:
    """by: key, n. Sums are added to integer values; other values give null, as does an overflow."""
    total = by.groupBy("key").agg(F.sum("n").alias("n"))
    return total.join(kv, "key", "left").select("key", F.expr("try_add(coalesce(try_cast(value AS BIGINT), if(value IS NULL, 0L, NULL)), n)").alias("value"))


def mset(kv: DataFrame, new: DataFrame) -> DataFrame:
    """new: key, value. Sets every key, whether it exists or not."""
    new = last_of(new, ["key"], "value")
    return kv.join(new, "key", "left_anti").unionByName(new)


def msetnx(kv: DataFrame, new: DataFrame) -> DataFrame:
    """Sets all keys or, if any exists, none."""
    taken = new.join(kv, "key", "left_semi").agg(F.count("*").alias("taken"))  # one row
    return kv.unionByName(new.join(F.broadcast(taken), F.col("taken") == 0).select("key", "value"))


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys, "key", "left_anti")


def exists(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """How many of the keys exist; a key that is named twice counts twice."""
    return keys.join(kv, "key", "left_semi").agg(F.count("*").alias("n"))


def incrbyfloat(kv: DataFrame, n: float) -> DataFrame:
    """Values that aren't numbers give null."""
    return kv.select("key", (F.expr("try_cast(value AS DOUBLE)") + n).alias("value"))


def getset(kv: DataFrame, new: DataFrame) -> DataFrame:
    """key, old, value: what a key held, null if it didn't exist, and what it holds now."""
    return new.join(kv.withColumnRenamed("value", "old"), "key", "left").select("key", "old", "value")


def cas(kv: DataFrame, swaps: DataFrame) -> DataFrame:
    """swaps: key, expected, new, one a key. Sets a value only where it is the expected one. swapped: 1, 0, or null for a
    key that doesn't exist."""
    s = swaps.join(kv, "key", "left")
    hit = F.col("value") == F.col("expected")
    return s.select("key", F.when(hit, F.col("new")).otherwise(F.col("value")).alias("value"), hit.cast("long").alias("swapped"))


def rename(kv: DataFrame, names: DataFrame, only_new: bool = False) -> DataFrame:
    """names: key, to. A key's value moves to another key, over what is there unless only_new; missing keys don't move."""
    moves = names.join(kv, "key")
    if only_new:
        moves = moves.join(kv.select(F.col("key").alias("to")), "to", "left_anti")
    gone = moves.select("key").unionAll(moves.select(F.col("to").alias("key")))
    return kv.join(gone, "key", "left_anti").unionByName(moves.select(F.col("to").alias("key"), "value"))


def copy(kv: DataFrame, names: DataFrame, replace: bool = False) -> DataFrame:
    """names: key, to. A key's value under another key as well; a key that exists is kept unless replace."""
    new = names.join(kv, "key").select(F.col("to").alias("key"), "value")
    return mset(kv, new) if replace else setnx(kv, new)


def memory_usage(kv: DataFrame) -> DataFrame:
    return kv.select("key", (F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes"))


def prefixes(kv: DataFrame) -> DataFrame:
    """Keys by what stands before the first colon, most first."""
    return kv.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))


def keyslots(kv: DataFrame, slots: int = 1024) -> DataFrame:
    return kv.groupBy(slot(F.col("key"), slots).alias("slot")).agg(F.count("*").alias("n"))
