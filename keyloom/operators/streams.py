"""Stream commands over xs(key, ms, seq, ...); an id is (ms, seq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _after(ms: int, seq: int):
    return (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))


def xlen(xs: DataFrame) -> DataFrame:
    return xs.groupBy("key").agg(F.count("*").alias("n"))


def xrange(xs: DataFrame, start_ms: int, end_ms: int, count: int | None = None, reverse: bool = False) -> DataFrame:
    inside = xs.where(F.col("ms").between(start_ms, end_ms))
    if count is None:
        return inside
    order = [F.desc("ms"), F.desc("seq")] if reverse else ["ms", "seq"]
    w = Window.partitionBy("key").orderBy(*order)
    return inside.withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).drop("r")


def xread(xs: DataFrame, ms: int, seq: int, count: int) -> DataFrame:
    """The next entries of each stream after an id."""
    w = Window.partitionBy("key").orderBy("ms", "seq")
    return xs.where(_after(ms, seq)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).drop("r")


def xtrim(xs: DataFrame, maxlen: int) -> DataFrame:
    """Keeps the newest."""
    w = Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq"))
    return xs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= maxlen).drop("r")


def xinfo(xs: DataFrame) -> DataFrame:
    eid = F.struct("ms", "seq")
    return xs.groupBy("key").agg(F.count("*").alias("n"), F.min(eid).alias("a"), F.max(eid).alias("z")).select("key", "n", F.col("a.ms").alias("first_ms"), F.col("a.seq").alias("first_seq"), F.col("z.ms").alias("last_ms"), F.col("z.seq").alias("last_seq"))


def pending(delivered: DataFrame, acked: DataFrame, by: list[str]) -> DataFrame:
    """Entries delivered and not acknowledged."""
    return delivered.join(acked, by, "left_anti")


def xdel(xs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: key, ms, seq."""
    return xs.join(ids, ["key", "ms", "seq"], "left_anti")


def xtrim_minid(xs: DataFrame, ms: int, seq: int = 0) -> DataFrame:
    """Keeps entries from an id on."""
    return xs.where(_after(ms, seq) | ((F.col("ms") == ms) & (F.col("seq") == seq)))


def xadd(xs: DataFrame, new: DataFrame) -> DataFrame:
    """new: xs's columns. Only entries above the newest id of their stream are taken; a stream that doesn't exist takes all."""
    newest = xs.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("newest"))
    fresh = new.join(newest, "key", "left").where(F.col("newest").isNull() | (F.struct("ms", "seq") > F.col("newest"))).drop("newest")
    return xs.unionByName(fresh)


def xreadgroup(xs: DataFrame, cursors: DataFrame, count: int) -> DataFrame:
    """cursors: key, grp, ms, seq, the last id delivered to each group; one row a key and group. The next entries."""
    c = cursors.select("key", "grp", F.struct("ms", "seq").alias("last"))
    w = Window.partitionBy("key", "grp").orderBy("ms", "seq")
    ahead = xs.join(c, "key").where(F.struct("ms", "seq") > F.col("last")).drop("last")
    return ahead.withColumn("r", F.row_number().over(w)).where(F.col("r") <= count).drop("r")


def xreadgroup_again(delivered: DataFrame, acked: DataFrame, ms: int, seq: int = 0) -> DataFrame:
    """Reading by an id: what was delivered from that id on, itself included, and isn't acknowledged."""
    return xtrim_minid(xdel(delivered, acked), ms, seq)


def xrange_ids(xs: DataFrame, start: tuple[int, int], end: tuple[int, int]) -> DataFrame:
    """Entries from one id (ms, seq) to another, both included."""
    return xs.where((_after(*start) | ((F.col("ms") == start[0]) & (F.col("seq") == start[1]))) & ~_after(*end))


def last_ids(xs: DataFrame) -> DataFrame:
    """Where a group made at $ begins: the last id of each stream."""
    return xs.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("id")).select("key", "id.ms", "id.seq")
