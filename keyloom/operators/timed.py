"""Commands on keys and fields with a time to live: rows with expire_at_ms (0: none). What has expired by now_ms doesn't
exist: it is read as missing, and stays gone when it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import last_of, live


def put(kv: DataFrame, new: DataFrame, now_ms: int, expire_at_ms: int = 0, only: str = "", keep_ttl: bool = False) -> DataFrame:
    """SET and its relatives. new: key, value. only: "NX" sets missing keys, "XX" existing ones. The time to live is the
    one given, or with keep_ttl the one a key had."""
    kv = kv.where(live(now_ms))
    old = last_of(new, ["key"], "value").join(kv.select("key", F.col("expire_at_ms").alias("old")), "key", "left")
    may = {"": F.lit(True), "NX": F.col("old").isNull(), "XX": F.col("old").isNotNull()}[only.upper()]
    until = F.coalesce("old", F.lit(0)) if keep_ttl else F.lit(expire_at_ms)
    written = old.where(may).select("key", "value", until.cast("long").alias("expire_at_ms"))
    return kv.join(written, "key", "left_anti").unionByName(written)


def get(kv: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """key, value of each key asked for, null where there is none."""
    return keys.join(kv.where(live(now_ms)), "key", "left").select("key", "value")


def without(kv: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """What GETDEL leaves."""
    return kv.where(live(now_ms)).join(keys, "key", "left_anti")


def retime(kv: DataFrame, keys: DataFrame, now_ms: int, expire_at_ms: int) -> DataFrame:
    """What GETEX leaves: the keys asked for live until then, for ever with 0 (PERSIST)."""
    hit = keys.select("key").distinct().withColumn("hit", F.lit(True))
    out = kv.where(live(now_ms)).join(hit, "key", "left")
    return out.select("key", "value", F.when(F.col("hit"), F.lit(expire_at_ms).cast("long")).otherwise(F.col("expire_at_ms")).alias("expire_at_ms"))


def _said(now_ms: int, value):
    e = F.col("expire_at_ms")
    return F.when(e == 0, -1).when(e <= now_ms, -2).otherwise(value).cast("long")


def ttl_seconds(rows: DataFrame, now_ms: int) -> DataFrame:
    """Whole seconds left; -1 without a time to live, -2 if expired. Other columns but values stay."""
    return rows.withColumn("ttl", _said(now_ms, F.floor((F.col("expire_at_ms") - now_ms) / 1000))).drop("value", "expire_at_ms")


def expiry_time(rows: DataFrame, now_ms: int, unit_ms: int = 1000) -> DataFrame:
    """When, in seconds (or milliseconds, by the unit); -1 and -2 as for the time to live."""
    return rows.withColumn("at", _said(now_ms, F.floor(F.col("expire_at_ms") / unit_ms))).drop("value", "expire_at_ms")


def set_fields(hf: DataFrame, new: DataFrame, now_ms: int, expire_at_ms: int) -> DataFrame:
    """HSETEX. new: key, field, value."""
    by = ["key", "field"]
    written = last_of(new, by, "value").withColumn("expire_at_ms", F.lit(expire_at_ms).cast("long"))
    return hf.where(live(now_ms)).join(written, by, "left_anti").unionByName(written)


def retime_fields(hf: DataFrame, fields: list[str], now_ms: int, expire_at_ms: int) -> DataFrame:
    """HGETEX, HEXPIRE and HPEXPIRE in relative time: what is left of the hashes."""
    until = F.when(F.col("field").isin(fields), F.lit(expire_at_ms).cast("long")).otherwise(F.col("expire_at_ms"))
    return hf.where(live(now_ms)).withColumn("expire_at_ms", until)


def take_fields(hf: DataFrame, fields: list[str], now_ms: int) -> tuple[DataFrame, DataFrame]:
    """HGETDEL: key, field, value of what is taken, and what is left."""
    on = F.col("field").isin(fields)
    alive = hf.where(live(now_ms))
    return alive.where(on).select("key", "field", "value"), alive.where(~on)


def scan_type(families: dict[str, DataFrame], kind: str, cursor: str = "", count: int = 10) -> DataFrame:
    """SCAN TYPE: the next keys of one family after the cursor."""
    return families[kind].select("key").where(F.col("key") > cursor).distinct().orderBy("key").limit(count)


def type_of(families: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """key, type: the family that holds each key asked for, "none" where none does."""
    every = None
    for name, t in families.items():
        one = t.join(keys.select("key").distinct(), "key", "left_semi").select("key").distinct().withColumn("type", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return keys.join(every.groupBy("key").agg(F.min("type").alias("type")), "key", "left").select("key", F.coalesce("type", F.lit("none")).alias("type"))
