"""A log of commands folded into state. Commutative ones are sums, last-writer ones are maxima by sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(log: DataFrame) -> DataFrame:
    """INCR: commands of each key and kind."""
    return log.groupBy("key", "cmd").agg(F.count("*").alias("n"))


def last_write(log: DataFrame) -> DataFrame:
    """SET: the argument with the highest sequence number."""
    return log.groupBy("key").agg(F.max_by("arg", "seq").alias("value"), F.max("seq").alias("seq"))


def first_write(log: DataFrame) -> DataFrame:
    """SET NX: the argument with the lowest."""
    return log.groupBy("key").agg(F.min_by("arg", "seq").alias("value"))


def compact(log: DataFrame, by: list[str]) -> DataFrame:
    """The log without what later entries outdate."""
    return log.groupBy(*by).agg(F.max_by(F.struct(*log.columns), "seq").alias("r")).select("r.*")
