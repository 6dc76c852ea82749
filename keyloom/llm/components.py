"""Connected components of a link table, by alternating stars; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, root for every node that isn't the smallest of its component.

    A large star hangs every larger neighbour of a node on the smallest node next to it, a small star every smaller
    one; both keep the components. The stars are stable once each component is one star. Minima are pre-aggregated and
    joined back, so a node with many links is a skewed join that can be split, not one long group.
    """
    e = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut_lineage(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.countDistinct("a")).first()
        if now == seen and now[0] == now[2]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of n nodes, for links that fit in one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label
