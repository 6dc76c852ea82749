"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors are rotated at random, so that the first d of D rotated dimensions estimate a distance: the partial distance
times D/d. Lists are probed in order of their centroids; within a list, blocks of columns are added up for all candidates
that are still in. After each block a hypothesis test abandons those whose partial distance is too large for a whole one
below the query's current tenth, at a confidence that grows with the columns seen. What survives is measured on the
original vectors in double precision.

Equal vectors are one point with its smallest ids (as many as an answer can show); equal queries are searched once. Long
lists are dealt into parts, each of which gets the list's queries. How many lists a query probes is fitted on the sample:
few where vectors lie in clusters, most of them where they lie evenly. The rotation and the centroids are bounded; centroids
come from a bounded sample, the index takes every vector.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part; nor do those whose
length isn't the most frequent one; a query without other vectors has no rows; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType
from pyspark.sql.window import Window

from .common import bounded_sample, cut_lineage

#: Vectors from which centroids are fitted, lists at most, points of a list in one part.
SAMPLE, LISTS, PART = 16_384, 4_096, 4_096
#: Share of the sample's own neighbours that the lists probed must hold, lists probed at least, and the points in them.
HELD, LEAST_PROBES, LEAST_POINTS = 0.97, 12, 64
#: Columns to a block, and how many standard errors a candidate may be over the bound before it is abandoned.
COLUMNS, ERRORS = 16, 2.1


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's k-means; a centroid that lost its points moves to a point that lies far from its own."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        d = squared(sample, c)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, sample)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            c[n == 0] = sample[np.argsort(-d.min(axis=1))[: int((n == 0).sum())]]
    return c.astype(sample.dtype)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None, :])


def fit_probes(sample: np.ndarray, centre: np.ndarray, k: int, queries: int = 256) -> int:
    """How many lists hold the share HELD of the neighbours that some of the sample have within it. Neighbours among all
    vectors are nearer than those within a sample, so this errs on the side of more lists."""
    asked = sample[:queries].astype(np.float64)
    d = squared(asked, sample.astype(np.float64))
    d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    if not near.size:
        return len(centre)
    order = np.argsort(squared(asked, centre.astype(np.float64)), axis=1)
    rank = np.argsort(order, axis=1)
    own = squared(sample, centre).argmin(axis=1)
    return int(np.quantile(np.take_along_axis(rank, own[near], axis=1), HELD, method="higher")) + 1


def adaptive_scan(query: np.ndarray, rotated: np.ndarray, blocks: list[np.ndarray], bound: float) -> np.ndarray:
    """Candidates that may be nearer than the bound (a squared distance): blocks hold the rotated columns of all."""
    dim, seen, alive = len(rotated), 0, np.arange(len(blocks[0]))
    partial = np.zeros(len(alive), blocks[0].dtype)
    for b in blocks:
        step = b[alive] - rotated[seen : seen + b.shape[1]]
        partial = partial + np.einsum("ij,ij->i", step, step)
        seen += b.shape[1]
        slack = 1.0 + (ERRORS / np.sqrt(seen) if seen < dim else 1e-4)
        keep = partial * (dim / seen) <= bound * slack * slack
        alive, partial = alive[keep], partial[keep]
        if not len(alive):
            break
    return alive


def _matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows in the column's own precision."""
    none = np.zeros((0, dim), col.type.value_type.to_pandas_dtype())
    return np.concatenate([none, *(c.flatten().to_numpy().reshape(-1, dim) for c in col.chunks)])


def scan_list(points: np.ndarray, ids: list[list[int]], queries: np.ndarray, turn: np.ndarray, take: int):
    """For each query the `take` nearest members of a list: (squared distances, ids)."""
    turn = turn.astype(points.dtype)
    exact, rotated = points.astype(np.float64), points @ turn
    blocks = [np.ascontiguousarray(rotated[:, i : i + COLUMNS]) for i in range(0, points.shape[1], COLUMNS)]
    turned, out = queries @ turn, []
    for q, r in zip(queries.astype(np.float64), turned, strict=True):
        # candidates that look nearest by the first block make the first bound
        start = np.argsort(((blocks[0] - r[: blocks[0].shape[1]]) ** 2).sum(axis=1), kind="stable")[: 4 * take]
        d = np.sqrt(((exact[start] - q) ** 2).sum(axis=1))
        bound = np.sort(d)[take - 1] ** 2 if len(d) >= take else np.inf
        alive = adaptive_scan(q, r, blocks, bound)
        d = np.sqrt(((exact[alive] - q) ** 2).sum(axis=1))
        out.append(sorted((x, i) for x, k in zip(d.tolist(), alive.tolist(), strict=True) if x * x <= bound * (1 + 1e-9) for i in ids[k])[:take])
    return out


def nearest_neighbours(vectors: DataFrame, queries_where: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found for every row that meets the condition
    on vec_id."""
    take = k + 1  # the query itself may be among them
    v = F.col("v")
    sound = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "float" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "double"
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).where(F.coalesce(sound, F.lit(False)))
    sizes = every.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dim = sizes["dim"]
    every = every.where(F.size("v") == dim).select("vec_id", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)).alias("v"))  # -0.0 is 0.0

    def classes(df, most):
        """One row for each distinct vector, with its smallest ids; ranks are limited before the shuffle."""
        w = Window.partitionBy("v").orderBy("vec_id")
        return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))

    points = cut_lineage(classes(every, take))
    asked = every.where(queries_where)
    heads = cut_lineage(classes(asked, 1).select(F.col("ids")[0].alias("head"), "v"))
    n = points.count()
    lists = int(min(LISTS, max(1, n**0.5 / 2)))
    some = bounded_sample(points.select("v", F.xxhash64(F.col("ids")[0]).alias("h")), "h", SAMPLE).orderBy("h").limit(SAMPLE)
    rows = some.select("v").toPandas()["v"]
    sample = np.array(rows.tolist(), np.float32 if kind == "float" else np.float64)
    centre, turn = centroids(sample, lists), rotation(dim)
    lists, probes_each = len(centre), fit_probes(sample, centre, k)

    def assign(batches):
        for b in batches:
            x = _matrix(pa.chunked_array([b.column("v")]), dim)
            yield pa.record_batch([pa.array(squared(x, centre).argmin(axis=1).astype(np.int32)), b.column("ids"), b.column("v")], ["list", "ids", "v"])

    placed = cut_lineage(points.mapInArrow(assign, f"list int, ids array<long>, v array<{kind}>"))
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row for each list
        held[r[0]] = r[1]
    parts = np.maximum(1, -(-held // PART))

    def probe(batches):
        for b in batches:
            x = _matrix(pa.chunked_array([b.column("v")]), dim)
            order = np.argsort(squared(x, centre), axis=1)
            enough = np.argmax(np.cumsum(held[order], axis=1) >= min(LEAST_POINTS, held.sum()), axis=1) + 1
            count = np.minimum(lists, np.maximum(enough, max(LEAST_PROBES, probes_each)))
            row, to, part = [], [], []
            for i, c in enumerate(count):
                for t in order[i, :c].tolist():
                    for p in range(int(parts[t])):
                        row.append(i)
                        to.append(t)
                        part.append(p)
            row = pa.array(row, pa.int64())
            yield pa.record_batch([pa.array(to, pa.int32()), pa.array(part, pa.int32()), b.column("head").take(row), b.column("v").take(row)], ["list", "part", "head", "v"])

    def scan(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"head": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        found = scan_list(_matrix(left["v"], dim), left["ids"].to_pylist(), _matrix(right["v"], dim), turn, take)
        rows = [(h, i, d) for h, f in zip(right["head"].to_pylist(), found, strict=True) for d, i in f]
        return pa.table({"head": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})

    share = F.pmod(F.xxhash64(F.col("ids")[0]), F.element_at(F.lit(parts.tolist()), F.col("list") + 1)).cast("int")
    dealt = placed.withColumn("part", share)
    probes = heads.select("head", "v").mapInArrow(probe, f"list int, part int, head long, v array<{kind}>")
    found = dealt.groupBy("list", "part").cogroup(probes.groupBy("list", "part")).applyInArrow(scan, "head long, vec_id long, score double")
    best = found.groupBy("head").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, take).alias("best"))
    answers = heads.join(best, "head").select("v", "best")
    mine = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.select(F.col("vec_id").alias("query_id"), "v").distinct().join(answers, "v").select("query_id", F.posexplode(mine))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))
