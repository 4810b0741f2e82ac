"""Centroid clustering over integers with Hamerly's bounds.

Vectors become integers, so sums, means and squared distances are exact and don't depend on the order
of rows. Each vector keeps its cluster, an upper bound on the distance to its centroid and a lower bound
on the distance to every other one. A round loosens both by how far the centroids moved (the lower one
by the furthest move among the others); a vector whose upper bound stays below its lower bound, or below
half the way from its centroid to the next, keeps its cluster unseen. For the others the upper bound is
made exact, and those still in doubt are measured against all centroids in integers. Ties are in doubt
by construction, so the smaller number always wins them.

The state is a table in the shared folder, written once a round from the one before; the driver gets
sums of the vectors that changed their cluster, k rows a round, and nothing that grows with the input.

Defined cases: vectors that are null, of another length, or with a null, infinite or NaN component are
left out; components are taken between -2^27 and 2^27 (in steps of 1 / scale), so that squared distances
are exact longs; a null id is hashed as no text; repeated ids are rows like others (of equal hashes the
vector that comes first in order begins); fewer vectors than k make fewer centroids; an empty table gives
an empty result; columns other than vec_id and embedding are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, staged, table

K, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Components beyond it are taken as it: 64 squares of twice as much stay below 2^63.
MOST = 1 << 27
#: Bounds are moved apart by this share, far above the error of a square root and a sum of doubles.
SLACK = 1e-9
STATE = "vec_id long, x array<int>, cluster int, before int, upper double, lower double"


def vectors(rows: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, x: the vectors with size finite components, each floor(scale * component)."""
    x = F.col("embedding")
    whole = lambda v: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v.cast("double") * scale))).cast("int")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return rows.where(x.isNotNull() & (F.size(x) == size) & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, whole).alias("x"))


def first_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of seed:id, in that order."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(place.alias("place"), "x").orderBy("place", "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def _dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by doubles while every partial sum is an exact double."""
    if x.size and c.size and int(np.abs(x).max()) * int(np.abs(c).max()) * x.shape[1] >= 1 << 53:
        return x @ c.T
    return (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid."""
    return (x * x).sum(1)[:, None] - 2 * _dots(x, c) + (c * c).sum(1)[None, :]


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every row the nearest centroid (the smaller number of equally near ones), the upper and the lower bound."""
    d = squared(x, c)
    nearest = d.argmin(1)
    at = np.arange(len(x))
    best = np.sqrt(d[at, nearest].astype(float))
    d[at, nearest] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(1).astype(float)) if len(c) > 1 else np.full(len(x), np.inf)
    return nearest, best * (1 + SLACK), second * (1 - SLACK)


class Round:
    """What every task of a round needs: the centroids before and after the move, and what follows from both."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.new = new
        drift = np.sqrt(((new - old) ** 2).sum(1).astype(float)) * (1 + SLACK)
        self.drift = drift
        # the furthest move among the others
        order = np.argsort(-drift, kind="stable")
        self.others = np.where(np.arange(len(drift)) == order[0], drift[order[1]] if len(drift) > 1 else 0.0, drift[order[0]])
        between = squared(new, new).astype(float)
        np.fill_diagonal(between, np.inf)
        self.half = np.sqrt(between.min(1)) / 2 * (1 - SLACK)

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Clusters and bounds after the move, and how many rows were measured against all centroids."""
        upper = (upper + self.drift[cluster]) * (1 + SLACK)
        lower = np.maximum(lower - self.others[cluster], 0) * (1 - SLACK)
        safe = np.maximum(lower, self.half[cluster])
        doubt = np.flatnonzero(upper >= safe)
        near = x[doubt] - self.new[cluster[doubt]]
        upper[doubt] = np.sqrt((near * near).sum(1).astype(float)) * (1 + SLACK)
        doubt = doubt[upper[doubt] >= safe[doubt]]
        cluster = cluster.copy()
        if len(doubt):
            cluster[doubt], upper[doubt], lower[doubt] = scan(x[doubt], self.new)
        return cluster, upper, lower, len(doubt)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, size)


def _state(b: pa.RecordBatch, cluster: np.ndarray, before: pa.Array, upper: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    columns = [b.column("vec_id"), b.column("x"), pa.array(cluster, pa.int32()), before, pa.array(upper), pa.array(lower)]
    return pa.record_batch(columns, ["vec_id", "x", "cluster", "before", "upper", "lower"])


def begin(kept: DataFrame, c: np.ndarray) -> DataFrame:
    """The state after every vector has been measured against all centroids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                nearest, upper, lower = scan(_matrix(b.column("x"), c.shape[1]), c)
                yield _state(b, nearest, pa.nulls(len(b), pa.int32()), upper, lower)

    return arrow_map(kept, run, STATE)


def step(state: DataFrame, move: Round) -> DataFrame:
    """The state after a move of the centroids; before is the cluster until then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                cluster, upper, lower, _ = move.assign(_matrix(b.column("x"), move.new.shape[1]), b.column("cluster").to_numpy(), b.column("upper").to_numpy(), b.column("lower").to_numpy())
                yield _state(b, cluster, b.column("cluster"), upper, lower)

    return arrow_map(state, run, STATE)


def changes(state: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how many vectors came less those that left, and the sum of their components likewise; one row per cluster comes to the driver."""
    come = F.struct(F.col("cluster").alias("at"), F.lit(1).alias("sign"))
    gone = F.struct(F.col("before").alias("at"), F.lit(-1).alias("sign"))
    moved = state.where("before is null or before <> cluster").select("x", F.explode(F.when(F.col("before").isNull(), F.array(come)).otherwise(F.array(come, gone))).alias("m"))
    of = lambda i: F.sum(F.get("x", F.lit(i)).cast("bigint") * F.col("m.sign")).alias(f"s{i}")
    rows = moved.groupBy("m.at").agg(F.sum("m.sign").alias("n"), *[of(i) for i in range(size)]).collect()
    return {r["at"]: (r["n"], [r[f"s{i}"] for i in range(size)]) for r in rows}


def cluster(rows: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """vec_id, x, cluster of every kept vector after the rounds, and the centroids it was last measured against."""
    kept = vectors(rows, size, scale)
    c = first_centroids(kept, k, seed)
    if not len(c):
        return kept.withColumn("cluster", F.lit(0)), c
    state, count, total = staged(begin(kept, c), "state"), np.zeros(len(c), object), np.zeros(c.shape, object)
    for _ in range(rounds):
        for at, (n, sums) in changes(state, size).items():
            count[at] += n
            total[at] += np.array(sums, object)
        old, c = c, c.copy()
        for at in np.flatnonzero(count):
            c[at] = [s // int(count[at]) for s in total[at]]
        state = staged(step(state, Round(old, c)), "state")
    return state.select("vec_id", "x", "cluster"), c


def measured(found: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector."""
    spark = found.sparkSession
    hashes = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c]
    centers = spark.createDataFrame([(n, row.tolist(), h) for n, (row, h) in enumerate(zip(c, hashes))], "cluster int, center array<bigint>, centroid_sha256 string")
    apart = F.zip_with("x", "center", lambda a, b: (a - b) * (a - b))
    with_distance = found.join(F.broadcast(centers), "cluster").select("vec_id", "cluster", F.aggregate(apart, F.lit(0).cast("bigint"), lambda s, v: s + v).alias("distance"), "centroid_sha256")
    sums = with_distance.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # at most k rows: one per cluster
    both = sums.crossJoin(F.broadcast(sums.agg(F.sum("cluster_inertia").alias("inertia"))))
    return with_distance.join(F.broadcast(both), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster and exact distance after five rounds from 40 vectors."""
    found, c = cluster(table(spark, sf_dir, "embeddings"))
    return measured(found, c)
