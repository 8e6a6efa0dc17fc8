"""Centroid clustering: delta Lloyd over whole numbers.

Vectors become whole numbers (floor of a scale times the component) and are written once, bucketed by a row number. Assignments
(row, cluster, distance) are a narrow table with the same buckets, written anew each round; the sums and counts of all
clusters stay on the driver (k times dim + 1 whole numbers, whatever the input). A round compares a vector whose owner
didn't move with the moved centroids alone, since its stored distance still beats the others, and a vector whose owner moved with
all. Vectors that change owner give signed transfers, added up within a task and then by cluster and component; the sums take
them in, and a centroid is the exact floor of sum by count. A round in which nothing moved ends the work: all later ones would
repeat it.

Scale: one shuffle, that of the vectors into buckets; every round reads them once, joined with the assignments bucket by bucket without an
exchange, and writes about 20 bytes a vector. Row numbers are spread by hash, so equal vectors, hot labels or sources make no task
larger. A lost executor costs the reading of written tables.

Defined results: vectors that are null, have another number of components than `dim`, or hold null or non-finite components are left
out; scaled components beyond +-2**27 count as that bound (all arithmetic stays exact in 64 bits); repeated rows and ids are vectors of
their own; a null id hashes as the empty text; equal hashes are ordered by components. With fewer than k vectors there are as many
clusters as vectors; an empty table gives an empty result. A sum beyond 64 bits is null. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Bucketed, buckets_for, materialize

#: Scaled components are kept within these bounds.
BOUND = 1 << 27
_STATE = "r long, cluster int, distance long, transfers array<array<bigint>>"


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector (of doubles) has `dim` components, all of them finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (F.size(vector) == dim) & F.coalesce(finite, F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, within the bounds."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * float(scale), F.lit(float(BOUND))), F.lit(float(-BOUND)))).cast("int"))


def _squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each centroid."""
    return (x * x).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids * centroids).sum(1)[None, :]


def _assigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the centroids flagged in `moved` have moved; owner -1: none yet."""
    best = np.full((len(x), len(centroids)), np.iinfo(np.int64).max)
    anew = (owner < 0) | moved[owner]
    best[anew] = _squared(x[anew], centroids)
    stay = np.flatnonzero(~anew)
    best[np.ix_(stay, np.flatnonzero(moved))] = _squared(x[stay], centroids[moved])
    best[stay, owner[stay]] = distance[stay]
    owners = best.argmin(1)  # the first of equal ones
    return owners, best[np.arange(len(x)), owners]


def _transfers(x: np.ndarray, before: np.ndarray, after: np.ndarray, k: int) -> list[list[int]]:
    """For each cluster that gains or loses vectors: cluster, change of its count, change of its sums."""
    out = []
    for c in range(k):
        comes, goes = (after == c) & (before != c), (before == c) & (after != c)
        if comes.any() or goes.any():
            out.append([c, int(comes.sum()) - int(goes.sum()), *(x[comes].sum(0) - x[goes].sum(0)).tolist()])
    return out


def _round(centroids: np.ndarray, moved: np.ndarray):
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                x = part.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, dim)
                before = part.column(2).to_numpy().astype(np.int64)
                after, distance = _assigned(x, before, part.column(3).to_numpy(), centroids, moved)
                sums = [_transfers(x, before, after, len(centroids)) or None] + [None] * (len(x) - 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(after, pa.int32()), pa.array(distance, pa.int64()), pa.array(sums, pa.list_(pa.list_(pa.int64())))],
                    names=["r", "cluster", "distance", "transfers"],
                )

    return run


def _changes(assigned: DataFrame) -> list[tuple[int, int, int]]:
    """Cluster, place (0: count, else component + 1) and signed change; k * (dim + 1) rows at most."""
    one = assigned.where(F.col("transfers").isNotNull()).select(F.explode("transfers").alias("t"))
    flat = one.select(F.get("t", F.lit(0)).alias("c"), F.posexplode(F.slice("t", 2, F.size("t") - 1)))
    return [tuple(r) for r in flat.groupBy("c", "pos").agg(F.sum("col")).collect()]


def cluster(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per usable vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid (its final components)."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    kept = given.where(usable(F.col("v"), dim)).select(F.monotonically_increasing_id().alias("r"), "id", whole(F.col("v"), scale).alias("x"))
    table = Bucketed(spark, "r bigint, id bigint, x array<int>", ["r"], buckets_for(vectors), "vectors")
    table.append(table.dealt(kept))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = np.array([r.x for r in table.rows().select("x", rank.alias("rank")).orderBy("rank", "x").limit(k).collect()], np.int64).reshape(-1, dim)
    sums, counts = [[0] * dim for _ in centroids], [0] * len(centroids)
    moved, state = np.ones(len(centroids), bool), None
    for at in range(rounds + 1):
        if not moved.any():
            break
        if state is None:
            rows = table.rows().select("r", "x", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        else:
            rows = table.rows().select("r", "x").join(state.rows().select("r", "cluster", "distance").hint("shuffle_hash"), "r")
        after = Bucketed(spark, _STATE.replace(" long", " bigint"), ["r"], table.buckets, "assigned")
        after.append(rows.mapInArrow(_round(centroids, moved), _STATE))
        if state is not None:
            state.drop()
        state = after
        if at < rounds:
            for c, place, change in _changes(state.rows()):
                if place:
                    sums[c][place - 1] += change
                else:
                    counts[c] += change
            new = np.array([[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids.tolist(), strict=True)], np.int64).reshape(-1, dim)
            moved, centroids = (new != centroids).any(1), new
    found = table.rows().select("r", "id")
    found = found.join(state.rows().select("r", "cluster", "distance").hint("shuffle_hash"), "r") if state else found.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    result = materialize(found.select("id", "cluster", "distance"), "clusters")
    for used in (table, state):
        if used:
            used.drop()
    inertia = {r.cluster: int(r.s) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    fits = lambda n: n if n < 1 << 63 else None
    per_cluster = [(c, fits(n), fits(sum(inertia.values())), centroids[c].tolist()) for c, n in inertia.items()]
    totals = spark.createDataFrame(per_cluster, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return result.join(F.broadcast(totals), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows
