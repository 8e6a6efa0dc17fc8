"""Connected components of an undirected graph that is given as a table of links.

Large-star and small-star steps alternate until nothing changes: every node's neighbours are linked
to the smallest of them, until all links point at the smallest node of a component. Each step's
links are written to the shared folder. The smallest neighbour is found by partial aggregation and
written before it is joined, so both join sides are plain exchanges and AQE can split a hub.

Within a task links are contracted first (each node points at the smallest node that the task's links reach from it). Tasks
take about TOGETHER links each, however many partitions a shuffle has, so few rounds are left: none for a graph
of up to TOGETHER links, and a larger one is always dealt out over several tasks.

Defined results: self-links and repeated links change nothing; no links give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize


#: Links that a task contracts together.
TOGETHER = 100_000


def _state(links: DataFrame) -> tuple:
    """Tells two sets of links apart: their number and an order-free digest."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same components with each node of a task linked to its smallest."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(up.setdefault(a, a)), find(up.setdefault(b, b))
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = [x for x in up if up[x] != x]
    for low in range(0, len(nodes), 100_000):
        part = nodes[low : low + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(find, part), pa.int64())], names=["a", "b"])


def _step(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over distinct links a > b, contracted by so many tasks at most."""
    around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(around.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "star")
    joined = around.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u")) if large else joined.unionByName(least.select("u", F.col("u").alias("v"), "m"))
    out = materialize(moved.where(F.col("v") > F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(tasks).mapInArrow(_contract, "a long, b long"), "links")
    discard(least, links)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row for each node with a link: node, root (the smallest node of its component). Written."""
    at, to = F.col(a).cast("long"), F.col(b).cast("long")
    links = materialize(links.select(F.greatest(at, to).alias("a"), F.least(at, to).alias("b")).where(F.col("a") != F.col("b")).distinct().mapInArrow(_contract, "a long, b long"), "links")
    state = _state(links)
    while state[0]:
        tasks = -(-state[0] // TOGETHER)
        if tasks == 1:
            before, links = links, materialize(links.coalesce(1).mapInArrow(_contract, "a long, b long"), "links")
            discard(before)
            break
        links = _step(_step(links, large=True, tasks=tasks), large=False, tasks=tasks)
        before, state = state, _state(links)
        if state == before:
            break
    each = links.distinct()
    found = each.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = materialize(found.unionByName(each.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    discard(links)
    return out


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, root) of which some are linked by (a, b), written anew: only the links between
    different ones are looked at."""
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    between = links.select("a", "b").join(left, "a", "left").join(right, "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    between = materialize(between.where("a <> b").distinct(), "between")
    if between.isEmpty():
        discard(between)
        return roots
    more = components(between)
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    out = materialize(moved.unionByName(more.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")
    discard(between, more, roots)
    return out
