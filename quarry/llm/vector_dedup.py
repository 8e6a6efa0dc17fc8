"""Near-duplicate vectors: iterative quantisation, multi-index Hamming tables, exact rerank.

Learning: on a bounded sample (of each of the LEARNED commonest lengths, at most SAMPLE vectors in all, chosen by
hashes of their ids) rotations are learned that make the signs of the rotated vectors balanced binary codes of
small quantisation error (ITQ: alternate between the codes and the orthogonal Procrustes rotation). Other lengths take
planes at random, made from their length alone.
Index: every vector's code is cut into substrings, one Hamming table each; two vectors meet if a
substring is the same. Rerank: vectors that meet are compared by cosine of the original vectors in
double precision, in blocks by matrix product.

Equal vectors of a label form a class, and only classes go on. Only members of buckets with company
are shuffled with their vectors. A bucket of many classes is dealt out in cells: its classes fall into
parts of about CELL by hash, and each pair of parts is a cell of its own task's stream, so no bucket has
to fit a task. A pair counts in the first table where it meets alone, so counts need no distinct. Cells
give the number of links of each class and a spanning forest of the links, never the pairs themselves.

Recall: the length of a substring grows with the logarithm of the number of vectors, so that buckets don't fill by chance,
and the number of tables with it, so that a pair at the threshold misses all with a probability of about MISS, and
nearer ones with less (measured by tests/llm/recall.py). Vectors are centred, which widens the angles between those near the
mean: the tables are as many as the wider angle asks for, and where it would be over twice as wide vectors stay as they are.
Lengths of which no label has more than FEW vectors are compared whole.

Defined results: null or zero vectors, and vectors that hold null or non-finite components, link with
nothing, as do vectors with a null label; vectors of different lengths aren't compared; rows
with null ids take part and count last when a smallest id is sought; repeated rows are vectors of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize
from quarry.llm.components import components

#: Bound of the sample that rotations are learned on, in vectors and in components, and of the lengths that have learned ones.
SAMPLE, COMPONENTS, LEARNED = 20_000, 4_000_000, 16
#: Shortest and longest vectors that rotations are learned for: in few dimensions learned ones are too alike to miss apart.
SHORTEST, LONGEST = 16, 1024
STEPS, CELL = 40, 512
#: Least bits of a substring, vectors of a label for which a bucket may have one by chance, and what a pair may miss all tables with.
BITS, COMPANY, MISS = 16, 32, 2e-3
#: Vectors of a label that a length may have at most to be compared whole.
FEW = 32
_MET = "a long, b long, n long"
_MET_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def shape(n: int, angle: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for n vectors: chance company in a bucket stays about the same
    whatever n is, and a pair at that angle misses all tables with a probability of at most MISS."""
    bits = min(max(BITS, int(np.ceil(np.log2(max(n, 1) / COMPANY)))), 62)
    same = (1 - angle / np.pi) ** bits
    return bits, int(np.ceil(np.log(MISS) / np.log1p(-same))) if same < 1 else 1


class Planes:
    """Projections of vectors of one length to bits. Without a sample they are at random, else learned: matrices of the dimension's size."""

    def __init__(self, dim: int, n: int, threshold: float, sample: np.ndarray | None = None):
        angle, rng = float(np.arccos(min(threshold, 1.0))), np.random.default_rng(dim)
        self.mean = np.zeros(dim)
        if sample is None:
            self.bits, self.tables = shape(n, angle)
            self.planes = rng.standard_normal((dim, self.bits * self.tables))
            return
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        away = unit - unit.mean(0)
        near = np.quantile(np.linalg.norm(away, axis=1), 0.05)
        wide = 2 * np.arcsin(min(1.0, np.sin(angle / 2) / max(near, 1e-9)))
        if wide <= 2 * angle:
            unit, self.mean, angle = away, unit.mean(0), wide
        self.bits, self.tables = shape(n, angle)
        axes = np.linalg.svd(unit.T @ unit)[0]
        projected, planes = unit @ axes, []
        for _ in range(-(-self.bits * self.tables // dim)):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            for _ in range(STEPS):
                codes = np.where(projected @ turn >= 0, 1.0, -1.0)
                u, _, v = np.linalg.svd(codes.T @ projected)
                turn = (u @ v).T
            planes.append(axes @ turn)
        self.planes = np.hstack(planes)[:, : self.bits * self.tables]

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """The substrings of all codes: a row per vector, a column per table."""
        bits = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True) - self.mean) @ self.planes >= 0
        out = np.zeros((len(vectors), self.tables), np.int64)
        for i in range(self.bits):
            out |= bits[:, i :: self.bits].astype(np.int64) << i
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dim)


def _learn(classes: DataFrame, sample_size: int, threshold: float) -> tuple[dict[int, Planes], dict[int, int]]:
    """Learned planes of the commonest lengths, and of the other ones with more than FEW vectors of a label their largest number in a label."""
    dim = F.size("vector")
    counts = classes.groupBy("label", dim.alias("dim")).count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n"))
    found = counts.where(F.col("most") > FEW).orderBy(F.desc("n"), "dim").collect()
    able = [r for r in found if SHORTEST <= r.dim <= LONGEST][:LEARNED]
    takes = {r.dim: min(sample_size // len(able), COMPONENTS // len(able) // r.dim) for r in able}
    learned: dict[int, Planes] = {}
    if able:
        share = F.lit(-1.0)
        for r in able:
            share = F.when(dim == r.dim, takes[r.dim] / r.n).otherwise(share)
        place = F.pmod(F.xxhash64("vec_id", "digest"), F.lit(1 << 30)) / float(1 << 30)
        rows = classes.where(place < share).select(dim.alias("dim"), "digest", "vector").toArrow().combine_chunks().sort_by([("dim", "ascending"), ("digest", "ascending")])
        lengths = rows.column("dim").to_numpy()
        for r in able:
            at = np.flatnonzero(lengths == r.dim)[: takes[r.dim]]
            if len(at):
                learned[r.dim] = Planes(r.dim, r.most, threshold, _matrix(rows.column("vector").take(pa.array(at)).combine_chunks(), r.dim))
    return learned, {r.dim: r.most for r in found if r.dim not in learned}


def _tables(learned: dict[int, Planes], others: dict[int, int], threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of all vectors. Those of a length with few have one key, the same for all: they are compared with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, Planes] | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                dims, keys = np.diff(part.column(1).offsets.to_numpy()), [[0]] * part.num_rows
                for dim in np.unique(dims).tolist():
                    planes = learned.get(dim)
                    if planes is None and dim in others:
                        last = last if last and last[0] == dim else (dim, Planes(dim, others[dim], threshold))
                        planes = last[1]
                    if planes is not None:
                        at = np.flatnonzero(dims == dim)
                        for i, own in zip(at.tolist(), planes.keys(_matrix(part.column(1).take(pa.array(at)), dim)).tolist(), strict=True):
                            keys[i] = own
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(dims.astype(np.int32)), pa.array(keys, pa.list_(pa.int64()))], names=["node", "dim", "keys"])

    return run


class _Cell:
    """The classes of a cell, as they come in; parts: those of its first and its second part."""

    def __init__(self, cell: tuple):
        self.cell, self.parts = cell, []

    def add(self, part: pa.RecordBatch) -> None:
        self.parts.append(part)

    def met(self, threshold: float) -> Iterator[pa.RecordBatch]:
        """Links of the cell: counts per class (a = the class, n = linked vectors), and a forest (a > b, n = 0)."""
        rows = pa.concat_batches(self.parts) if len(self.parts) > 1 else self.parts[0]
        if rows.num_rows < 2:
            return
        _, dim, table, *_ = self.cell
        node, weight, side = (rows.column(rows.schema.get_field_index(c)).to_numpy() for c in ("node", "weight", "side"))
        vectors = _matrix(rows.column(rows.schema.get_field_index("vector")), dim)
        keys = np.asarray(rows.column(rows.schema.get_field_index("keys")).flatten()).reshape(len(node), -1)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        one = not len(second) and self.cell[-2] == self.cell[-1]
        second = first if one else second
        counts, root = np.zeros(len(node), np.int64), np.arange(len(node))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for low in range(0, len(first), 512):
            at = first[low : low + 512]
            close = unit[at] @ unit[second].T >= threshold
            if one:
                close &= at[:, None] < second[None, :]
            i, j = np.nonzero(close)
            i, j = at[i], second[j]
            if table and len(i):  # those that met before count there
                fresh = ~(keys[i, :table] == keys[j, :table]).any(1)
                i, j = i[fresh], j[fresh]
            np.add.at(counts, i, weight[j])
            np.add.at(counts, j, weight[i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        linked = np.flatnonzero(counts)
        if len(linked):
            roots = np.array([find(i) for i in linked.tolist()])
            own = roots != linked
            a, b = node[linked[own]], node[roots[own]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[linked], np.maximum(a, b)])), pa.array(np.concatenate([node[linked], np.minimum(a, b)])), pa.array(np.concatenate([counts[linked], np.zeros(len(a), np.int64)]))], schema=_MET_SCHEMA
            )


_CELL_KEY = ["label", "dim", "table", "key", "part_a", "part_b"]


def _rerank(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows in the order of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: _Cell | None = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _CELL_KEY]
            changes = np.zeros(batch.num_rows, bool)
            for c in columns:
                changes[1:] |= c[1:] != c[:-1]
            ends = [0, *np.flatnonzero(changes).tolist(), batch.num_rows]
            for low, high in zip(ends, ends[1:], strict=False):
                if high == low:
                    continue
                own = tuple(c[low].item() for c in columns)
                if cell is None or cell.cell != own:
                    if cell is not None:
                        yield from cell.met(threshold)
                    cell = _Cell(own)
                cell.add(batch.slice(low, high - low))
        if cell is not None:
            yield from cell.met(threshold)

    return run


def _cells(classes: DataFrame, codes: DataFrame, cell: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of the cells of all buckets with company: the class with its vector and codes, once for each
    cell that its part of the bucket is in; and what was written for it."""
    placed = codes.select("node", "label", "dim", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "dim", "table", "key"]
    sizes = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("size") / cell).cast("int")), "buckets")
    members = placed.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("node", "table"), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    members = materialize(members.select("node", *bucket, "own", F.explode(other).alias("other")), "members")
    full = materialize(classes.join(codes.select("node", "keys"), "node").select("node", "weight", "vector", "keys"), "coded")
    rows = members.join(full, "node")
    rows = rows.select(*bucket, F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "weight", "vector", "keys")
    return rows.repartition(*_CELL_KEY).sortWithinPartitions(*_CELL_KEY), [sizes, members, full]


def link(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("long").alias("label"))
    able = F.coalesce(v.isNotNull() & F.col("label").isNotNull() & finite & some, F.lit(False))
    # Equal components in text have equal digests; -0.0 is written as 0.0.
    digest = F.when(able, F.sha2(F.to_json(F.transform(v, lambda x: x + F.lit(0).cast("float"))), 256))
    rows = rows.select("vec_id", "label", "vector", digest.alias("digest"))
    usual = rows.where("digest IS NOT NULL")
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")).alias("least")
    classes = usual.groupBy("label", "digest").agg(first, F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector"))
    classes = materialize(classes.select("label", "digest", "least.vec_id", "weight", "vector", F.monotonically_increasing_id().alias("node")), "classes")
    keys = classes.select("node", "vector").mapInArrow(_tables(*_learn(classes, sample, threshold), threshold), "node long, dim int, keys array<long>")
    codes = materialize(keys.join(classes.select("node", "label"), "node"), "codes")
    cells, written = _cells(classes, codes, cell)
    met = materialize(cells.mapInArrow(_rerank(threshold), _MET), "met")
    discard(codes, *written)
    counts = met.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(met.where("n = 0"))
    placed = classes.select("node", "label", "digest", "vec_id", "weight").join(counts, "node", "left").join(roots, "node", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "node")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    labels = placed.join(least, "root").select("label", "digest", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    labels = materialize(labels, "labels")
    discard(classes, met, roots, placed, least)
    out = rows.select("vec_id", "label", "digest").join(labels, ["label", "digest"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
