"""Near-duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Sketch: each document's distinct word shingles, hashed to 64 bits, give a digest of the set and a
MinHash signature. Documents with one set form a class, and only classes go on, so copies cost a
row. Forest: the signature is cut into trees; each tree is one sorted order of all classes by its
own part of the signature. In each order a class meets its neighbours with the longest common
prefixes. Depth adapts to the region: where few classes share the first value, all of them meet;
where many do, those that agree deeper meet, and every class of the region also meets the region's
medoids (the classes that agree most with its most frequent values), so that a star of copies around
one original holds together. Orders are dealt out by range over the whole key and the class number,
so no region, however hot, lands in one task; what stands at the borders of tasks meets in a second,
small pass. Signatures estimate the similarity of each meeting pair; only pairs far below the threshold
(over four standard deviations) go. Confirmation: full sets of the classes in the other pairs are made
again from their texts and compared exactly. Pairs already connected needn't be compared: the best
pair of each class is confirmed first, then all that still join two components. Crowded classes: where
too few of a class's regions are so small that all in them meet, the orders can't be relied on, and the
class also goes through an exact prefix-filter join: of two sets at the threshold the rarest shingles,
as many as may be missing and one, share one. All pairs of crowded classes in different components that
do so are compared.

Scale: signatures of classes are shuffled once per tree as one byte per value; texts are read twice
and only shingle sets of classes in candidate pairs and of crowded classes are shuffled. The filter of
the second reading is a bitmap of fixed size, as is the table of counts that says which shingles are rare
(any order of the shingles gives the same pairs; a good one makes their lists short). A shingle that
occurs in one component only is left out before lists are joined, so a hot group of copies makes no pairs.
A long list is joined in parts of PART sets, each two of them under a key of their own, so no key holds a frequent
shingle's pairs (their number still grows with the square of a list that holds many components).

Defined results: null or empty text has no shingles and links with nothing; text with fewer words
than a shingle is one shingle; rows with a null id take part and count last when a smallest id is
sought (a group of null ids alone has a null component); repeated rows are of one class; an empty
table gives an empty result; columns of the input beside id and text are ignored by `groups`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize, small_batches, text_of
from quarry.llm.components import components, joined

#: Trees, values in each, and neighbours on each side that a class meets in an order.
TREES, DEPTH, NEAR = 10, 12, 8
K = TREES * DEPTH
#: Bits of the second reading's filter (2 MB) and words kept in a task's table.
FILTER_BITS, MAX_WORDS = 1 << 24, 150_000
#: Standard deviations below the threshold at which an estimate still counts as a candidate.
SLACK = 4.5
#: A pair may be left to the regions in which all meet if it shares none of them with this probability at most.
MISS = 1e-5
#: Sets in a part of a shingle's list: lists are compared part by part, so a frequent shingle's pairs are many tasks' work.
PART = 512
#: Bits of a shingle that say under which count it stands (8 MB).
COUNT_BITS = 20
_SKETCH = "doc_id long, t1 long, t2 int, k1 long, k2 long, n_shingles long, signature binary"
_ORDER = "tree int, key binary, node long, n long, bytes binary"
_MET = "a long, b long, agree int, edge boolean, tree int, key binary, node long, n long, bytes binary"
_MET_SCHEMA = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()), ("edge", pa.bool_()), ("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64()), ("n", pa.int64()), ("bytes", pa.binary())]
)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, as far as they were met lately."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MAX_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


class Shingler:
    """Sets of word shingles as sorted distinct 64-bit hashes.

    bytes.lower() and bytes.split() treat exactly A-Z and [\\x20\\x09-\\x0D]."""

    def __init__(self, words: int):
        self.words, self.known, self.factors = words, _Words(), _odd(words, 5)

    def __call__(self, text: str) -> np.ndarray:
        split = text.encode().lower().split()
        n = len(split)
        if not n:
            return np.zeros(0, np.uint64)
        one = np.fromiter(map(self.known.__getitem__, split), np.uint64, n)
        if n < self.words:
            return _mixed((one * self.factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        out = one[: n - self.words + 1] * self.factors[0]
        for i in range(1, self.words):
            out += one[i : n - self.words + 1 + i] * self.factors[i]
        return np.unique(_mixed(out))


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh128_digest(shingles.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signatures(sets: list[np.ndarray]) -> list[bytes]:
    """K minima of each set, 32 bits each, big-endian. Sets are joined, a few 100,000 shingles at a time."""
    out: list[bytes] = []
    factors, low = _odd(K, 7), 0
    while low < len(sets):
        high, size = low, 0
        while high < len(sets) and (high == low or size + len(sets[high]) <= 200_000):
            size += len(sets[high])
            high += 1
        full = [s for s in sets[low:high] if len(s)]
        minima = np.zeros((len(full), K), ">u4")
        if full:
            flat, starts = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
            for i, a in enumerate(factors):
                minima[:, i] = np.minimum.reduceat(flat * a, starts) >> np.uint64(32)
        rows = iter(minima)
        out += [next(rows).tobytes() if len(s) else b"" for s in sets[low:high]]
        low = high
    return out


def _sketch(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                sets = [shingles(t) for t in part.column(1).to_pylist()]
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signatures(sets), pa.binary())],
                    names=["doc_id", "t1", "t2", "k1", "k2", "n_shingles", "signature"],
                )

    return run


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each class and tree: the tree's key, and all values cut to one byte."""
    for batch in batches:
        for low in range(0, batch.num_rows, 2048):
            part = batch.slice(low, 2048)
            node, n, raw = part.column(0), part.column(1), part.column(2).to_pylist()
            values = np.frombuffer(b"".join(raw), ">u4").reshape(len(raw), K)
            short = pa.array([r.tobytes() for r in (values & 0xFF).astype(np.uint8)], pa.binary())
            for t in range(TREES):
                keys = pa.array([r[4 * t * DEPTH : 4 * (t + 1) * DEPTH] for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), keys, node, n, short], names=["tree", "key", "node", "n", "bytes"])


class _Rows:
    """Rows of an order as arrays."""

    def __init__(self, tree: np.ndarray, key: list[bytes], node: np.ndarray, n: np.ndarray, values: np.ndarray):
        self.tree, self.key, self.node, self.n, self.values = tree, key, node, n, values
        first = np.frombuffer(b"".join(k[:4] for k in key), ">u4").astype(np.int64)
        self.region = (tree.astype(np.int64) << 32) | first

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Rows:
        tree, key, node, n, raw = (batch.column(batch.schema.get_field_index(c)) for c in ("tree", "key", "node", "n", "bytes"))
        values = np.frombuffer(b"".join(raw.to_pylist()), np.uint8).reshape(batch.num_rows, K)
        return cls(tree.to_numpy(), key.to_pylist(), node.to_numpy(), n.to_numpy(), values)

    def take(self, at: np.ndarray) -> _Rows:
        return _Rows(self.tree[at], [self.key[i] for i in at.tolist()], self.node[at], self.n[at], self.values[at])

    def plus(self, other: _Rows) -> _Rows:
        return _Rows(*(np.concatenate([getattr(self, c), getattr(other, c)]) if c != "key" else self.key + other.key for c in ("tree", "key", "node", "n", "values")))

    def edges(self) -> pa.RecordBatch:
        m = len(self.node)
        nothing = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [*nothing, pa.array(np.ones(m, bool)), pa.array(self.tree), pa.array(self.key, pa.binary()), pa.array(self.node), pa.array(self.n), pa.array([v.tobytes() for v in self.values], pa.binary())], schema=_MET_SCHEMA
        )


def _medoids(rows: _Rows, low: int, high: int, most: int = 2) -> np.ndarray:
    """The rows of a region that agree most with its most frequent value at each place."""
    values = rows.values[low:high]
    modal = np.array([np.bincount(column, minlength=256).argmax() for column in values.T], np.uint8)
    return low + np.argsort(-(values == modal).sum(1), kind="stable")[:most]


def _meet(percent: int, least: int, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that meet in the part of the orders that this task has. edges: also give the rows at its borders."""

    def passing(rows: _Rows, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = rows.region[i] == rows.region[j]
        small, large = np.minimum(rows.n[i], rows.n[j]), np.maximum(rows.n[i], rows.n[j])
        go = same & (100 * small >= percent * large) & (rows.node[i] != rows.node[j])
        i, j = i[go], j[go]
        agree = (rows.values[i] == rows.values[j]).sum(1, dtype=np.int32)
        go = agree >= least
        if go.any():
            x, y, agree = rows.node[i[go]], rows.node[j[go]], agree[go]
            m = len(agree)
            rest = [pa.nulls(m, f.type) for f in _MET_SCHEMA][4:]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(agree), pa.array(np.zeros(m, bool)), *rest], schema=_MET_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: _Rows | None = None  # the last rows so far
        hubs: _Rows | None = None  # medoids of the region that may go on
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                rows = _Rows.of(batch.slice(start, 8192))
                if edges and before is None:
                    yield rows.take(np.arange(min(NEAR, len(rows.node)))).edges()
                kept = 0 if before is None else len(before.node)
                rows = rows if before is None else before.plus(rows)
                size = len(rows.node)
                for s in range(1, NEAR + 1):
                    j = np.arange(max(s, kept), size)
                    yield from passing(rows, j - s, j)
                borders = np.flatnonzero(np.diff(rows.region)) + 1
                ends = [0, *borders.tolist(), size]
                for low, high in zip(ends, ends[1:], strict=False):
                    if high - low > 2 * NEAR:
                        hub = _medoids(rows, low, high)
                        for h in hub.tolist():
                            yield from passing(rows, np.full(high - low, h), np.arange(low, high))
                        if hubs is not None and hubs.region[0] == rows.region[low]:
                            both = rows.take(np.arange(low, high)).plus(hubs)
                            for h in range(high - low, len(both.node)):
                                yield from passing(both, np.full(high - low, h), np.arange(high - low))
                            hub_rows = rows.take(hub).plus(hubs.take(np.arange(min(2, len(hubs.node)))))
                        else:
                            hub_rows = rows.take(hub)
                        hubs = hub_rows if high == size else hubs
                before = rows.take(np.arange(max(0, size - NEAR), size))
        if edges and before is not None:
            yield (before if hubs is None else before.plus(hubs)).edges()

    return run


def _crowded(orders: DataFrame, percent: int) -> DataFrame:
    """node: classes with too few regions in which all meet (of two classes that share a region both count it)."""
    enough = next((m for m in range(1, TREES) if (1 - percent / 100) ** m <= MISS), TREES)
    placed = orders.select("tree", F.substring("key", 1, 4).alias("first"), "node")
    large = placed.groupBy("tree", "first").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > NEAR + 1)
    large = materialize(large.select("tree", "first"), "large")
    out = placed.join(large, ["tree", "first"]).groupBy("node").agg(F.count(F.lit(1)).alias("trees")).where(F.col("trees") > TREES - enough)
    out = materialize(out.select("node"), "crowded")
    discard(large)
    return out


def _candidates(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes (a > b) that meet in some order and whose signatures agree well enough, with the
    number of agreeing values; and the crowded classes."""
    p = percent / 100
    least = int(np.floor(K * p - SLACK * np.sqrt(K * p * (1 - p))))
    orders = materialize(classes.select("node", "n_shingles", "signature").mapInArrow(_orders, _ORDER), "orders")
    ordered = orders.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    met = materialize(ordered.mapInArrow(_meet(percent, least, True), _MET), "met")
    borders = met.where("edge").select("tree", "key", "node", "n", "bytes")
    again = borders.repartition("tree", F.substring("key", 1, 4)).sortWithinPartitions("tree", "key", "node").mapInArrow(_meet(percent, least, False), _MET)
    pairs = met.where(~F.col("edge")).unionByName(again).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    crowded = _crowded(orders, percent)
    discard(orders)
    pairs = materialize(pairs, "pairs")
    discard(met)
    return pairs, crowded


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Which values of a hash of FILTER_BITS occur: at most 512 rows of 4 KB come to the driver."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long")
    blocks = ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS + (1 << 15), bool)
    for block, bits in blocks:
        # Buckets count from 1 for positions 1 to 2**15; 0 stands for the rest.
        own = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        out[(block - 1) * (1 << 15) + 1 if block else 0 :][: len(own)] |= own.astype(bool)
    return out


def _sets(docs: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """node, set: full sorted shingle sets of the needed classes (node, doc_id, k1, k2), made from texts."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(needed.where("doc_id IS NOT NULL"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, own = Shingler(words), np.unpackbits(bits.value).view(bool)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                bit = part.column(2).to_numpy(zero_copy_only=False)
                go = own[bit] | np.asarray(part.column(0).is_null())
                part = part.filter(pa.array(go))
                if part.num_rows:
                    sets = [shingles(t) for t in part.column(1).to_pylist()]
                    digests = [_digest(s) for s in sets]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "k1", "k2", "set"]
                    )

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("long").alias("bit")
    made = docs.select("doc_id", "text", bit).mapInArrow(run, "doc_id long, k1 long, k2 long, set binary")
    same = (made.k1 == needed.k1) & (made.k2 == needed.k2) & made.doc_id.eqNullSafe(needed.doc_id)
    # Repeated rows (one id, one text) come several times; any of them serves.
    return made.join(needed.hint("merge"), same).groupBy("node").agg(F.first("set").alias("set"))


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                go = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    go.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select(["a", "b"]).filter(pa.array(go, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return materialize(both.mapInArrow(_confirm(percent), "a long, b long"), "confirmed")


def _counts(sets: DataFrame) -> np.ndarray:
    """In how many sets shingles occur, those with the same first COUNT_BITS together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                shingles = np.frombuffer(b"".join(batch.column(0)[low : low + 1024].to_pylist()), np.uint64)
                counts += np.bincount((shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["at", "n"])

    found = sets.select("set").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out


def _prefixed(sets: DataFrame, percent: int) -> DataFrame:
    """A row for each of the rarest shingles of each set (node, root, set): of two sets at the threshold these share one."""
    counts = sets.sparkSession.sparkContext.broadcast(_counts(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                own, sizes = [], []
                for raw in part.column(2).to_pylist():
                    shingles = np.frombuffer(raw, np.uint64)
                    n = len(shingles)
                    order = np.lexsort((shingles, counts.value[(shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))
                    own.append(shingles[order[: n + percent * n // -100 + 1]])
                    sizes.append(n)
                times = [len(x) for x in own]
                columns = [np.concatenate(own).view(np.int64), *(np.repeat(c.to_numpy(), times) for c in part.columns[:2]), np.repeat(sizes, times), np.concatenate([np.arange(t) for t in times])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "node", "root", "n", "at"])

    return materialize(sets.select("node", "root", "set").mapInArrow(run, "shingle long, node long, root long, n long, at long"), "prefixes")


def _apart(crowded: DataFrame, sets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """All pairs of crowded classes in different components that may be at the threshold."""
    own = sets.join(crowded, "node", "left_semi").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = materialize(own.select("node", "root", "set"), "crowded-sets")
    rows = _prefixed(own, percent)
    several = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    several = materialize(several.select("shingle", F.ceil(F.col("size") / PART).cast("int").alias("parts")), "several")
    live = rows.join(several, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    live = materialize(live, "live")
    discard(own, rows, several)
    # A pair meets once for a shingle: where the part of the one and that of the other are compared.
    other = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    x, y = (other.select("shingle", F.col(mine).alias("part_a"), F.col(its).alias("part_b"), *(F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "n", "at"))) for side, mine, its in (("a", "own", "other"), ("b", "other", "own")))
    # What the sets can have in common, counted from the first shingle that they share.
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    able = (100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))
    same = (x.shingle == y.shingle) & (x.part_a == y.part_a) & (x.part_b == y.part_b)
    met = x.join(y, same & (F.col("node_a") > F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & able)
    out = materialize(met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "apart")
    discard(live)
    return out


def _linked(pairs: DataFrame, crowded: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, words: int) -> DataFrame:
    """node, root for all classes with a confirmed link, written."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(crowded).distinct()
    needed = materialize(classes.join(ends, "node", "left_semi").select("node", "doc_id", "k1", "k2"), "needed")
    sets = materialize(_sets(docs, needed, words), "sets")
    ranked = pairs.select("a", "b", "agree")
    best = ranked.select(F.col("a").alias("node"), "agree", "b").unionByName(ranked.select(F.col("b").alias("node"), "agree", F.col("a").alias("b")))
    best = best.groupBy("node").agg(F.max(F.struct("agree", "b")).alias("best")).select(F.greatest("node", "best.b").alias("a"), F.least("node", "best.b").alias("b"))
    first = _confirmed(best.distinct(), sets, percent)
    roots = components(first)
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a")), roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    apart = pairs.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    second = _confirmed(apart, sets, percent)
    discard(pairs, needed)
    linked = joined(roots, second)
    met = _apart(crowded, sets, linked, percent)
    third = _confirmed(met, sets, percent)
    out = joined(linked, third)
    discard(first, second, third, crowded, sets, met)
    return out


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


def _labelled(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, t1, t2, k1, k2, n_shingles of each document, and k1, k2, root, component_id of each class, written."""
    small_batches(docs.sparkSession)
    text = text_of(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *_keys(text))
    sketch = materialize(docs.mapInArrow(_sketch(words), _SKETCH), "sketch")
    rows = materialize(sketch.select("doc_id", "t1", "t2", "k1", "k2", "n_shingles"), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    # Every row of a class has the same signature.
    classes = sketch.where("n_shingles > 0").groupBy("k1", "k2").agg(first, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = materialize(classes.select("k1", "k2", "least.doc_id", "n_shingles", "signature", F.monotonically_increasing_id().alias("node")), "classes")
    discard(sketch)
    roots = _linked(*_candidates(classes, percent), docs, classes, percent, words)
    placed = materialize(classes.select("node", "k1", "k2", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    least = materialize(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    labels = materialize(placed.join(least, "root").select("k1", "k2", "root", "component_id"), "labels")
    discard(classes, roots, placed, least)
    return rows, labels


def groups(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    rows, labels = _labelled(docs, percent, words, id_col, text_col)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(labels, ["k1", "k2"], "left").select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of `docs`, whole: that with the smallest id (a null id counts last; of several texts
    under it, that with the smallest hash; of repeated rows, any). Rows without shingles stay."""
    rows, labels = _labelled(docs, percent, words, id_col, text_col)
    keys = rows.where("n_shingles > 0").join(labels, ["k1", "k2"])
    keys = materialize(keys.groupBy("root", "doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("copies")), "keys")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    least = materialize(keys.groupBy("root").agg(F.min(place).alias("least")), "least")
    fates = keys.join(least, "root").withColumn("first", place == F.col("least"))
    fates = fates.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "first", "copies")
    gone, repeated = materialize(fates.where("NOT first"), "gone"), materialize(fates.where("first AND copies > 1"), "repeated")
    discard(rows, labels, keys, least)
    own = [F.col(id_col).cast("long"), *_keys(text_of(text_col))]

    def among(frame: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return frame.join(keys, own[0].eqNullSafe(keys["_id"]) & (own[1] == keys["_t1"]) & (own[2] == keys["_t2"]), how)

    left = among(docs, gone, "left_anti")
    if repeated.isEmpty():
        return left
    one = among(left, repeated, "left_semi").withColumns({f"_key{i}": c for i, c in enumerate(own)}).dropDuplicates(["_key0", "_key1", "_key2"])
    return among(left, repeated, "left_anti").unionByName(one.select(*docs.columns))
