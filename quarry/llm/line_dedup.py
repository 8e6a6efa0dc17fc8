"""Line dedup: levelled sorted runs of line hashes.

A batch of documents becomes one run: line hash and number of its documents, bucketed and sorted by hash. Runs
of a level are compacted into one of the next level when `fanout` of them have gathered. Before a
batch becomes a run, its lines are merge-joined with each level, and those that earlier runs have already
brought to the limit go (an anti-join with the hashes at the limit), so hot lines are not carried again. All levels have the
same buckets, so they are merged, compacted and joined bucket by bucket, without an exchange. A last merge of the runs gives the hashes
at the limit, and the lines that carry them are dropped. One pass over the documents counts lines for all batches (documents are
dealt out to them by the hash of their text); from then on only hashes are read.

Scale: runs hold 20 bytes per distinct line; counting is pre-aggregated before its shuffle. The hashes at the limit
go to all tasks if they are at most MAX_SENT (checked), and then texts aren't shuffled. If they are more, positions to drop are
found by a join and go back to documents by the hash of the text, as what a document loses depends on its text alone. Both
sides of that join are plain exchanges, so AQE splits a text with very many copies.

Defined results: null or empty text is one empty line; a line's key is stripped of
[\\x20\\x09-\\x0D] and A-Z lower-cased; keys shorter than `min_points` are never dropped; a key
counts once per row, however often the row repeats it; repeated rows count as documents of their
own; ids may be null; an empty table gives an empty result; other columns are kept, but for ones named
n_lines, n_dropped or kept_text, which give way to the new ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WHITE, Bucketed, ascii_lower, buckets_for, delete, discard, fresh_path, key_columns, materialize, text_of, unused

#: Hashes at the limit that may be sent to all tasks (12 bytes each).
MAX_SENT = 1_000_000
_TEXT_KEY = ["t1", "t2"]
_LINE_KEY = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _keys(text: Column) -> Column:
    """Keys of a text's lines, in order."""
    return F.transform(_lines(ascii_lower(text)), lambda line: F.btrim(line, F.lit(WHITE)))


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2")]


class LineRuns:
    """Counts of documents per line hash in levelled sorted runs. The runs of a level are the files of one bucketed table."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_points: int = 1, fanout: int = 4, buckets: int = 8):
        self.spark, self.min_docs, self.min_points, self.fanout, self.buckets = spark, min_docs, min_points, fanout, buckets
        #: Each level's table (None where it has no run) and its number of runs.
        self.levels: list[tuple[Bucketed | None, int]] = []

    def counts(self, docs: DataFrame, text_col: str = "text", *by: Column) -> DataFrame:
        """h1, h2, n_docs (for each of `by`): in how many documents a line is."""
        keys = F.array_distinct(_keys(text_of(text_col)))
        lines = docs.select(*by, F.explode(keys).alias("line")).where(F.length("line") >= self.min_points)
        lines = lines.select(*lines.columns[:-1], *key_columns(F.col("line")))
        return lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("n_docs"))

    def add(self, docs: DataFrame, text_col: str = "text") -> None:
        """Count a batch; it becomes a run of level 0."""
        self.add_counts(self.counts(docs, text_col))

    def _merged(self, table: Bucketed) -> DataFrame:
        return table.rows().groupBy(*_LINE_KEY).agg(F.sum("n_docs").alias("n_docs"))

    def fresh(self, counts: DataFrame) -> DataFrame:
        """`counts` without what the runs have brought to the limit: each level is joined bucket by bucket, as it stands."""
        lines = counts.repartition(self.buckets, *_LINE_KEY).withColumn("before", F.lit(0).cast("long"))
        for table, _ in self.levels:
            if table:
                held = self._merged(table).withColumnRenamed("n_docs", "held")
                lines = lines.join(held.hint("merge"), _LINE_KEY, "left")
                lines = lines.select(*_LINE_KEY, "n_docs", (F.col("before") + F.coalesce("held", F.lit(0))).alias("before"))
        return lines.where(F.col("before") < self.min_docs).select(*_LINE_KEY, "n_docs")

    def add_counts(self, counts: DataFrame) -> None:
        self._put(0, self.fresh(counts))

    def _put(self, level: int, rows: DataFrame) -> None:
        if len(self.levels) == level:
            self.levels.append((None, 0))
        table, n = self.levels[level]
        table = table or Bucketed(self.spark, "h1 bigint, h2 int, n_docs bigint", _LINE_KEY, self.buckets, f"line-runs-{level}")
        table.append(rows)
        self.levels[level] = table, n + 1
        if n + 1 >= self.fanout:
            self._compact(level)

    def _compact(self, level: int) -> None:
        """Make the runs of a level one run of the next."""
        table, _ = self.levels[level]
        self.levels[level] = None, 0
        self._put(level + 1, self._merged(table))
        table.drop()

    def at_limit(self) -> DataFrame:
        """Hashes of the lines found in at least `min_docs` documents so far; compacts all levels into the last."""
        for level in range(len(self.levels) - 1):
            if self.levels[level][0]:
                self._compact(level)
        return self._merged(self.levels[-1][0]).where(F.col("n_docs") >= self.min_docs).select(*_LINE_KEY)

    def drop(self) -> None:
        for table, _ in self.levels:
            if table:
                table.drop()
        self.levels = []


def count_in_batches(docs: DataFrame, runs: LineRuns, batches: int, text_col: str = "text") -> None:
    """Add all documents to `runs` in batches; texts are read once."""
    spark, path = docs.sparkSession, fresh_path(docs.sparkSession, "line-counts")
    batch = F.pmod(F.xxhash64(text_of(text_col)), F.lit(batches)).cast("int").alias("batch")
    counted = runs.counts(docs, text_col, batch)
    counted.write.partitionBy("batch").parquet(path)
    whole = spark.read.schema(counted.schema).parquet(path)
    for i in range(batches):
        runs.add_counts(whole.where(F.col("batch") == i).select(*_LINE_KEY, "n_docs"))
    delete(spark, path)


def _dropped_by_lookup(docs: DataFrame, limit: DataFrame, text: Column, gone: str) -> DataFrame:
    """`docs` with `gone`: positions of the lines to drop, looked up in the hashes that all tasks have."""
    own = limit.orderBy(*_LINE_KEY).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((own.column("h1").to_numpy(), own.column("h2").to_numpy()))

    @F.arrow_udf("array<int>")
    def places(first: pa.Array, second: pa.Array) -> pa.Array:
        h1, h2 = shared.value
        a, b = first.values.to_numpy(), second.values.to_numpy()
        starts = np.asarray(first.offsets)
        low, hit = np.searchsorted(h1, a), np.zeros(len(a), bool)
        for step in range(int(np.unique(h1, return_counts=True)[1].max(initial=0))):  # 1, but for equal h1
            at = np.minimum(low + step, len(h1) - 1)
            hit |= (h1[at] == a) & (h2[at] == b)
        at = np.flatnonzero(hit)
        row = np.searchsorted(starts, at, "right") - 1
        ends = np.searchsorted(at, starts)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((at - starts[row]).astype(np.int32)))

    name = unused("_keys", docs)
    keyed = docs.withColumn(name, _keys(text))
    hashes = [F.transform(name, lambda line: F.xxhash64(line)), F.transform(name, lambda line: F.hash(line))]
    return keyed.select(*docs.columns, places(*hashes).alias(gone))


def _dropped_by_join(docs: DataFrame, limit: DataFrame, text: Column, gone: str, min_points: int) -> DataFrame:
    """The same by joins, for any number of hashes."""
    placed = docs.select(*_text_key(text), F.posexplode(_keys(text)).alias("at", "line")).where(F.length("line") >= min_points)
    hits = placed.select(*_TEXT_KEY, "at", *key_columns(F.col("line"))).join(limit, _LINE_KEY, "left_semi")
    dropped = materialize(hits.groupBy(*_TEXT_KEY).agg(F.array_sort(F.collect_set("at")).alias("_dropped")), "line-drops")
    own = [dropped[n] == c for n, c in zip(_TEXT_KEY, _text_key(text), strict=True)]
    joined = docs.join(dropped, own[0] & own[1], "left")
    return joined.select(*(docs[c] for c in docs.columns), F.coalesce(dropped["_dropped"], F.array().cast("array<int>")).alias(gone))


def drop_repeated_lines(
    docs: DataFrame, min_docs: int = 10, min_points: int = 1, batches: int = 6, fanout: int = 4, text_col: str = "text", max_sent: int = MAX_SENT
) -> DataFrame:
    """All columns of `docs`, plus n_lines, n_dropped and kept_text (the lines that stay, joined by \\n)."""
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    runs = LineRuns(docs.sparkSession, min_docs, min_points, fanout, buckets_for(docs))
    count_in_batches(docs, runs, batches, text_col)
    limit, text = materialize(runs.at_limit(), "line-limit"), text_of(text_col)
    runs.drop()
    name = unused("_gone", docs)
    if limit.count() <= max_sent:
        placed = _dropped_by_lookup(docs, limit, text, name)
        discard(limit)
    else:
        placed = _dropped_by_join(docs, limit, text, name, min_points)
    split, gone = _lines(text), F.col(name)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    kept = F.when(F.size(gone) == 0, text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    return placed.select(
        *docs.columns, F.size(split).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), kept.alias("kept_text")
    )
