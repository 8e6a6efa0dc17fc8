"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

A batch is reduced to (id, code points, digest) and grouped by digest with partial aggregation. A sort-merge anti-join
with the index tells the digests that are new; these are appended to it with the row that stays and their number of rows.
What a batch holds of digests that the index has already (the semi-join's side) is appended to a second table bucketed
the same way, the changes: a later row with more code points, or as many and a smaller id, is the one that stays from
then on, and group sizes grow. The index joined with its changes, bucket by bucket, says for every digest seen so far which
row stays, so earlier rows can be looked up again. Everything is a DataFrame operation on the JVM.

Scale: texts are read once and never shuffled, only 32-byte digests are. What rows are looked up in is
written first, so both sides of that join are plain exchanges and AQE can split the partition of a hot digest
(a third of all rows may be copies of one text). Neither table is exchanged to be joined.

Defined results: null text counts as empty, so all empty and blank texts form one group; among
equal texts the most code points win, then the smallest id; rows with a null id lose to any other of as many code
points and stay only if all those ids are null; repeated rows are members of their group like any other (all
rows that carry the id that stays are marked kept); an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Bucketed, buckets_for, discard, fresh_path, materialize, text_of

_SCHEMA = "digest binary, n_points int, keep_id bigint, n_rows bigint"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_points, digest of each row."""
    text = text_of(text_col)
    bare = F.regexp_replace(text, "[ \\t-\\r]+", "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.length(text).alias("n_points"), F.unhex(F.sha2(bare, 256)).alias("digest"))


def _best(rows: DataFrame) -> DataFrame:
    """One row per digest: the row that stays of these (~id falls as id rises and cannot overflow; null
    sorts below every number), and how many there are."""
    first = F.max(F.struct("n_points", F.bitwise_not("keep_id").alias("inverse"))).alias("first")
    best = rows.groupBy("digest").agg(F.sum("n_rows").alias("n_rows"), first)
    return best.select("digest", "first.n_points", F.bitwise_not("first.inverse").alias("keep_id"), "n_rows")


class DigestIndex:
    """Digests seen so far, each with the row that stays and the number of its rows.

    `location` may be an earlier index's folder (its bucket count must be given again); without
    it a new one is made in the shared folder.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 32):
        self.spark = spark
        self.location = location or fresh_path(spark, "digest-index")
        self.index = Bucketed(spark, _SCHEMA, ["digest"], buckets, "digest-index", f"{self.location}/index")
        self.changes = Bucketed(spark, _SCHEMA, ["digest"], buckets, "digest-changes", f"{self.location}/changes")

    def rows(self) -> DataFrame:
        """Every digest once, as it came first."""
        return self.index.rows()

    def append(self, rows: DataFrame) -> None:
        """Add a batch (id, n_points, digest)."""
        best = _best(rows.select("digest", "n_points", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n_rows")))
        batch = Bucketed(self.spark, _SCHEMA, ["digest"], self.index.buckets, "digest-batch")
        batch.append(batch.dealt(best))
        known = self.rows().select("digest")
        self.changes.append(batch.rows().join(known.hint("merge"), "digest", "left_semi"))
        self.index.append(batch.rows().join(known.hint("merge"), "digest", "left_anti"))
        batch.drop()

    def winners(self) -> DataFrame:
        """digest, keep_id, group_size for every digest seen so far."""
        later = _best(self.changes.rows()).select("digest", *(F.col(c).alias(f"_{c}") for c in ("n_points", "keep_id", "n_rows")))
        place = lambda points, own: F.struct(F.col(points), F.bitwise_not(own))
        better = F.col("_n_points").isNotNull() & (place("_n_points", "_keep_id") > place("n_points", "keep_id"))
        both = self.rows().join(later.hint("merge"), "digest", "left")
        size = F.col("n_rows") + F.coalesce("_n_rows", F.lit(0))
        return both.select("digest", F.when(better, F.col("_keep_id")).otherwise(F.col("keep_id")).alias("keep_id"), size.alias("group_size"))

    def resolve(self, rows: DataFrame) -> DataFrame:
        """id, keep_id, group_size, kept, digest of each row (id, digest), by all batches so far. Written."""
        winners = materialize(self.winners(), "winners")
        kept = F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
        out = materialize(rows.select("id", "digest").join(winners, "digest").select("id", "keep_id", "group_size", kept, "digest"), "resolved")
        discard(winners)
        return out

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add a batch of documents; what is known of each of its rows then. Rows of earlier batches may be
        given to `resolve` again."""
        rows = materialize(digests(docs, id_col, text_col), "digests")
        self.append(rows)
        out = self.resolve(rows)
        discard(rows)
        return out

    def drop(self) -> None:
        for table in (self.index, self.changes):
            table.drop()


def in_batches(docs: DataFrame, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What `resolve` gives for all of `docs`, which an index of its own takes in batches (dealt out by hash)."""
    rows = materialize(digests(docs, id_col, text_col), "digests")
    index = DigestIndex(docs.sparkSession, buckets=buckets_for(rows))
    for i in range(batches):
        index.append(rows.where(F.pmod(F.xxhash64("id", "n_points"), F.lit(batches)) == i))
    out = index.resolve(rows)
    index.drop()
    discard(rows)
    return out
