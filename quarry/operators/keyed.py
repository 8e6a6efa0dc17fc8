"""First, best and most frequent rows of a key, and joins that look things up.

Each is one shuffle by key with partial aggregation where the result is an aggregate; ties have an order
that the caller names, never the order of arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, whole."""
    row = F.struct(*order, *(c for c in df.columns if c not in order))
    return df.groupBy(*key).agg(F.min(row).alias("_row")).select(*(F.col(f"_row.{c}").alias(c) for c in df.columns))


def best_of(df: DataFrame, key: Sequence[str], score: str, position: str, keep: Sequence[str]) -> DataFrame:
    """`keep` of the row with the largest score of each key; of equal ones the first by position."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*keep), F.struct(F.col(score), -F.col(position))).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in keep))


def mode_first_seen(df: DataFrame, key: Sequence[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones that seen first."""
    counts = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_at"))
    return counts.groupBy(*key).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_at"))).alias(value), F.max("_n").alias("n"))


def allocate_greedily(df: DataFrame, group: Sequence[str], target: str, order: Sequence[Column]) -> DataFrame:
    """Each target once in its group, to the first row in the given order."""
    best = Window.partitionBy(*group, target).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def delisted(known: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Known rows that are no longer live."""
    return known.join(live.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")


def guarded(df: DataFrame, missing: Column, bucket: Sequence[str], most: float = 0.3, complete: Column | None = None) -> DataFrame:
    """Adds missing_n, active_n, refused and flagged: nothing is flagged where more than `most` of the active
    rows would be, or where the crawl is partial. Counts are aggregated before they are joined."""
    counts = df.groupBy(*bucket).agg(F.count_if(missing).alias("missing_n"), F.count(F.lit(1)).alias("active_n"))
    out = df.join(counts, list(bucket)) if bucket else df.crossJoin(F.broadcast(counts))  # one row
    refused = F.col("missing_n") / F.col("active_n") > most
    if complete is not None:
        refused = refused | ~complete
    return out.withColumn("refused", refused).withColumn("flagged", missing & ~F.col("refused"))


def guarded_whole(records: DataFrame, live: DataFrame, key: str, stamp: str = "delisted_at", most: float = 0.3, confirmed: bool = False) -> DataFrame:
    """`guarded` over all records that have a key, without buckets: missing are those whose key isn't live, and rows that carry a
    stamp already count among them. Flagged are the missing ones without a stamp, unless refused; `confirmed` overrules that."""
    seen = live.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_live", F.lit(True))
    keyed = records.where(F.col(key).isNotNull()).join(seen, key, "left")
    out = guarded(keyed, F.col("_live").isNull(), [], 1.0 if confirmed else most)
    return out.withColumn("flagged", F.col("flagged") & F.col(stamp).isNull()).drop("_live")


def known_or_new(live: DataFrame, manifest: DataFrame, key: str, valid: Column) -> DataFrame:
    """Live rows with `known`: in the manifest with an entry that holds."""
    held = manifest.where(valid).select(key).distinct().withColumn("known", F.lit(True))
    return live.join(held, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def latest(events: DataFrame, key: Sequence[str], order: Sequence[str | Column], last: bool = True) -> DataFrame:
    """The last (or first) row of each key."""
    rest = [c for c in events.columns if c not in key]
    by = F.max_by if last else F.min_by
    return events.groupBy(*key).agg(by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def upsert(table: DataFrame, changes: DataFrame, key: str, kept: Sequence[str] = ()) -> DataFrame:
    """The table with changed rows replaced and new ones added; columns in `kept` keep an existing value."""
    new = changes.select(key, F.struct(*changes.columns).alias("_new"))
    old = table.select(key, F.struct(*table.columns).alias("_old"))
    value = lambda c: F.coalesce(f"_old.{c}", f"_new.{c}") if c in kept else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return old.join(new, key, "full").select(key, *(value(c).alias(c) for c in table.columns if c != key))


def hamming_pairs(left: DataFrame, right: DataFrame, bits: int, most: int) -> DataFrame:
    """left_id, right_id, distance for hashes (columns id, hash) that differ in at most `most` bits.

    Hashes that differ in so few bits agree in at least one of most + 1 segments, so this is an
    equi-join by segment; a pair counts in the first segment where it agrees, so no distinct is needed."""
    cuts = [round(i * bits / (most + 1)) for i in range(most + 2)]
    segments = list(zip(cuts, cuts[1:], strict=False))

    def cut(hash_: Column, a: int, b: int) -> Column:
        return F.shiftright(hash_, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))

    def pieces(df: DataFrame, side: str) -> DataFrame:
        parts = F.array(*(cut(F.col("hash"), a, b) for a, b in segments))
        return df.select(F.col("id").alias(f"{side}_id"), F.col("hash").alias(f"{side}_hash"), F.posexplode(parts).alias("segment", "piece"))

    joined = pieces(left, "left").join(pieces(right, "right"), ["segment", "piece"])
    differ = F.col("left_hash").bitwiseXOR(F.col("right_hash"))
    agree = F.array(*(cut(differ, a, b) == 0 for a, b in segments))
    first = F.array_position(agree, True) - 1 == F.col("segment")
    return joined.where(first).withColumn("distance", F.bit_count(differ)).where(F.col("distance") <= most).select("left_id", "right_id", "distance")
