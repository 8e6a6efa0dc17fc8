"""Rows in an order: neighbours, islands, gaps, continuations, groups with an anchor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.tables import written


def with_neighbours(df: DataFrame, key: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds left and right: the value before and after, around the ends."""
    w = Window.partitionBy(*key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("left", F.coalesce(F.lag(value).over(w), F.last(value).over(whole))).withColumn("right", F.coalesce(F.lead(value).over(w), F.first(value).over(whole)))


def with_offsets(df: DataFrame, key: Sequence[str], order: str, length: str) -> DataFrame:
    """Adds start and stop of slots of given lengths, one after the other."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("stop", F.sum(length).over(w)).withColumn("start", F.col("stop") - F.col(length))


def slot_at(points: DataFrame, slots: DataFrame, key: Sequence[str], at: str) -> DataFrame:
    """Each point with the slot that holds it (start <= at < stop), or the last slot beyond the end: slots
    and points are laid in one order per key, so this is a window, not a range join."""
    s = slots.select(*key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct(*slots.columns).alias("_slot"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("_point"))
    p = points.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(s.schema["_slot"].dataType).alias("_slot"), F.struct(*points.columns).alias("_point"))
    w = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = s.unionByName(p).withColumn("slot", F.last("_slot", ignorenulls=True).over(w)).where("_kind = 1")
    return rows.select("_point.*", "slot")


def islands(df: DataFrame, key: Sequence[str], order: str, same: Column) -> DataFrame:
    """Adds island: numbers runs; a new one begins where `same` (as the row before) doesn't hold."""
    w = Window.partitionBy(*key).orderBy(order)
    begins = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    return df.withColumn("_begins", begins).withColumn("island", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_begins")


def widest_gap(df: DataFrame, key: Sequence[str], start: str, stop: str) -> DataFrame:
    """Of each key the widest gap between its intervals, overlapping ones merged: gap_start, gap_stop, gap."""
    w = Window.partitionBy(*key).orderBy(start, stop)
    reached = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = df.withColumn("_reached", reached).where(F.col(start) > F.col("_reached"))
    gap = (F.col(start) - F.col("_reached")).alias("gap")
    best = gaps.groupBy(*key).agg(F.max(F.struct(gap, F.col("_reached").alias("gap_start"), F.col(start).alias("gap_stop"))).alias("_best"))
    return best.select(*key, "_best.gap_start", "_best.gap_stop", "_best.gap")


def longest_run(df: DataFrame, key: Sequence[str], order: str, flag: str, last_wins: bool = True) -> DataFrame:
    """Start, stop and length of the longest run of true flags; of equal ones the last or the first."""
    w = Window.partitionBy(*key).orderBy(order)
    numbered = df.withColumn("_place", F.row_number().over(w)).where(F.col(flag))
    numbered = numbered.withColumn("_run", F.col("_place") - F.row_number().over(w))
    runs = numbered.groupBy(*key, "_run").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.count(F.lit(1)).alias("length"))
    tie = F.col("start") if last_wins else -F.col("start")
    return runs.groupBy(*key).agg(F.max_by(F.struct("start", "stop", "length"), F.struct(F.col("length"), tie)).alias("_best")).select(*key, "_best.*")


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Adds the row's rank (from 0) among its key's, for keys that may hold any share of the rows: rows are range-partitioned by key and
    order and written, ranked within their partition, and moved on by the counts of the partitions before. No key is gathered in a task."""
    dealt = written(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = dealt.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row per key and partition that holds it
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_local", local).join(starts, [*key, "_part"]).withColumn(name, F.col("_local") + F.col("_start")).drop("_local", "_start", "_part")


def leading(df: DataFrame, key: Sequence[str], order: str, ok: Column) -> DataFrame:
    """The rows of each key before the first that isn't ok."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_ok", F.min(F.coalesce(ok, F.lit(False)).cast("int")).over(w)).where("_ok = 1").drop("_ok")


def continued(df: DataFrame, key: Sequence[str], order: str, text: str, goes_on: str, continues: str) -> DataFrame:
    """Lines glued to the one before if that ends as `goes_on` says or they begin as `continues` says:
    key, item, and the joined text."""
    w = Window.partitionBy(*key).orderBy(order)
    glued = F.lag(text).over(w).rlike(goes_on) | (F.lag(text).over(w).isNotNull() & F.col(text).rlike(continues))
    numbered = islands(df, key, order, glued)
    joined = numbered.groupBy(*key, F.col("island").alias("item")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_lines"))
    return joined.select(*key, "item", F.array_join(F.transform("_lines", lambda x: x["t"]), " ").alias("text"))


def anchored(df: DataFrame, key: Sequence[str], order: str, tolerance: float) -> DataFrame:
    """Adds anchor: the value that began the row's group. A row joins the group if it is within the tolerance of the
    group's first, not of its neighbour, so no window expresses it; groups are folded over a key's sorted values
    in one pass that streams a key in batches."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField("anchor", DoubleType())])
    names = df.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchor = None, 0.0
        for batch in batches:
            keys = list(zip(*(batch.column(names.index(k)).to_pylist() for k in key), strict=True))
            out = []
            for k, v in zip(keys, batch.column(names.index(order)).cast(pa.float64()).to_pylist(), strict=True):
                if k != at or v - anchor > tolerance:
                    at, anchor = k, v
                out.append(anchor)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*names, "anchor"])

    return df.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(fold, schema)
