"""Vectors in galleries: likeness to the others, foreign members, labels by prototype, near-duplicates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.numbers import cosine, dot, norm
from quarry.operators import sequences


def _sums(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Component sums of a gallery; one partial row per task and gallery is shuffled."""
    sums = [F.sum(F.get(vector, F.lit(i)).cast("double")).alias(f"s{i}") for i in range(dim)]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("members"), *sums).select(key, "members", F.array(*(F.col(f"s{i}") for i in range(dim))).alias("total"))


def likeness(df: DataFrame, key: str, vector: str, dim: int = 64) -> DataFrame:
    """Adds members and similarity: cosine to the mean of the gallery's other members (null if alone)."""
    joined = df.join(_sums(df, key, vector, dim), key)
    others = F.zip_with("total", vector, lambda t, x: (t - x.cast("double")) / (F.col("members") - 1))
    return joined.withColumn("similarity", F.when(F.col("members") > 1, cosine(others, F.col(vector)))).drop("total")


def foreign(df: DataFrame, key: str, certain: float, doubtful: float, distance: str | None = None, far: float = 110.0, fewest: int = 4, most: float = 0.5) -> DataFrame:
    """Adds foreign to rows with similarity: under `certain`, or under `doubtful` and far in colour. A gallery of
    few members, or with more than `most` of them flagged, abstains."""
    flag = F.col("similarity") < certain
    if distance:
        flag = flag | ((F.col("similarity") < doubtful) & (F.col(distance) > far))
    flagged = df.withColumn("_flag", F.coalesce(flag, F.lit(False)) & (F.col("members") >= fewest))
    share = flagged.groupBy(key).agg(F.avg(F.col("_flag").cast("double")).alias("_share"))
    return flagged.join(share, key).withColumn("foreign", F.col("_flag") & (F.col("_share") <= most)).drop("_flag", "_share")


def colour_distance(df: DataFrame, key: str, colour: str, name: str, channels: int = 3, hot: bool = True) -> DataFrame:
    """Adds distance: of a member's colour to the median colour of the gallery's other members (null without a colour, or if alone).
    hot: a gallery may hold any share of the rows, so ranks come from a distributed sort; else galleries are small, and a window ranks them.

    Without the member of rank r, the sorted values of a channel are those of all n members with r left out, so the medians of
    all n galleries-less-one are among the three values around the middle: they are read off by rank, once per gallery and channel."""
    flat = df.where(F.col(colour).isNotNull()).select(key, name, F.posexplode(F.transform(colour, lambda c: c.cast("double"))).alias("channel", "value"))
    if hot:
        ranks = sequences.ranked(flat, [key, "channel"], ["value", name])
    else:
        ranks = flat.withColumn("rank", F.row_number().over(Window.partitionBy(key, "channel").orderBy("value", name)) - 1)
    sizes = ranks.groupBy(key, "channel").agg(F.count(F.lit(1)).alias("n"))
    # Of the n - 1 others the middle ones are at places (n - 2) div 2 and (n - 1) div 2; leaving out a rank up to a place moves it on by one.
    low, high = F.floor((F.col("n") - 2) / 2), F.floor((F.col("n") - 1) / 2)
    spread = ranks.join(sizes, [key, "channel"])
    middle = spread.where(F.col("rank").between(low, high + 1)).groupBy(key, "channel").agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("around"))  # three at most
    at = lambda place: F.get(F.col("around"), (place + F.when(F.col("rank") <= place, 1).otherwise(0) - low).cast("int"))["value"]
    gap = F.when(F.col("n") > 1, F.col("value") - (at(low) + at(high)) / 2)
    apart = spread.join(middle, [key, "channel"]).groupBy(key, name).agg(F.when(F.count(gap) == channels, F.sqrt(F.sum(gap * gap))).alias("distance"))
    return df.join(apart, [key, name], "left")


def label_by_prototype(df: DataFrame, vector: str, prototypes: DataFrame, keep: Sequence[str], scale: float = 100.0) -> DataFrame:
    """keep, best label and its softmax share. prototypes (label, prototype): a label set, a few dozen rows at
    most by definition, which is checked before it goes to all tasks."""
    rows = sorted(prototypes.limit(1001).collect(), key=lambda r: str(r[0]))
    if len(rows) > 1000:
        raise ValueError("a label set has at most 1000 labels")
    spark = df.sparkSession
    labels = spark.createDataFrame([(rows,)], f"labels array<struct<label:{prototypes.dtypes[0][1]},prototype:{prototypes.dtypes[1][1]}>>") if rows else None
    if labels is None:
        raise ValueError("a label set has at least one label")
    with_labels = df.crossJoin(F.broadcast(labels))  # one row
    unit = norm(F.col(vector))
    with_scores = with_labels.withColumn("_scores", F.transform("labels", lambda p: F.struct((scale * dot(p["prototype"], F.col(vector)) / (norm(p["prototype"]) * unit)).alias("score"), p["label"].alias("label"))))
    top = F.array_max(F.transform("_scores", lambda s: s["score"]))
    best = F.filter("_scores", lambda s: s["score"] == top)[0]["label"]
    share = 1 / F.aggregate(F.transform("_scores", lambda s: F.exp(s["score"] - top)), F.lit(0.0), lambda a, x: a + x)
    return with_scores.select(*keep, best.alias("best"), share.alias("confidence"))


def keep_distinct(df: DataFrame, key: str, order: str, vector: str, most: float = 0.9995) -> DataFrame:
    """Rows in order that are no nearer than `most` to an earlier kept row of their gallery (a vehicle's photos:
    a few dozen). Order decides what is kept, so a gallery is gone through in one place; kept vectors are all
    that is held of it."""
    import numpy as np

    schema = df.schema

    def run(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, kept = None, []
        for part in groups:
            go = []
            for k, v in zip(part[key], part[vector], strict=True):
                if k != at:
                    at, kept = k, []
                v = np.asarray(v, float)
                v = v / max(np.linalg.norm(v), 1e-12)
                near = bool(kept) and float(np.max(np.stack(kept) @ v)) > most
                go.append(not near)
                if not near:
                    kept.append(v)
            yield part[pd.Series(go, index=part.index)] if len(part) else part

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)
