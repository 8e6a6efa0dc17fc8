"""Matching: patterns by priority against lists, and greedy assignment of two sides to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import written


def first_confirmed(texts: Column, keywords: Column) -> Column:
    """The first text (in order) that contains the first keyword (in order) that any of them contains, in any case; null if none does."""
    hit = lambda k: F.get(F.filter(texts, lambda t: F.contains(F.lower(t), k)), F.lit(0))
    return F.get(F.filter(F.transform(keywords, hit), lambda t: t.isNotNull()), F.lit(0))


def match_greedily(pairs: DataFrame, left: Sequence[str], right: Sequence[str], order: Sequence[Column], most_rounds: int = 1000) -> DataFrame:
    """The pairs that one pass over all of them in the given (total) order would take, if a pair is taken when both of its sides are
    still free.

    A pair that is the first of its left side and the first of its right side is taken by that pass whatever else happens, so all such pairs are taken
    at once; pairs that touch them go, and the rest is looked at again. Each round at least takes the first pair of all that are left, and usually a share of them.
    Per round: two aggregates with partial aggregation and joins by side; no side is gathered."""
    sides = [*left, *right]
    rows = written(pairs.where(" AND ".join(f"`{c}` IS NOT NULL" for c in sides)).withColumn("_order", F.struct(*order, *sides)), "pairs")
    taken = None
    for _ in range(most_rounds):
        firsts = [rows.groupBy(*side).agg(F.min("_order").alias(f"_{i}")) for i, side in enumerate((left, right))]
        both = rows.join(firsts[0], list(left)).join(firsts[1], list(right)).where("_order = _0 AND _order = _1").drop("_0", "_1").dropDuplicates(sides)
        new = written(both, "taken")
        if new.isEmpty():
            break
        taken = new if taken is None else taken.unionByName(new)
        rows = written(rows.join(new.select(*left), list(left), "left_anti").join(new.select(*right), list(right), "left_anti"), "pairs")
    else:
        raise RuntimeError("the matching hasn't ended")
    return (rows.limit(0) if taken is None else taken).select(*pairs.columns)
