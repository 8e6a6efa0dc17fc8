"""Lookups with a rule for which of several answers counts: the nearest folder above, a name or an unambiguous tag, a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ancestors(path: Column, levels: int) -> Column:
    """A path and the folders above it, nearest first, `levels` of them at most; the root is written `/`."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    upto = F.sequence(F.size(parts), F.lit(0), F.lit(-1))
    return F.slice(F.transform(upto, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/"))), 1, levels)


def nearest_above(paths: DataFrame, marks: DataFrame, path: str, value: str, levels: int = 6) -> DataFrame:
    """Adds value: of the nearest mark (path, value) at a path or above it within `levels` levels, and found. A mark whose value is null
    ends the search with null, as a record that can't be read does. Of marks with the same path the smallest value counts."""
    held = marks.where(F.col(path).isNotNull()).groupBy(F.element_at(ancestors(F.col(path), 1), 1).alias("_at")).agg(F.min(value).alias("_value"))
    steps = paths.select(path).distinct().select(path, F.posexplode(ancestors(F.col(path), levels)).alias("_level", "_at"))
    nearest = steps.join(held, "_at").groupBy(path).agg(F.min_by(F.struct("_value"), "_level").alias("_hit"))
    joined = paths.join(nearest, path, "left")
    return joined.withColumn(value, F.col("_hit._value")).withColumn("found", F.col("_hit").isNotNull()).drop("_hit")


def resolve(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """Adds file, entry (the whole asset) and error to requests (category, value, default_name).

    A value is a name (in any case) if exactly one asset of the category has it, else a tag if exactly one has that; with neither, or with several,
    there is an error. Without a value the default's name counts, else the category's first asset. assets: category, name, tags, file, position."""
    asset = F.struct(*(F.col(c) for c in ("position", "category", "name", "tags", "file")))
    named = assets.groupBy("category", F.lower("name").alias("_key")).agg(F.count(F.lit(1)).alias("_names"), F.min(asset).alias("_named"))
    tagged = assets.select("category", F.explode(F.array_distinct("tags")).alias("_tag"), asset.alias("_asset")).groupBy("category", "_tag").agg(F.count(F.lit(1)).alias("_tags"), F.min("_asset").alias("_tagged"))
    first = assets.groupBy("category").agg(F.min(asset).alias("_first"))
    defaults = named.select("category", F.col("_key").alias("_default"), F.col("_named").alias("_by_default"))
    asked = requests.withColumn("_key", F.lower("value")).withColumn("_tag", F.col("value")).withColumn("_default", F.lower("default_name"))
    asked = asked.join(first, "category", "left").join(named, ["category", "_key"], "left").join(tagged, ["category", "_tag"], "left").join(defaults, ["category", "_default"], "left")
    by_value = F.when(F.col("_names") == 1, F.col("_named")).when(F.col("_tags") == 1, F.col("_tagged"))
    entry = F.when(F.col("value").isNotNull(), by_value).otherwise(F.coalesce("_by_default", "_first"))
    none = F.col("_names").isNull() & F.col("_tags").isNull()
    error = F.when(F.col("_first").isNull(), "empty").when(F.col("value").isNotNull() & by_value.isNull(), F.when(none, "no match").otherwise("ambiguous"))
    return asked.select(*requests.columns, entry["file"].alias("file"), entry.alias("entry"), error.alias("error"))
