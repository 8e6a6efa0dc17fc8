"""Galleries that settle: members that don't belong are moved out, and photos that were put aside wrongly are moved in, in rounds
that decide by what the rounds before left, until a round moves nothing.

Every round writes its decisions as a part of a move log under the round's number, and the state of a photo is what it was given plus
its last entry there. A round that was written isn't decided again, so a run that was killed goes on, and a second run moves nothing.

A photo has a gallery, a name, a place (exterior or interior), a number in that place, a vector, a colour and what the present
classifiers say of it: category (null if they failed), wheel (it would go to another pipeline) and cut_ok (a cut-out can be made)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators import gallery
from quarry.sources.tables import written
from quarry.sources.versions import Publication

#: Fewer cut-outs than this form no opinion.
FEWEST = 4
MOVE = ["gallery", "name", "outcome", "place", "number"]


def foreign_members(members: DataFrame, key: str, certain: float, doubtful: float, far: float, dim: int, fewest: int = FEWEST) -> DataFrame:
    """Members (key, name, vector, colour) that their gallery doesn't vouch for, with similarity, distance and reason. Members without a
    colour take no part. A gallery holds a vehicle's photos: a few dozen."""
    coloured = members.where(F.col("colour").isNotNull() & F.col("vector").isNotNull()).select(key, "name", "vector", "colour")
    alike = gallery.likeness(coloured, key, "vector", dim)
    told = gallery.foreign(gallery.colour_distance(alike, key, "colour", "name", hot=False), key, certain, doubtful, "distance", far, fewest).where("foreign")
    return told.select(key, "name", "similarity", "distance", F.when(F.col("similarity") < certain, "certain").otherwise("doubtful+colour").alias("reason"))


def demotions(photos: DataFrame, certain: float, doubtful: float, far: float, dim: int) -> DataFrame:
    """Moves of foreign cut-outs to the interior, numbered on after its last photo, the least alike first."""
    out = foreign_members(photos.where("place = 'exterior'"), "gallery", certain, doubtful, far, dim)
    last = photos.where("place = 'interior'").groupBy("gallery").agg(F.max("number").alias("last"))
    turn = F.row_number().over(Window.partitionBy("gallery").orderBy("similarity", "name"))  # foreign members alone: half a gallery at most
    numbered = out.join(last, "gallery", "left").withColumn("number", F.coalesce("last", F.lit(0)) + turn)
    return numbered.select("gallery", "name", F.lit("demoted").alias("outcome"), F.lit("interior").alias("place"), F.col("number").cast("long").alias("number"))


def promotions(photos: DataFrame, decided: DataFrame, certain: float, doubtful: float, far: float, dim: int) -> DataFrame:
    """The next decision of each gallery on an interior photo that the classifiers now call exterior. A photo joins only if a trial gallery with
    it, judged by the same rule, doesn't count it as foreign. Decisions depend on those before, so a gallery makes one a round."""
    inside = photos.where("place = 'interior' AND (category IS NULL OR category = 'exterior')").join(decided, ["gallery", "name"], "left_anti")
    first = inside.groupBy("gallery").agg(F.min_by(F.struct(*inside.columns), F.struct("number", "name")).alias("p")).select("p.*")
    out = photos.where("place = 'exterior'")
    held = out.groupBy("gallery").agg(F.count(F.lit(1)).alias("held"), F.max("number").alias("last"))
    asked = written(first.join(held, "gallery", "left").withColumn("held", F.coalesce("held", F.lit(0))), "asked")
    before_trial = F.when(F.col("category").isNull(), "classify_failed").when(F.col("wheel"), "wheel_eligible_skipped").when(~F.col("cut_ok"), "cutout_failed").when(F.col("held") + 1 < FEWEST, "insufficient_gallery")
    tried = asked.where(before_trial.isNull())
    members = out.join(tried.select("gallery"), "gallery", "left_semi").select("gallery", "name", "vector", "colour").unionByName(tried.select("gallery", "name", "vector", "colour"))
    refused = foreign_members(members, "gallery", certain, doubtful, far, dim).select("gallery", "name", F.lit("rejected_by_gallery").alias("refused"))
    told = asked.join(refused, ["gallery", "name"], "left").withColumn("outcome", F.coalesce(before_trial, "refused", F.lit("promoted")))
    joins = F.col("outcome") == "promoted"
    return told.select("gallery", "name", "outcome", F.when(joins, "exterior").otherwise("interior").alias("place"), F.when(joins, F.coalesce("last", F.lit(0)) + 1).otherwise(F.col("number")).cast("long").alias("number"))


def as_moved(photos: DataFrame, log: DataFrame | None) -> DataFrame:
    """Photos where the log's last entry puts them."""
    if log is None:
        return photos
    last = log.groupBy("gallery", "name").agg(F.max_by(F.struct(F.col("place").alias("p"), F.col("number").alias("n")), "round").alias("now"))
    return photos.join(last, ["gallery", "name"], "left").withColumn("place", F.coalesce("now.p", "place")).withColumn("number", F.coalesce("now.n", "number")).drop("now")


def settle(photos: DataFrame, folder: str, certain: float = 0.58, doubtful: float = 0.75, far: float = 110.0, dim: int = 64, most_rounds: int = 200) -> DataFrame:
    """The move log (round, gallery, name, outcome, place, number) after rounds of demotion until none is left, then of re-sweeping until
    every interior photo is decided. A photo that was demoted here isn't asked again; a promoted one is a member like the others."""
    spark, log = photos.sparkSession, Publication(photos.sparkSession, folder)
    schema = "round long, gallery " + photos.schema["gallery"].dataType.simpleString() + ", name " + photos.schema["name"].dataType.simpleString() + ", outcome string, place string, number long"
    for phase in ("demote", "sweep"):
        for _ in range(most_rounds):
            moves = log.read()
            now = as_moved(photos, moves)
            if phase == "demote":
                if moves is not None and not moves.where("outcome <> 'demoted'").isEmpty():
                    break  # sweeping has begun
                new = demotions(now, certain, doubtful, far, dim)
            else:
                new = promotions(now, (moves if moves is not None else spark.createDataFrame([], schema)).select("gallery", "name").distinct(), certain, doubtful, far, dim)
            number = 0 if (last := log.commits.last()) is None else last[0] + 1
            new = new.withColumn("round", F.lit(number).cast("long")).select("round", *MOVE)
            rows = new if moves is None else moves.unionByName(new)
            staged = log.stage(rows)
            if spark.read.schema(rows.schema).parquet(f"{folder}/{staged}").where(F.col("round") == number).isEmpty():
                log.commits.files.delete(staged)
                break
            log.swap(staged, rows.schema, f"round {number:06d}")
        else:
            raise RuntimeError("the galleries haven't settled")
    return log.read() if log.commits.last() else spark.createDataFrame([], schema)
