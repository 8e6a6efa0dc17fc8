"""The photo cache: which gallery's photo stands for a hash, and photos that may take over its label and cut-out.

An entry with a cut-out replaces one without; otherwise the first recorded stays. As "first" goes by a recorded position
and not by arrival, the rule is a minimum, so batches may come in any order, twice or in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import numbers
from quarry.operators import keyed
from quarry.sources.tables import shared_folder, table
from quarry.sources.versions import BucketTable

ENTRY = ["phash", "gallery", "file", "category", "cutout", "position"]


def winners(entries: DataFrame) -> DataFrame:
    """The entry that each hash keeps; a cut-out is stored under the hash once."""
    order = F.struct(F.col("cutout").isNull().alias("bare"), F.col("position").alias("position"), F.col("gallery").alias("gallery"), F.col("file").alias("file"))
    return keyed.latest(entries.where("phash IS NOT NULL").select(*ENTRY), ["phash"], [order], last=False)


class PhotoCache:
    """A hash-bucketed table of entries."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        self.table = BucketTable(spark, folder, ["phash"], buckets)

    def record(self, photos: DataFrame, number: int) -> list[int]:
        """Merges a batch (ENTRY columns); the buckets rewritten."""
        return self.table.merge(photos.where("phash IS NOT NULL").select(*ENTRY), winners, number)

    def read(self) -> DataFrame | None:
        return self.table.read()


def mean_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pictures' pixels; infinite if their sizes differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total / F.size(a)).otherwise(F.lit(float("inf")))


def reusable(photos: DataFrame, cache: DataFrame, pixels: DataFrame, most: float) -> DataFrame:
    """Photos (phash, gallery, file, pixels) with an entry of the same hash in another gallery whose own photo is still there
    (pixels: gallery, file, pixels) and no further away than `most`: phash, gallery, file, and the entry's from_gallery, from_file, category, cutout."""
    entry = cache.select("phash", F.col("gallery").alias("from_gallery"), F.col("file").alias("from_file"), "category", "cutout")
    source = pixels.select(F.col("gallery").alias("from_gallery"), F.col("file").alias("from_file"), F.col("pixels").alias("from_pixels"))
    held = entry.join(source, ["from_gallery", "from_file"])  # one row per hash
    met = photos.join(held, "phash").where(F.col("gallery") != F.col("from_gallery"))
    return met.where(mean_difference(F.col("pixels"), F.col("from_pixels")) <= most).drop("pixels", "from_pixels")


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Events as photos: their value decides whether a cut-out was made."""
    cut = F.when(F.col("value") >= 60, F.concat(F.lit("cut-"), F.col("event_id")))
    return table(spark, d, "events").select(
        (F.col("event_id") * 7919 % 1009).alias("phash"), F.col("user_id").alias("gallery"), F.concat("event_id", F.lit(".jpg")).alias("file"), F.col("event_type").alias("category"), cut.alias("cutout"), F.col("event_id").alias("position")
    )


def q_photo_cache(spark: SparkSession, d: str) -> DataFrame:
    """All events recorded in three batches, the last first."""
    cache, entries = PhotoCache(spark, shared_folder(spark, "photos")), _entries(spark, d)
    for number, part in enumerate((2, 0, 1)):
        cache.record(entries.where(F.col("position") % 3 == part), number)
    return cache.read()


def q_photo_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as photos: those that may reuse the entry of their hash."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")
    photos = e.select(numbers.sign_bits(F.col("embedding"), 5).alias("phash"), F.col("label").alias("gallery"), F.col("vec_id").cast("string").alias("file"), F.col("embedding").alias("pixels"))
    cut = F.when(F.col("vec_id") % 4 == 0, F.col("vec_id").cast("string"))
    entries = photos.join(e.select(F.col("vec_id").cast("string").alias("file"), F.col("vec_id").alias("position"), cut.alias("cutout")), "file").withColumn("category", F.lit("exterior"))
    return reusable(photos, winners(entries), photos, 0.11).select("phash", "gallery", "file", "from_gallery", "from_file", "cutout")


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLES = {
    "photo_cache": """WITH e AS (SELECT event_id * 7919 % 1009 AS phash, user_id AS gallery, event_id || '.jpg' AS file, event_type AS category, CASE WHEN value >= 60 THEN 'cut-' || event_id END AS cutout, event_id AS position FROM events)
        SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY phash ORDER BY cutout IS NULL, position) = 1""",
    "photo_reuse": """WITH p AS (SELECT vec_id, label, embedding AS x, list_reduce(list_transform(embedding[1:5], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, b: a * 2 + b) AS phash FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
        w AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY phash ORDER BY vec_id % 4 <> 0, vec_id) = 1)
        SELECT p.phash, p.label AS gallery, p.vec_id::VARCHAR AS file, w.label AS from_gallery, w.vec_id::VARCHAR AS from_file, CASE WHEN w.vec_id % 4 = 0 THEN w.vec_id::VARCHAR END AS cutout FROM p JOIN w USING (phash)
        WHERE p.label <> w.label AND list_sum(list_transform(list_zip(p.x, w.x), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) / len(p.x) <= 0.11""",
}
