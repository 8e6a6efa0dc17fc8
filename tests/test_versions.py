"""Publications, bucketed merges and the photo cache: readers see old or new, order and repetition don't matter."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.operators.keyed import latest
from quarry.plans.photo_cache import ENTRY, PhotoCache, reusable, winners
from quarry.sources.tables import shared_folder
from quarry.sources.versions import BucketTable, Publication, stale_files
from quarry.streaming.incremental import LatestState


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_a_publication_is_old_or_new(spark):
    feed = Publication(spark, shared_folder(spark, "feed"))
    assert feed.read() is None
    feed.publish(spark.range(3), "2024-01-01T00:00:00")
    staged = feed.stage(spark.range(5))  # killed here: nobody sees it
    assert ids(feed.read()) == [0, 1, 2]
    held = feed.read()
    feed.swap(staged, spark.range(5).schema, "2024-02-01T00:00:00")
    assert ids(feed.read()) == [0, 1, 2, 3, 4] and ids(held) == [0, 1, 2] and ids(feed.read(0)) == [0, 1, 2]


def test_publications_expire_by_age(spark):
    log = Publication(spark, shared_folder(spark, "log"))
    for day in ("2024-01-01", "2024-01-20", "2024-02-10"):
        log.publish(spark.range(1).withColumn("day", F.lit(day)), day)
    log.stage(spark.range(9))
    assert log.expire("2024-01-11") == [0] and log.commits.numbers() == [1, 2]
    assert len(log.commits.files.names("data/*")) == 2
    assert log.expire("2025-01-01") == [1] and log.read().first()["day"] == "2024-02-10"


def state_of(table):
    return {r.k: r.v for r in table.read().collect()}


def test_a_merge_rewrites_touched_buckets_alone(spark):
    folder = shared_folder(spark, "table")
    table = BucketTable(spark, folder, ["k"], 8)
    pick = lambda rows: latest(rows, ["k"], ["v"])
    rows = lambda *kv: spark.createDataFrame(kv, "k long, v long")
    assert len(table.merge(rows(*((k, k) for k in range(100))), pick, 0)) == 8
    before = table.commits.last()[1]["at"]
    assert len(touched := table.merge(rows((5, 50), (6, 1)), pick, 1)) in (1, 2)
    after = table.commits.last()[1]["at"]
    assert {int(b) for b in after if after[b] != before[b]} == set(touched)
    assert state_of(table) == {k: 50 if k == 5 else k for k in range(100)}
    assert table.merge(rows((5, 99)), pick, 1) == [] and state_of(table)[5] == 50  # that batch ran before
    for n in range(2, 6):
        table.merge(rows((5, 50 + n)), pick, n)
    assert len(table.commits.numbers()) == 2  # old versions go
    kept = [f for _, _, names in os.walk(folder.removeprefix("file:")) for f in names if f.endswith(".parquet")]
    assert len(kept) <= 10
    table.grow(3, 6)
    assert state_of(BucketTable(spark, folder, ["k"], 99)) == {k: 55 if k == 5 else k for k in range(100)} and BucketTable(spark, folder, ["k"]).buckets == 3


def test_a_merge_killed_before_its_commit_is_repeated(spark):
    table = BucketTable(spark, shared_folder(spark, "table"), ["k"], 4)
    pick = lambda rows: latest(rows, ["k"], ["v"])
    table.merge(spark.range(10).select(F.col("id").alias("k"), F.lit(0).alias("v")), pick, 0)
    batch = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    put, table.commits.put = table.commits.put, lambda *_: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        table.merge(batch, pick, 1)
    assert set(state_of(table).values()) == {0}
    table.commits.put = put
    table.merge(batch, pick, 1)
    assert set(state_of(table).values()) == {1}


def test_latest_state_of_an_empty_batch(spark):
    state = LatestState(spark, shared_folder(spark, "latest"), ["k"], ["v"], 4)
    assert state.read() is None
    state.apply(spark.createDataFrame([(1, 1)], "k long, v long"), 0)
    state.apply(spark.createDataFrame([], "k long, v long"), 1)
    assert state.read().count() == 1


RECORDS = [(1, "a", "1.jpg", "exterior", None, 1), (1, "b", "2.jpg", "exterior", "cut-b", 2), (1, "c", "3.jpg", "interior", "cut-c", 3), (2, "a", "4.jpg", "interior", None, 4), (2, "b", "5.jpg", "exterior", None, 5), (None, "b", "6.jpg", "x", "y", 6)]


def test_the_photo_cache_by_any_order_of_batches(spark):
    shape = "phash long, gallery string, file string, category string, cutout string, position long"
    assert ENTRY == [c.split()[0] for c in shape.split(", ")]
    seen = set()
    for order in (RECORDS, RECORDS[::-1], RECORDS[2:] + RECORDS[:2] + RECORDS[:3]):
        cache = PhotoCache(spark, shared_folder(spark, "photos"), 4)
        for number, record in enumerate(order):
            cache.record(spark.createDataFrame([record], shape), number)
        seen.add(tuple(sorted((r.phash, r.gallery, r.file, r.cutout) for r in cache.read().collect())))
    assert seen == {((1, "b", "2.jpg", "cut-b"), (2, "a", "4.jpg", None))}


def test_a_photo_is_reused_from_another_gallery_that_still_has_it(spark):
    shape = "phash long, gallery string, file string, category string, cutout string, position long"
    cache = winners(spark.createDataFrame(RECORDS, shape))
    pixels = spark.createDataFrame([("b", "2.jpg", [10.0, 10.0]), ("d", "7.jpg", [10.5, 10.0]), ("d", "8.jpg", [90.0, 10.0]), ("d", "9.jpg", [10.0]), ("b", "9.jpg", [10.0, 10.0])], "gallery string, file string, pixels array<double>")
    photos = pixels.withColumn("phash", F.when(F.col("file") == "4.jpg", 2).otherwise(1).cast("long"))
    got = [(r.gallery, r.file, r.from_gallery, r.from_file, r.cutout) for r in reusable(photos, cache, pixels, 1.0).collect()]
    assert got == [("d", "7.jpg", "b", "2.jpg", "cut-b")]


def test_stale_numbered_files_go(spark):
    existing = spark.createDataFrame([("g", "01.jpg"), ("g", "02.jpg"), ("g", "angles.json"), ("g", "note.txt"), ("g", "a1.jpg"), ("h", "01.jpg")], "gallery string, file string")
    wanted = spark.createDataFrame([("g", "01.jpg")], "gallery string, file string")
    assert sorted(tuple(r) for r in stale_files(existing, wanted, "gallery", "file").collect()) == [("g", "02.jpg"), ("g", "angles.json")]
