import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import gallery, keyed, sequences
from quarry.sources import tables
from quarry.streaming.incremental import LatestState


def test_hamming_pairs_are_all_pairs(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(40) for _ in range(20)]
    hashes = base + [b ^ sum(1 << i for i in rng.sample(range(40), rng.randint(0, 6))) for b in base]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    got = {tuple(r) for r in keyed.hamming_pairs(df, df, 40, 4).collect()}
    said = {(i, j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.product(enumerate(hashes), repeat=2) if (a ^ b).bit_count() <= 4}
    assert got == said and len(keyed.hamming_pairs(df, df, 40, 4).collect()) == len(said)


def test_guard_refuses_mass_delisting(spark):
    df = spark.createDataFrame([("a", i < 3, i) for i in range(10)] + [("b", i < 4, i) for i in range(10)], "bucket string, missing boolean, i int")
    got = {r.bucket: (r.refused, r.flagged) for r in keyed.guarded(df, F.col("missing"), ["bucket"]).groupBy("bucket").agg(F.bool_or("refused").alias("refused"), F.count_if("flagged").alias("flagged")).collect()}
    assert got == {"a": (False, 3), "b": (True, 0)}
    assert keyed.guarded(df, F.col("missing"), ["bucket"], complete=F.lit(False)).where("flagged").count() == 0


def test_first_best_and_mode_break_ties_by_position(spark):
    df = spark.createDataFrame([("k", 2, "b", 1.0), ("k", 1, "a", 1.0), ("k", 3, "b", 0.5), ("k", 4, "a", 0.5)], "key string, pos int, v string, score double")
    assert keyed.best_of(df, ["key"], "score", "pos", ["v"]).collect()[0].v == "a"
    assert keyed.mode_first_seen(df, ["key"], "v", "pos").collect()[0].v == "a"
    assert keyed.first_seen(df, ["key"], ["pos"]).collect()[0].pos == 1


def test_upsert_keeps_what_must_stay(spark):
    old = spark.createDataFrame([(1, "done", "x"), (2, "new", "y")], "id int, status string, data string")
    new = spark.createDataFrame([(2, "reset", "z"), (3, "new", "w")], "id int, status string, data string")
    assert sorted(map(tuple, keyed.upsert(old, new, "id", kept=["status"]).collect())) == [(1, "done", "x"), (2, "new", "z"), (3, "new", "w")]


def test_anchor_groups_measure_from_their_first(spark):
    df = spark.createDataFrame([("a", float(y)) for y in (0, 4, 8, 9, 20)] + [("b", 5.0)], "k string, y double")
    got = sorted(map(tuple, sequences.anchored(df, ["k"], "y", 5.0).collect()))
    assert got == [("a", 0.0, 0.0), ("a", 4.0, 0.0), ("a", 8.0, 8.0), ("a", 9.0, 8.0), ("a", 20.0, 20.0), ("b", 5.0, 5.0)]


def test_kept_photos_differ_from_every_kept_one(spark):
    df = spark.createDataFrame([("g", 0, [1.0, 0.0]), ("g", 1, [1.0, 0.001]), ("g", 2, [0.0, 1.0]), ("h", 3, [1.0, 0.0]), ("h", 4, [0.0, 0.0])], "g string, i int, v array<double>")
    assert sorted(r.i for r in gallery.keep_distinct(df, "g", "i", "v").collect()) == [0, 2, 3, 4]


def test_small_galleries_abstain(spark):
    df = spark.createDataFrame([("s", i, [1.0, float(i)], 10) for i in range(3)], "g string, i int, v array<double>, n int")
    rows = gallery.foreign(gallery.likeness(df, "g", "v", 2), "g", certain=2.0, doubtful=2.0).collect()
    assert not any(r.foreign for r in rows)


def test_stream_state_is_applied_once(spark, tmp_path):
    state = LatestState(spark, str(tmp_path / "s"), ["k"], ["t"])
    one = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "k string, t int, v string")
    two = spark.createDataFrame([("a", 2, "y"), ("b", 0, "old")], "k string, t int, v string")
    for i, batch in enumerate([one, two]):
        state.apply(batch, i)
    state.apply(one, 1)  # comes again after a restart
    assert sorted(map(tuple, state.read().collect())) == [("a", 2, "y"), ("b", 1, "x")]


def test_sources_and_sinks(spark, tmp_path):
    for name, body in {"a": '{"vin": "1", "odd": 2}', "b": '{"vehicle": {"vin": "2"}}', "c": "{broken"}.items():
        (tmp_path / "r" / name).mkdir(parents=True)
        (tmp_path / "r" / name / "details.json").write_text(body)
    rows = {r.path.split("/")[-2]: r for r in tables.read_records(spark, str(tmp_path / "r"), ["vin"]).select("path", F.try_variant_get("record", "$.vin", "string").alias("vin"), "unknown").collect()}
    assert (rows["a"].vin, rows["a"].unknown, rows["b"].vin, rows["c"].vin) == ("1", ["odd"], "2", None)
    assert tables.read_manifest(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "urls").write_text("# x\n\n http://a \nhttp://b\n")
    assert sorted(r.url for r in tables.read_url_list(spark, str(tmp_path / "urls")).collect()) == ["http://a", "http://b"]
    tables.write_feed(spark.createDataFrame([(1, None)], "id int, title string").withColumn("image[0].url", F.lit("u")).coalesce(1), str(tmp_path / "feed"), ["id", "title", "image[0].url"], "\t")
    text = "".join(p.read_text() for p in (tmp_path / "feed").glob("part-*"))
    assert text == "id\ttitle\timage[0].url\n1\t\tu\n"


def test_whole_guard_counts_stamped_rows_and_skips_rows_without_a_key(spark):
    records = spark.createDataFrame([(f"k{i}", "old" if i == 0 else None) for i in range(10)] + [(None, None)], "vin string, delisted_at string")
    live = lambda n: spark.createDataFrame([(f"k{i}",) for i in range(n, 10)] + [("k9",), (None,)], "vin string")
    got = keyed.guarded_whole(records, live(3), "vin").collect()
    assert len(got) == 10 and {r.vin for r in got if r.flagged} == {"k1", "k2"} and (got[0].missing_n, got[0].active_n) == (3, 10)
    assert not any(r.flagged for r in keyed.guarded_whole(records, live(4), "vin").collect())
    assert sum(r.flagged for r in keyed.guarded_whole(records, live(4), "vin", confirmed=True).collect()) == 3
    assert keyed.guarded_whole(records.limit(0), live(3), "vin").collect() == []
