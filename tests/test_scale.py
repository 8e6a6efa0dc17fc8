"""Work is dealt out whatever the files are, and shuffled once where once is enough."""

import os

import pytest

from quarry.plans import normalize, shots, sticker_blocks, vehicle_posts
from quarry.sources.tables import spread
from tests.oracle import DATA


@pytest.fixture
def folder(spark, tmp_path):
    parts = spark.range(12_000).selectExpr("id AS p_partkey", "'large ring' AS p_name", "'Brand#7' AS p_brand", "'LARGE' AS p_type", "cast(id % 50 AS int) AS p_size", "900.0D AS p_retailprice")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_rows_are_dealt_out_evenly(spark):
    dealt = spread(spark.range(0, 20_001, 1, 1))
    assert dealt.rdd.getNumPartitions() == 5 and sorted(r[0] for r in dealt.collect()) == list(range(20_001))
    assert spread(spark.range(0, 0, 1, 1)).count() == 0


@pytest.mark.parametrize("made", [normalize.stand_in_pages, vehicle_posts._records, sticker_blocks._words])
def test_a_small_file_is_several_tasks_work(spark, folder, made):
    assert made(spark, folder).rdd.getNumPartitions() >= 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")
def test_shots_are_shuffled_once(spark):
    plan = shots.q_shot_picks(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
