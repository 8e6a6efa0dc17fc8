"""Vehicles and image submissions: the store's rules, and a stream that agrees with a batch however it is cut and restarted."""

import os

from pyspark.sql import functions as F

from quarry.sources.tables import shared_folder, table
from quarry.streaming.submissions import COMMAND, Registry, commands_of, fold, progress
from tests.oracle import DATA

NAMES = [c.split()[0] for c in COMMAND.split(", ")]


def commands(spark, *rows):
    return spark.createDataFrame([tuple(dict(r, seq=r.get("seq", i)).get(n) for n in NAMES) for i, r in enumerate(rows)], COMMAND)


def vehicle(kind, id_="VIN1", **more):
    return {"entity": "vehicle", "id": id_, "kind": kind, **more}


def submission(kind, id_="S1", **more):
    return {"entity": "submission", "id": id_, "kind": kind, **more}


def plain(df):
    return {r.id: r.asDict(True) for r in df.collect()}


STORY = [
    vehicle("put", metadata='{"make": "Ford"}'),
    vehicle("put", metadata='{"make": "Ford", "model": "F-150"}'),
    vehicle("status", "NOPE", status="done"),
    vehicle("put", "VIN2", metadata="{}"),
    vehicle("status", "VIN2", status="done"),
    vehicle("put", "VIN2", metadata="{2}"),
    vehicle("put", "VIN3"),
    vehicle("delete", "VIN3"),
    vehicle("delete", "VIN3"),
    submission("image", "S1", image="a", status="done"),
    submission("submit", "S0", images={}),
    submission("submit", "S60", images={str(i): "u" for i in range(61)}),
    submission("submit", "S1", images={"a": "http://x/a.jpg", "b": "http://x/b.jpg"}, vehicle="VIN1", webhook="http://callback/hook"),
    submission("submit", "S1", images={"z": "u"}),
    submission("image", "S1", image="a", status="done", output="/out/a.png", category="exterior"),
    submission("image", "S1", image="nope", status="done"),
    submission("submit", "S2", images={"a": "u"}),
]
FOUND = [True, True, False, True, True, True, True, True, False, False, False, False, True, False, True, False, True]


def stream_of(spark, folder):
    return spark.readStream.schema(COMMAND).parquet(folder)


def test_the_rules_as_a_batch(spark):
    got = plain(fold(commands(spark, *STORY)))
    assert set(got) == {"VIN1", "VIN2", "S1", "S2"}
    assert got["VIN1"]["metadata"] == '{"make": "Ford", "model": "F-150"}' and got["VIN1"]["status"] == "new" and (got["VIN1"]["created"], got["VIN1"]["updated"]) == (0, 1)
    assert got["VIN2"]["status"] == "done" and got["VIN2"]["metadata"] == "{2}"
    a, b = got["S1"]["images"]
    assert (a["status"], a["output"], a["category"], a["warning"]) == ("done", "/out/a.png", "exterior", None) and (b["status"], b["url"]) == ("pending", "http://x/b.jpg")
    assert (got["S1"]["vehicle"], got["S1"]["webhook"], got["S2"]["webhook"]) == ("VIN1", "http://callback/hook", None)
    counts = {r.id: (r.images, r.pending, r.done, r.finished) for r in progress(fold(commands(spark, *STORY))).collect()}
    assert counts == {"S1": (2, 1, 1, False), "S2": (1, 1, 0, False)}


def test_the_rules_as_a_stream_cut_anywhere_and_restarted(spark):
    folder, inbox = shared_folder(spark, "registry"), shared_folder(spark, "inbox")
    rows = commands(spark, *STORY).coalesce(1)
    for low, high in ((0, 4), (4, 9), (9, 13), (13, 99)):
        rows.where(F.col("seq").between(low, high - 1)).write.mode("append").parquet(inbox)
        Registry(spark, folder, 4).run(stream_of(spark, inbox))  # a new driver each time
    registry = Registry(spark, folder, 4)
    assert plain(registry.entities()) == plain(fold(commands(spark, *STORY)))
    assert [r.found for r in registry.replies().orderBy("seq").collect()] == FOUND
    registry.run(stream_of(spark, inbox))
    assert plain(registry.entities()) == plain(fold(commands(spark, *STORY)))


def test_a_failed_batch_is_applied_once(spark):
    folder, inbox = shared_folder(spark, "registry"), shared_folder(spark, "inbox")
    commands(spark, *STORY).coalesce(1).write.parquet(inbox)
    broken = Registry(spark, folder, 4)
    merge, broken.table.merge = broken.table.merge, lambda *_: (_ for _ in ()).throw(OSError("killed"))
    try:
        broken.run(stream_of(spark, inbox))
        raise AssertionError("the batch should fail")
    except AssertionError:
        raise
    except Exception:  # noqa: S110, BLE001
        pass
    registry = Registry(spark, folder, 4)
    registry.run(stream_of(spark, inbox))
    assert plain(registry.entities()) == plain(fold(commands(spark, *STORY)))


def test_nothing(spark):
    assert fold(spark.createDataFrame([], COMMAND)).isEmpty() and Registry(spark, shared_folder(spark, "registry")).entities().isEmpty()


def test_a_stream_in_two_halves_equals_the_batch(spark):
    rows = commands_of(table(spark, DATA, "events")) if os.path.isdir(DATA) else commands(spark, *STORY)
    folder, inbox = shared_folder(spark, "registry"), shared_folder(spark, "inbox")
    middle = rows.agg(F.percentile("seq", 0.5)).first()[0]
    for half in (F.col("seq") <= middle, F.col("seq") > middle):
        rows.where(half).coalesce(1).write.mode("append").parquet(inbox)
        Registry(spark, folder, 4).run(stream_of(spark, inbox))
    assert plain(Registry(spark, folder).entities()) == plain(fold(rows))


def test_a_batch_costs_no_call_for_each_key(spark):
    """Keys by the thousand in several batches: with a Python call for each of them this took minutes."""
    import time

    rows = commands_of(spark.range(40_000).selectExpr("id AS event_id", "id % 5000 AS user_id", "element_at(array('view', 'purchase', 'error', 'signup', 'click'), cast(id % 5 AS int) + 1) AS event_type", "cast(id % 97 AS double) AS value", "'{}' AS props"))
    folder, inbox = shared_folder(spark, "registry"), shared_folder(spark, "inbox")
    began = time.time()
    for low in (0, 20_000):
        rows.where(F.col("seq").between(low, low + 19_999)).coalesce(1).write.mode("append").parquet(inbox)
        Registry(spark, folder, 4).run(stream_of(spark, inbox))
    took = time.time() - began
    registry = Registry(spark, folder, 4)
    assert plain(registry.entities()) == plain(fold(rows))
    assert registry.replies().count() == 40_000 and took < 90
