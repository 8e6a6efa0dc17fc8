"""The incremental sync as streams: state per key from micro-batches, and windows over event time.

State tables commit a batch by one renamed file, and a batch that ran before isn't applied again, so a restart after a
lost driver or executor goes on where it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.keyed import latest
from quarry.sources.tables import shared_folder, table
from quarry.sources.versions import BucketTable


class LatestState:
    """A table with the latest row of each key, kept by foreachBatch. Keys are hashed into buckets, and a batch rewrites only
    those it touches."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], order: Sequence[str], buckets: int = 32):
        self.key, self.order = list(key), list(order)
        self.table = BucketTable(spark, folder, self.key, buckets)

    def read(self) -> DataFrame | None:
        return self.table.read()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """A foreachBatch function; a batch that was applied isn't again."""
        self.table.merge(batch, lambda rows: latest(rows, self.key, self.order), batch_id)


def event_stream(spark: SparkSession, d: str, name: str = "events") -> DataFrame:
    """A table's file as a stream; its time without a zone becomes event time."""
    schema = table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").load(d).withColumn("ts", F.col("ts").cast("timestamp"))


def q_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user, kept by a stream that runs until nothing is left."""
    folder = shared_folder(spark, "latest")
    state = LatestState(spark, f"{folder}/state", ["user_id"], ["ts", "event_id"])
    source = event_stream(spark, d).select("user_id", "ts", "event_id", "event_type")
    query = source.writeStream.foreachBatch(state.apply).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return state.read().select("user_id", "event_id", "event_type")


def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each type per hour, with a watermark for late ones, appended to a Parquet sink."""
    folder = shared_folder(spark, "windows")
    counts = event_stream(spark, d).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.unix_micros("window.start").alias("start"), "event_type", "n")
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLES = {
    "stream_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    # A window goes out once the watermark has passed its end.
    "stream_windows": """SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, count(*) AS n FROM events
        GROUP BY 1, 2 HAVING epoch_us(time_bucket(INTERVAL 1 HOUR, any_value(ts))) + 3600000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)""",
}
