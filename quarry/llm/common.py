"""Shared pieces of the corpus operators: inputs, the shared folder, written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that the corpus contracts call white space: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the setting is absent and all runs in this process (tests) a temporary folder is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths given out within `intermediates`, innermost last.
_given: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for given in _given[-1:]:
        given.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).delete(own, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Whatever is written below the shared folder inside is deleted at the end; the result must be written by then."""
    _given.append([])
    try:
        yield
    finally:
        for path in _given.pop():
            delete(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, and a lost executor
    costs only the reading of a file that all machines see."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what `materialize` wrote, once all that reads it has been written itself."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, folder)


#: Bytes of an Arrow batch that goes to Python, and the setting that bounds them.
ARROW_BYTES, _ARROW_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on whole texts go to Python a few MB at once, where the session has no bound of its own: 10,000 rows would be held by both sides."""
    if spark.conf.get(_ARROW_SETTING) == "67108864b":  # Spark's default
        spark.conf.set(_ARROW_SETTING, ARROW_BYTES)


def buckets_for(df: DataFrame, size: int = 256 << 20, least: int = 8, most: int = 8192) -> int:
    """Buckets for a table about as large as `df`: one for `size` bytes by the optimizer's estimate, or as many as
    shuffles have partitions where it has none."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate > 1 << 55:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(most, -(-estimate // size)))


class Bucketed:
    """A table in the shared folder (or at `location`), bucketed and sorted by `keys`: joins and groupings by them read
    it without an exchange."""

    def __init__(self, spark: SparkSession, schema: str, keys: list[str], buckets: int, label: str, location: str | None = None):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.location, self.name = location or fresh_path(spark, label), f"{label.replace('-', '_')}_{uuid.uuid4().hex}"
        by = ", ".join(keys)
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.location}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def dealt(self, df: DataFrame) -> DataFrame:
        """`df` in partitions that are the table's buckets."""
        return df.repartition(self.buckets, *self.keys)

    def append(self, df: DataFrame) -> None:
        """Add rows that are dealt out like the table's."""
        sorted_rows = df.select(*self.rows().columns).sortWithinPartitions(*self.keys)
        sorted_rows.write.format("parquet").mode("append").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        delete(self.spark, self.location)


def unused(name: str, df: DataFrame) -> str:
    """`name`, with underscores before it until `df` has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z alone; other letters keep their case."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_columns(column: Column) -> list[Column]:
    """96 bits of hash that stand for a string in joins and groupings."""
    return [F.xxhash64(column).alias("h1"), F.hash(column).alias("h2")]
