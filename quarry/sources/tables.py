"""Inputs and outputs: tables, manifests, folders of records, feeds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("key", "vin", "url", "fetched_at", "folder", "delisted_at")] + [T.StructField("photos_pending", T.BooleanType())])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, each: int = 5_000) -> DataFrame:
    """A table's rows dealt out evenly, so many to a task: what is made of a row may be large and slow where the row itself is small, and a file of
    small rows is the work of one task or two however many there are."""
    n = -(-rows.count() // each)
    return rows.repartition(n) if n > 1 else rows


def shared_folder(spark: SparkSession, label: str) -> str:
    """An unused folder that all machines see, below spark.checkpoint.dir."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends there."""
    folder = shared_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, or an empty one where there is none yet."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(path)


def read_records(spark: SparkSession, folder: str, allowed: list[str], name: str = "details.json") -> DataFrame:
    """Vehicle records (one JSON file each, at any depth; a `vehicle` wrapper is taken off): path, record
    (variant; null if unreadable) and the keys that aren't allowed."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value"))
    parsed = raw.select("path", F.coalesce(F.get_json_object("value", "$.vehicle"), F.col("value")).alias("text"))
    return parsed.select("path", F.try_parse_json("text").alias("record"), F.array_except(F.json_object_keys("text"), F.array(*map(F.lit, allowed))).alias("unknown"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file; blank lines and `#` comments are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of local galleries: path, gallery, bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").rlike(r"\.(jpe?g|png|webp)$")).select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("gallery"), F.col("content").alias("bytes"))


def write_feed(rows: DataFrame, path: str, columns: list[str], separator: str = ",") -> None:
    """A feed of fixed columns with a header; missing values are empty."""
    rows.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns)).write.mode("overwrite").option("header", True).option("sep", separator).option("emptyValue", "").csv(path)


def append_log(rows: DataFrame, path: str) -> None:
    """A run's summary as JSON lines; columns that begin with `_` are private."""
    rows.drop(*(c for c in rows.columns if c.startswith("_"))).write.mode("append").json(path)
