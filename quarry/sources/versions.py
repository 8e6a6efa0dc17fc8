"""Tables that are replaced or merged in place of readers: data is written aside, then one small file that names it is renamed
into place. Whoever reads goes by the last such commit, so a run killed between any two steps leaves the old state or the new.

A commit lists folders only (one per bucket at most), never rows."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Files:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, pattern: str) -> list[str]:
        return sorted(str(s.getPath().getName()) for s in self.fs.globStatus(self._path(pattern)) or [])

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.hadoop.shaded.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file as a whole or not at all; False if it is there already."""
        if self.fs.exists(self._path(name)):
            return False
        aside = self._path(f"_{uuid.uuid4().hex}")
        stream = self.fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(self._path(name).getParent())
        return bool(self.fs.rename(aside, self._path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Commits:
    """Numbered commits of a folder; each is a small JSON object."""

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def numbers(self) -> list[int]:
        return [int(re.match(r"c(\d+)\.json$", n)[1]) for n in self.files.names("commits/c*.json")]

    def read(self, number: int) -> dict:
        return json.loads(self.files.text(f"commits/c{number:012d}.json"))

    def last(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def put(self, number: int, what: dict) -> bool:
        return self.files.put(f"commits/c{number:012d}.json", json.dumps(what, sort_keys=True))

    def forget(self, number: int) -> None:
        self.files.delete(f"commits/c{number:012d}.json")


class Publication:
    """A table that is replaced as a whole: a feed, a manifest, the summary of the last run."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.commits = spark, folder.rstrip("/"), Commits(spark, folder)

    def stage(self, rows: DataFrame) -> str:
        """Writes rows aside; nobody reads them yet."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}")
        return name

    def swap(self, name: str, schema: StructType, at: str) -> int:
        """From now on readers get what was staged as `name`. at: time of publication, as ISO text."""
        last = self.commits.last()
        number = last[0] + 1 if last else 0
        if not self.commits.put(number, {"data": name, "at": at, "schema": schema.json()}):
            raise RuntimeError("another writer published at the same time")
        return number

    def publish(self, rows: DataFrame, at: str) -> int:
        return self.swap(self.stage(rows), rows.schema, at)

    def read(self, number: int | None = None) -> DataFrame | None:
        """The rows of the last publication, or of an earlier one that hasn't expired."""
        last = self.commits.last()
        if last is None:
            return None
        what = last[1] if number is None else self.commits.read(number)
        return self.spark.read.schema(StructType.fromJson(json.loads(what["schema"]))).parquet(f"{self.folder}/{what['data']}")

    def expire(self, before: str) -> list[int]:
        """Drops publications older than `before`, and what was staged and never published; the last one stays."""
        numbers = self.commits.numbers()
        old = [n for n in numbers[:-1] if self.commits.read(n)["at"] < before]
        for n in old:
            self.commits.forget(n)
        kept = {self.commits.read(n)["data"] for n in self.commits.numbers()}
        for name in self.commits.files.names("data/*"):
            if f"data/{name}" not in kept:
                self.commits.files.delete(f"data/{name}")
        return old


class BucketTable:
    """Rows by key in hash buckets. A merge reads and rewrites only the buckets that it touches, then commits which folder
    each bucket is in. Every key has one bucket, so what decides about a key sees all of its rows."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str], buckets: int = 32, keep: int = 2):
        self.spark, self.folder, self.key, self.buckets, self.keep = spark, folder.rstrip("/"), list(key), buckets, keep
        self.commits = Commits(spark, folder)
        if last := self.commits.last():
            self.buckets = last[1]["n"]  # as the table was made or last dealt anew

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _of(self, what: dict, only: set[int] | None = None) -> DataFrame | None:
        paths = [f"{self.folder}/{at}/bucket={b}" for b, at in what["at"].items() if only is None or int(b) in only]
        return self.spark.read.schema(StructType.fromJson(json.loads(what["schema"]))).parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        last = self.commits.last()
        return None if last is None else self._of(last[1])

    def _write(self, rows: DataFrame, n: int, name: str) -> None:
        rows.withColumn("bucket", self._bucket(n)).repartition(n, "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/{name}")

    def merge(self, batch: DataFrame, pick: Callable[[DataFrame], DataFrame], number: int) -> list[int]:
        """Replaces the touched buckets by `pick` of their rows and the batch's; the buckets touched. A number that was committed
        before changes nothing. `pick` must decide by key alone."""
        last = self.commits.last()
        if last and last[0] >= number:
            return []
        touched = sorted(r[0] for r in batch.select(self._bucket(self.buckets).alias("b")).distinct().collect())  # `buckets` numbers at most
        old = self._of(last[1], set(touched)) if last else None
        rows = pick(batch if old is None else old.unionByName(batch.select(*old.columns)))
        name = f"data/v{number}"
        at = dict(last[1]["at"]) if last else {}
        if touched:
            self._write(rows, self.buckets, name)
            at |= {str(b): name for b in touched}
        if not self.commits.put(number, {"n": self.buckets, "at": at, "schema": rows.schema.json()}):
            raise RuntimeError("another writer merged at the same time")
        self._expire()
        return touched

    def grow(self, buckets: int, number: int) -> None:
        """Deals all rows out anew to another number of buckets."""
        rows, name = self.read(), f"data/v{number}"
        if rows is None:
            self.buckets = buckets
            return
        self._write(rows, buckets, name)
        present = [int(n.split("=")[1]) for n in self.commits.files.names(f"{name}/bucket=*")]
        if not self.commits.put(number, {"n": buckets, "at": {str(b): name for b in present}, "schema": rows.schema.json()}):
            raise RuntimeError("another writer merged at the same time")
        self.buckets = buckets
        self._expire()

    def _expire(self) -> None:
        """Forgets all but the last `keep` commits, and deletes the folders that none of them names."""
        numbers = self.commits.numbers()
        for n in numbers[: -self.keep]:
            self.commits.forget(n)
        used = {(at, b) for n in numbers[-self.keep :] for b, at in self.commits.read(n)["at"].items()}
        for version in self.commits.files.names("data/v*"):
            for bucket in self.commits.files.names(f"data/{version}/bucket=*"):
                if (f"data/{version}", bucket.split("=")[1]) not in used:
                    self.commits.files.delete(f"data/{version}/{bucket}")


def stale_files(existing: DataFrame, wanted: DataFrame, folder: str, name: str) -> DataFrame:
    """Numbered files and sidecars of galleries that are written anew which the new galleries don't have; files with other names, and
    those of galleries that aren't written, stay."""
    owned = existing.where(F.col(name).rlike(r"^(\d+\.[A-Za-z]+|angles\.json)$")).join(wanted.select(folder).distinct(), folder, "left_semi")
    return owned.join(wanted.select(folder, name), [folder, name], "left_anti")
