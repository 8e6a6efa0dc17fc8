"""The registry of vehicles and image submissions as keyed state.

Commands (entity, id, seq, kind and their values) change one entity each, in the order of seq:

* vehicle: `put` (metadata; a new one gets status new, an existing one keeps its status and creation), `status`, `delete`;
* submission: `submit` (images: id -> url, 1 to 60 of them, all pending), `image` (status, output, category and warning of one image of a submission).

A command on what isn't there is answered with found = false and changes nothing; a submission that exists isn't created again.
`fold` gives the state after all commands as one batch; `Registry` keeps it in a stream, in a bucketed table where a parent and its children
are one row: a micro-batch is folded onto the rows of its keys, and the buckets that it touches are rewritten. Both agree, however the commands are
cut into batches. A batch costs joins and aggregates by key, not a call for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.keyed import latest
from quarry.sources.tables import shared_folder, table
from quarry.sources.versions import BucketTable

MOST_IMAGES = 60
COMMAND = "entity string, id string, seq long, kind string, metadata string, status string, vehicle string, webhook string, images map<string,string>, image string, output string, category string, warning string"
_IMAGE = "struct<image:string,url:string,status:string,output:string,category:string,warning:string>"
ENTITY = f"entity string, id string, seq long, live boolean, created long, updated long, status string, metadata string, vehicle string, webhook string, images array<{_IMAGE}>"
_COLUMNS = ("entity", "id", "seq", "live", "created", "updated", "status", "metadata", "vehicle", "webhook", "images")
_CHILD = ("url", "status", "output", "category", "warning")
_KEYED = "entity IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL"


class Registry:
    """Keeps entities in a table (`folder`) from a stream of commands."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.table = BucketTable(spark, f"{self.folder}/entities", ["entity", "id"], buckets)

    def _apply(self, commands: DataFrame, batch_id: int) -> None:
        last = self.table.commits.last()
        if last and last[0] >= batch_id:
            return  # done before a restart, its replies first
        rows = self.table.read()
        before = None if rows is None else rows.where("live").join(commands.select("entity", "id").distinct(), ["entity", "id"], "left_semi")
        replies(commands, before).write.mode("overwrite").parquet(f"{self.folder}/replies/batch={batch_id}")  # a repeated batch writes the same again
        live = fold(commands, before).withColumn("live", F.lit(True))
        gone = commands.where("entity = 'vehicle' AND kind = 'delete'").select("entity", "id").distinct()
        dead = gone.join(live, ["entity", "id"], "left_anti").withColumn("live", F.lit(False))
        changed = live.unionByName(dead, allowMissingColumns=True).withColumn("seq", F.lit(batch_id).cast("long"))
        changed = changed.select(*_COLUMNS).persist()
        try:
            self.table.merge(changed, lambda rows: latest(rows, ["entity", "id"], ["seq"]), batch_id)
        finally:
            changed.unpersist()

    def run(self, commands: DataFrame) -> None:
        """Applies a stream of commands until nothing is left; may be called again for what has come since, also after a failure."""
        keyed = commands.where(_KEYED)
        query = keyed.writeStream.foreachBatch(self._apply).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def entities(self) -> DataFrame:
        """Live entities: vehicles, and submissions with their images."""
        rows = self.table.read()
        return (self.spark.createDataFrame([], ENTITY) if rows is None else rows).where("live").drop("live", "seq")

    def replies(self) -> DataFrame:
        return self.spark.read.schema("entity string, id string, seq long, found boolean").parquet(f"{self.folder}/replies")


def _made(submissions: DataFrame) -> DataFrame:
    """The first valid submit of each submission."""
    valid = submissions.where((F.col("kind") == "submit") & F.size("images").between(1, MOST_IMAGES))
    return valid.groupBy("id").agg(F.min_by(F.struct("seq", "vehicle", "webhook", "images"), "seq").alias("m")).select("id", F.col("m.seq").alias("created"), "m.vehicle", "m.webhook", "m.images")


def _nothing(commands: DataFrame) -> DataFrame:
    return commands.sparkSession.createDataFrame([], ENTITY)


def fold(commands: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The entities after all commands, as one batch: the same rows as `Registry.entities`. before: the live entities (as in the table) that
    the commands find."""
    c = commands.where(_KEYED)
    before = _nothing(commands) if before is None else before
    v = c.where("entity = 'vehicle'")
    gone = v.where("kind = 'delete'").groupBy("id").agg(F.max("seq").alias("gone"))
    after = v.where("kind <> 'delete'").join(gone, "id", "left").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    puts = after.where("kind = 'put'").groupBy("id").agg(F.min("seq").alias("first"), F.max("seq").alias("put"), F.max_by("metadata", "seq").alias("metadata"))
    old = F.struct("created", "updated", "status", "metadata").alias("old")
    held = puts.join(before.where("entity = 'vehicle'").select("id", old).join(gone, "id", "left_anti"), "id", "full")
    told = after.where("kind = 'status'").join(held.select("id", "first", F.col("old").isNotNull().alias("had")), "id").where("had OR seq > first").groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("set"))
    none = lambda kind="string": F.lit(None).cast(kind)
    vehicles = held.join(told, "id", "left").select(
        F.lit("vehicle").alias("entity"), "id", F.coalesce("old.created", "first").alias("created"), F.coalesce(F.greatest("put", "set"), F.col("old.updated")).alias("updated"),
        F.when(F.col("set").isNotNull(), F.col("status")).when(F.col("old").isNotNull(), F.col("old.status")).otherwise("new").alias("status"),
        F.when(F.col("put").isNotNull(), F.col("metadata")).otherwise(F.col("old.metadata")).alias("metadata"), none().alias("vehicle"), none().alias("webhook"), none(f"array<{_IMAGE}>").alias("images"),
    )
    s = c.where("entity = 'submission'")
    known = before.where("entity = 'submission'").select("id", "created", "updated", "vehicle", "webhook", "images")
    made = _made(s).join(known, "id", "left_anti")
    fresh = F.transform(F.map_entries("images"), lambda e: F.struct(e["key"].alias("image"), e["value"].alias("url"), F.lit("pending").alias("status"), *(none().alias(n) for n in _CHILD[2:])).cast(_IMAGE))
    # What is known takes every result; what is made here takes those after its submit.
    own = made.select("id", "created", F.col("created").alias("updated"), "vehicle", "webhook", fresh.alias("images"), F.col("created").alias("since")).unionByName(known.withColumn("since", none("long")))
    parts = own.select("id", "since", F.explode("images").alias("child")).select("id", "since", F.col("child.image").alias("image"), "child")
    results = s.where("kind = 'image'").select("id", "image", "seq", F.struct("status", "output", "category", "warning").alias("r"))
    last = parts.select("id", "since", "image").join(results, ["id", "image"]).where("since IS NULL OR seq > since").groupBy("id", "image").agg(F.max_by("r", "seq").alias("r"), F.max("seq").alias("set"))
    child = F.struct("image", F.col("child.url").alias("url"), *(F.when(F.col("set").isNull(), F.col(f"child.{n}")).otherwise(F.col(f"r.{n}")).alias(n) for n in _CHILD[1:]))
    images = parts.join(last, ["id", "image"], "left").groupBy("id").agg(F.array_sort(F.collect_list(child)).alias("images"), F.max("set").alias("set"))  # 60 at most
    submissions = own.drop("images").join(images, "id").select(
        F.lit("submission").alias("entity"), "id", "created", F.coalesce("set", "updated").alias("updated"), none().alias("status"), none().alias("metadata"), "vehicle", "webhook", "images"
    )
    return vehicles.unionByName(submissions)


def replies(commands: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """entity, id, seq, found: whether each command found what it is about, from `before` and the commands before it."""
    c = commands.where(_KEYED)
    before = _nothing(commands) if before is None else before
    v = c.where("entity = 'vehicle'").join(before.where("entity = 'vehicle'").select("id", F.lit(True).alias("had")), "id", "left")
    earlier = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lives = F.last(F.when(F.col("kind") == "put", True).when(F.col("kind") == "delete", False), ignorenulls=True).over(earlier)
    had = F.coalesce(lives, F.col("had"), F.lit(False))
    vehicles = v.select("entity", "id", "seq", F.when(F.col("kind") == "put", True).when(F.col("kind").isin("status", "delete"), had).otherwise(False).alias("found"))
    s = c.where("entity = 'submission'")
    known = before.where("entity = 'submission'").select("id", F.lit(None).cast("long").alias("since"), F.transform("images", lambda i: i["image"]).alias("names"))
    made = _made(s).join(known, "id", "left_anti").select("id", F.col("created").alias("since"), F.map_keys("images").alias("names"))
    there = F.coalesce(F.array_contains("names", F.col("image")), F.lit(False)) & (F.col("since").isNull() | (F.col("seq") > F.col("since")))
    found = F.when(F.col("kind") == "submit", F.coalesce(F.col("seq") == F.col("since"), F.lit(False))).when(F.col("kind") == "image", there).otherwise(False)
    submissions = s.join(known.unionByName(made), "id", "left").select("entity", "id", "seq", found.alias("found"))
    others = c.where("entity NOT IN ('vehicle', 'submission')").select("entity", "id", "seq", F.lit(False).alias("found"))
    return vehicles.unionByName(submissions).unionByName(others)


def progress(entities: DataFrame) -> DataFrame:
    """Submissions with their counts of images by status, and whether all are settled."""
    count = lambda *status: F.size(F.filter("images", lambda i: i["status"].isin(*status))).cast("long")
    counts = entities.where("entity = 'submission'").select("id", "vehicle", F.size("images").cast("long").alias("images"), *(count(s).alias(s) for s in ("pending", "processing", "done", "failed")))
    return counts.withColumn("finished", F.col("pending") + F.col("processing") == 0)


def commands_of(events: DataFrame) -> DataFrame:
    """Events as commands: a user has a vehicle and submissions, one for each of seven remainders of the event's number."""
    letter = F.get(F.array(*(F.lit(x) for x in "abcdefgh")), (F.col("event_id") % 8).cast("int"))
    count = (F.col("event_id") % 6).cast("int")  # 0: refused
    urls = F.map_from_arrays(F.slice(F.array(*(F.lit(x) for x in "abcdefgh")), F.lit(1), count), F.transform(F.slice(F.array(*(F.lit(x) for x in "abcdefgh")), F.lit(1), count), lambda x: F.concat(F.lit("http://x/"), x)))
    kind = F.col("event_type")
    own = kind.isin("view", "purchase", "error")
    by_id = F.when(kind == "view", "put").when(kind == "purchase", "status").when((kind == "error") & (F.col("event_id") % 3 == 0), "delete").when(kind == "error", "status").when(kind == "signup", "submit").otherwise("image")
    settled = F.when(F.col("value") < 30, "done").when(F.col("value") < 60, "processing").otherwise("failed")
    rows = events.select(
        F.when(own, "vehicle").otherwise("submission").alias("entity"),
        F.when(own, F.col("user_id").cast("string")).otherwise(F.concat("user_id", F.lit("-"), F.col("event_id") % 7)).alias("id"),
        F.col("event_id").alias("seq"),
        by_id.alias("kind"),
        F.col("props").alias("metadata"),
        settled.alias("status"),
        F.col("user_id").cast("string").alias("vehicle"),
        F.when(F.col("event_id") % 2 == 0, "http://callback").alias("webhook"),
        F.when(kind == "signup", urls).alias("images"),
        letter.alias("image"),
        F.when(F.col("value") < 30, F.concat(F.lit("/out/"), F.col("event_id"))).alias("output"),
        F.when(F.col("value") < 30, "exterior").alias("category"),
        F.when(F.col("value") >= 60, "failed").alias("warning"),
    )
    return rows


def _flat(entities: DataFrame) -> DataFrame:
    written = F.array_join(F.transform("images", lambda i: F.concat_ws("|", i["image"], i["url"], i["status"], i["output"], i["category"], i["warning"])), ",")
    return entities.select("entity", "id", "created", "updated", "status", "metadata", "vehicle", "webhook", written.alias("images"))


def q_submissions_fold(spark: SparkSession, d: str) -> DataFrame:
    return _flat(fold(commands_of(table(spark, d, "events"))))


def q_submissions_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same state, kept by a stream in a table with a parent and its children in one row."""
    registry = Registry(spark, shared_folder(spark, "registry"))
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").load(d)
    registry.run(commands_of(source))
    return _flat(registry.entities())


def q_submissions_progress(spark: SparkSession, d: str) -> DataFrame:
    return progress(fold(commands_of(table(spark, d, "events"))))


def q_command_replies(spark: SparkSession, d: str) -> DataFrame:
    """Whether each command on a vehicle found it, from the commands before it: the last put or delete decides."""
    c = commands_of(table(spark, d, "events")).where("entity = 'vehicle'")
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lives = F.last(F.when(F.col("kind") == "put", True).when(F.col("kind") == "delete", False), ignorenulls=True).over(before)
    return c.select("id", "seq", "kind", (F.coalesce(lives, F.lit(False)) | (F.col("kind") == "put")).alias("found"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_COMMANDS_SQL = """c AS (SELECT event_type IN ('view', 'purchase', 'error') AS own, CASE WHEN own THEN user_id::VARCHAR ELSE user_id || '-' || event_id % 7 END AS id, event_id AS seq,
        CASE event_type WHEN 'view' THEN 'put' WHEN 'purchase' THEN 'status' WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'status' END WHEN 'signup' THEN 'submit' ELSE 'image' END AS kind,
        props AS metadata, CASE WHEN value < 30 THEN 'done' WHEN value < 60 THEN 'processing' ELSE 'failed' END AS status, user_id::VARCHAR AS vehicle, CASE WHEN event_id % 2 = 0 THEN 'http://callback' END AS webhook, event_id % 6 AS n,
        ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'][event_id % 8 + 1] AS image, CASE WHEN value < 30 THEN '/out/' || event_id END AS output, CASE WHEN value < 30 THEN 'exterior' END AS category, CASE WHEN value >= 60 THEN 'failed' END AS warning FROM events)"""
_FOLD_SQL = f"""WITH {_COMMANDS_SQL},
        after AS (SELECT c.* FROM c LEFT JOIN (SELECT id, max(seq) AS gone FROM c WHERE own AND kind = 'delete' GROUP BY 1) g USING (id) WHERE own AND kind <> 'delete' AND (gone IS NULL OR seq > gone)),
        puts AS (SELECT id, min(seq) AS created, max(seq) AS put, arg_max(metadata, seq) AS metadata FROM after WHERE kind = 'put' GROUP BY 1),
        told AS (SELECT id, max(seq) AS told_at, arg_max(status, seq) AS status FROM after JOIN puts USING (id) WHERE kind = 'status' AND seq > created GROUP BY 1),
        made AS (SELECT id, seq AS created, vehicle, webhook, n FROM c WHERE kind = 'submit' AND n >= 1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq) = 1),
        parts AS (SELECT id, created, unnest(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'][1:n]) AS image FROM made),
        results AS (SELECT p.id, p.image, c.seq, c.status, c.output, c.category, c.warning FROM parts p LEFT JOIN c ON c.id = p.id AND c.image = p.image AND c.kind = 'image' AND c.seq > p.created QUALIFY row_number() OVER (PARTITION BY p.id, p.image ORDER BY c.seq DESC NULLS LAST) = 1)"""

ORACLES = {
    "submissions_fold": (
        _flat_sql := f"""{_FOLD_SQL},
        children AS (SELECT id, max(seq) AS set_at, string_agg(concat_ws('|', image, 'http://x/' || image, coalesce(status, 'pending'), output, category, warning), ',' ORDER BY image) AS images FROM results GROUP BY 1)
        SELECT 'vehicle' AS entity, id, created, greatest(put, told_at) AS updated, coalesce(status, 'new') AS status, metadata, NULL AS vehicle, NULL AS webhook, NULL AS images FROM puts LEFT JOIN told USING (id)
        UNION ALL SELECT 'submission', id, created, greatest(created, set_at), NULL, NULL, vehicle, webhook, images FROM made JOIN children USING (id)"""
    ),
    "submissions_stream": _flat_sql,
    "submissions_progress": f"""{_FOLD_SQL}
        SELECT id, any_value(vehicle) AS vehicle, count(*) AS images, count(*) FILTER (WHERE status IS NULL) AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'done') AS done,
            count(*) FILTER (WHERE status = 'failed') AS failed, bool_and(coalesce(status, 'pending') IN ('done', 'failed')) AS finished FROM results JOIN made USING (id) GROUP BY 1""",
    "command_replies": f"""WITH {_COMMANDS_SQL} SELECT id, seq, kind, kind = 'put' OR coalesce(last_value(CASE kind WHEN 'put' THEN true WHEN 'delete' THEN false END IGNORE NULLS) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS found FROM c WHERE own""",
}
