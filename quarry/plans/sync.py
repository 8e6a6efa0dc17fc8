"""Keeping the inventory in step: what is known, what has gone, when to refuse, states and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import keyed, sequences
from quarry.sources.tables import table


def crawl_complete(seen: DataFrame, expected: DataFrame, key: str, item: str, share: float = 0.9) -> DataFrame:
    """key, seen, expected, complete: at least `share` of the expected items were seen."""
    counts = seen.groupBy(key).agg(F.count_distinct(item).alias("seen"))
    return counts.join(expected, key).select(key, "seen", "expected", (F.col("seen") >= share * F.col("expected")).alias("complete"))


def _recent_parts(spark: SparkSession, d: str, days: int) -> DataFrame:
    items = table(spark, d, "lineitem")
    last = items.agg(F.max("l_shipdate").alias("last"))  # one row
    return items.crossJoin(F.broadcast(last)).where(F.col("l_shipdate") >= F.col("last") - F.make_dt_interval(F.lit(days))).select(F.col("l_partkey").alias("p_partkey"))


def q_delisted(spark: SparkSession, d: str) -> DataFrame:
    return keyed.delisted(table(spark, d, "part"), _recent_parts(spark, d, 100), "p_partkey").select("p_partkey", "p_name")


def q_mass_delist_guard(spark: SparkSession, d: str) -> DataFrame:
    live = _recent_parts(spark, d, 100).distinct().withColumn("live", F.lit(True))
    parts = table(spark, d, "part").join(live, "p_partkey", "left")
    guarded = keyed.guarded(parts, F.col("live").isNull(), ["p_type"])
    return guarded.groupBy("p_type").agg(F.max("missing_n").alias("missing"), F.max("active_n").alias("active"), F.bool_or("refused").alias("refused"), F.count_if("flagged").alias("flagged"))


def q_whole_delist_guard(spark: SparkSession, d: str) -> DataFrame:
    """Parts against those shipped within some days: a narrow crawl is refused, a wide one isn't. Parts of size 1 are delisted already."""
    records = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") == 1, "2020-01-01").alias("delisted_at"))
    runs = [keyed.guarded_whole(records, _recent_parts(spark, d, days), "p_partkey").withColumn("days", F.lit(days)) for days in (10, 200)]
    counts = [F.max("missing_n").alias("missing"), F.max("active_n").alias("active"), F.bool_or("refused").alias("refused"), F.count_if("flagged").alias("flagged")]
    return runs[0].unionByName(runs[1]).groupBy("days").agg(*counts)


def q_skip_known(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    last = table(spark, d, "orders").agg(F.max("o_orderdate").alias("last"))  # one row
    held = orders.crossJoin(F.broadcast(last))
    known = keyed.known_or_new(table(spark, d, "customer"), held, "c_custkey", F.col("o_orderdate") >= F.col("last") - F.make_dt_interval(F.lit(365)))
    return known.select("c_custkey", "known")


def q_bucket_semi(spark: SparkSession, d: str) -> DataFrame:
    crawled = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, d, "supplier").join(crawled, "s_nationkey", "left_semi").select("s_suppkey", "s_nationkey")


def q_crawl_complete(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    expected = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") + 1).cast("long").alias("expected"))
    return crawl_complete(seen, expected, "o_custkey", "o_orderkey")


def q_sync_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(*(F.count_if(F.col("event_type") == t).alias(t) for t in ("click", "error", "purchase", "signup", "view")))


def q_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def q_manifest_latest(spark: SparkSession, d: str) -> DataFrame:
    return keyed.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


def q_manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Old states with the newer ones put over them; the first event's type is kept."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    split = e.agg((F.max("event_id") / 50).cast("long").alias("cut"))  # one row
    with_cut = e.crossJoin(F.broadcast(split))
    old = keyed.latest(with_cut.where("event_id < cut").drop("cut"), ["user_id"], ["event_id"])
    new = keyed.latest(with_cut.where("event_id >= cut").drop("cut"), ["user_id"], ["event_id"])
    return keyed.upsert(old, new, "user_id", kept=["event_type"]).select("user_id", "event_id", "event_type")


def q_cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text an earlier document has: the first owner. Texts are compared by digest."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    owner = docs.groupBy("digest").agg(F.min("doc_id").alias("owner"))
    return docs.join(owner, "digest").where(F.col("doc_id") != F.col("owner")).select("doc_id", "owner")


def q_submission_state(spark: SparkSession, d: str) -> DataFrame:
    """A job per conversation: pending after a question, done after an answer, failed after anything else."""
    state = keyed.latest(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"])
    return state.select("conv_id", (F.col("turn") + 1).alias("steps"), F.when(F.col("role") == "assistant", "done").when(F.col("role") == "user", "pending").otherwise("failed").alias("status"))


def q_pending_retry(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last error no later purchase has mended."""
    e = table(spark, d, "events")
    last = lambda kind, name: F.max(F.when(F.col("event_type") == kind, F.struct("ts", "event_id"))).alias(name)
    s = e.groupBy("user_id").agg(last("error", "error"), last("purchase", "mended"))
    return s.where(F.col("error").isNotNull() & (F.col("mended").isNull() | (F.col("mended") < F.col("error")))).select("user_id", F.col("error.event_id").alias("event_id"))


def q_ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Keys of three sources in their order, each once, from where it was seen first."""
    pos = lambda name, key, at: table(spark, d, name).select(F.col(key).cast("long").alias("key"), F.lit(at).alias("source"))
    rows = pos("supplier", "s_nationkey", 0).unionByName(pos("customer", "c_nationkey", 1)).unionByName(pos("nation", "n_nationkey", 2))
    return rows.groupBy("key").agg(F.min("source").cast("long").alias("source"))


def q_leading_run(spark: SparkSession, d: str) -> DataFrame:
    run = sequences.leading(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") != "error")
    return run.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


def q_neighbours_wrap(spark: SparkSession, d: str) -> DataFrame:
    return sequences.with_neighbours(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", "event_id")


def q_cumulative_schedule(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.length("o_orderpriority")).cast("long").alias("slot"))
    return sequences.with_offsets(orders, ["o_custkey"], "o_orderkey", "slot").select("o_orderkey", "start", "stop")


def q_slot_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The order whose slot holds each point in time; beyond the end the last."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.length("o_orderpriority").cast("long").alias("slot"))
    slots = sequences.with_offsets(orders, ["o_custkey"], "o_orderkey", "slot").select("o_custkey", "o_orderkey", "start", "stop")
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.array(*(F.lit(i).cast("long") for i in (0, 20, 90)))).alias("at"))
    return sequences.slot_at(points, slots, ["o_custkey"], "at").where("slot IS NOT NULL").select("o_custkey", "at", "slot.o_orderkey")


def q_interval_gap(spark: SparkSession, d: str) -> DataFrame:
    """The longest time that no event of a user covers, each event covering an hour."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("start"))
    return sequences.widest_gap(e.withColumn("stop", F.col("start") + 3_600_000_000), ["user_id"], "start", "stop")


def q_longest_run(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 10).alias("high"))
    return sequences.longest_run(e, ["user_id"], "event_id", "high")


def q_row_groups_anchor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").cast("double").alias("y"))
    return sequences.anchored(e, ["user_id"], "y", 500.0).groupBy("user_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("last"))


def q_continuation_merge(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    items = sequences.continued(lines, ["doc_id"], "pos", "line", r"[,;:-]$", r"^[a-z(]")
    return items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"), F.max(F.length("text")).cast("long").alias("longest"))


def q_edge_jump(spark: SparkSession, d: str) -> DataFrame:
    """The hour with the largest change in a user's events from the hour before."""
    from pyspark.sql import Window

    hours = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    jump = F.abs(F.col("n") - F.lag("n").over(Window.partitionBy("user_id").orderBy("hour")))
    best = hours.withColumn("jump", jump).where("jump IS NOT NULL").groupBy("user_id").agg(F.max_by(F.struct("hour", "jump"), F.struct(F.col("jump"), -F.col("hour"))).alias("b"))
    return best.select("user_id", F.col("b.hour").cast("long").alias("hour"), F.col("b.jump").alias("jump"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SQL_RECENT = "recent AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 100 DAY)"
_SQL_SLOTS = """slots AS (SELECT o_custkey, o_orderkey, sum(length(o_orderpriority)) OVER w - length(o_orderpriority) AS start, sum(length(o_orderpriority)) OVER w AS stop
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))"""

ORACLES = {
    "delisted": f"WITH {_SQL_RECENT} SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM recent)",
    "mass_delist_guard": f"""WITH {_SQL_RECENT}, c AS (SELECT p_type, count(*) FILTER (p_partkey NOT IN (SELECT l_partkey FROM recent)) AS missing, count(*) AS active FROM part GROUP BY 1)
        SELECT p_type, missing, active, missing / active > 0.3 AS refused, CASE WHEN missing / active > 0.3 THEN 0 ELSE missing END AS flagged FROM c""",
    "whole_delist_guard": """WITH last AS (SELECT max(l_shipdate) AS last FROM lineitem), runs AS (
            SELECT days, p_partkey NOT IN (SELECT l_partkey FROM lineitem, last WHERE l_shipdate >= last - INTERVAL 10 DAY) AS narrow,
                p_partkey NOT IN (SELECT l_partkey FROM lineitem, last WHERE l_shipdate >= last - INTERVAL 200 DAY) AS wide, p_size = 1 AS stamped
            FROM part, (VALUES (10), (200)) AS v(days)),
        c AS (SELECT days, count(*) FILTER (CASE days WHEN 10 THEN narrow ELSE wide END) AS missing, count(*) AS active, count(*) FILTER (CASE days WHEN 10 THEN narrow ELSE wide END AND NOT stamped) AS fresh FROM runs GROUP BY 1)
        SELECT days, missing, active, missing / active > 0.3 AS refused, CASE WHEN missing / active > 0.3 THEN 0 ELSE fresh END AS flagged FROM c""",
    "skip_known": "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY) AS known FROM customer",
    "bucket_semi": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)",
    "crawl_complete": """SELECT o_custkey, count(DISTINCT o_orderkey) AS seen, (any_value(c_nationkey) + 1)::BIGINT AS expected, count(DISTINCT o_orderkey) >= 0.9 * (any_value(c_nationkey) + 1) AS complete
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    "sync_summary": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2",
    "manifest_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "manifest_upsert": """WITH cut AS (SELECT floor(max(event_id) / 50) AS cut FROM events),
        old AS (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events, cut WHERE event_id < cut GROUP BY 1),
        new AS (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events, cut WHERE event_id >= cut GROUP BY 1)
        SELECT user_id, coalesce(new.event_id, old.event_id) AS event_id, coalesce(old.event_type, new.event_type) AS event_type FROM old FULL JOIN new USING (user_id)""",
    "cache_lookup": "SELECT doc_id, owner FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS owner FROM documents WHERE text IS NOT NULL) WHERE doc_id <> owner",
    "submission_state": """SELECT conv_id, max(turn) + 1 AS steps, CASE arg_max(role, turn) WHEN 'assistant' THEN 'done' WHEN 'user' THEN 'pending' ELSE 'failed' END AS status FROM conversations GROUP BY 1""",
    "pending_retry": """WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND (p.ts, p.event_id) > (e.ts, e.event_id))""",
    "ordered_union": """SELECT key, min(source)::BIGINT AS source FROM (SELECT s_nationkey::BIGINT AS key, 0 AS source FROM supplier UNION ALL SELECT c_nationkey, 1 FROM customer UNION ALL SELECT n_nationkey, 2 FROM nation) GROUP BY 1""",
    "leading_run": """WITH w AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY event_id) AS errors FROM events)
        SELECT user_id, count(*) AS n, max(event_id) AS last FROM w WHERE errors = 0 GROUP BY 1""",
    "neighbours_wrap": """SELECT user_id, event_id, coalesce(lag(event_id) OVER w, max(event_id) OVER (PARTITION BY user_id)) AS left, coalesce(lead(event_id) OVER w, min(event_id) OVER (PARTITION BY user_id)) AS right
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "cumulative_schedule": f"WITH {_SQL_SLOTS} SELECT o_orderkey, start::BIGINT AS start, stop::BIGINT AS stop FROM slots",
    "slot_lookup": f"""WITH {_SQL_SLOTS}, points AS (SELECT c_custkey, unnest([0, 20, 90])::BIGINT AS "at" FROM customer)
        SELECT o_custkey, "at", arg_max(o_orderkey, start) AS o_orderkey FROM points JOIN slots ON c_custkey = o_custkey AND start <= "at" GROUP BY 1, 2""",
    "interval_gap": """WITH e AS (SELECT user_id, epoch_us(ts) AS start, epoch_us(ts) + 3600000000 AS stop FROM events),
        g AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e)
        SELECT user_id, reached AS gap_start, start AS gap_stop, start - reached AS gap FROM g WHERE start > reached QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start - reached DESC, reached DESC) = 1""",
    "longest_run": """WITH p AS (SELECT user_id, event_id, value > 10 AS high, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        r AS (SELECT *, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM p WHERE high),
        l AS (SELECT user_id, run, min(event_id) AS start, max(event_id) AS stop, count(*) AS length FROM r GROUP BY 1, 2)
        SELECT user_id, start, stop, length FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, start DESC) = 1""",
    "continuation_merge": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        b AS (SELECT *, CASE WHEN regexp_matches(lag(line) OVER w, '[,;:-]$') OR (lag(line) OVER w IS NOT NULL AND regexp_matches(line, '^[a-z(]')) THEN 0 ELSE 1 END AS begins FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        n AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY pos) AS item FROM b),
        j AS (SELECT doc_id, item, string_agg(line, ' ' ORDER BY pos) AS text FROM n GROUP BY 1, 2)
        SELECT doc_id, count(*) AS items, max(length(text))::BIGINT AS longest FROM j GROUP BY 1""",
    "edge_jump": """WITH h AS (SELECT user_id, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
        j AS (SELECT *, abs(n - lag(n) OVER (PARTITION BY user_id ORDER BY hour)) AS jump FROM h)
        SELECT user_id, hour, jump FROM j WHERE jump IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY jump DESC, hour) = 1""",
    "row_groups_anchor": """WITH RECURSIVE a AS (
            SELECT user_id, min(event_id) AS anchor FROM events GROUP BY 1
            UNION ALL SELECT user_id, (SELECT min(e.event_id) FROM events e WHERE e.user_id = a.user_id AND e.event_id > a.anchor + 500) FROM a WHERE anchor IS NOT NULL),
        k AS (SELECT e.user_id, e.event_id, max(anchor) AS anchor FROM events e JOIN a ON a.user_id = e.user_id AND anchor <= event_id GROUP BY 1, 2)
        SELECT user_id, anchor::DOUBLE AS anchor, count(*) AS n, max(event_id)::DOUBLE AS last FROM k GROUP BY 1, 2""",
}
