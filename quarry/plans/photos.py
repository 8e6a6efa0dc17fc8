"""Photos: labels by prototype, verdicts, the best shots, foreign and repeated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import numbers
from quarry.operators import calibration, gallery, keyed
from quarry.sources.tables import table

DIM = 64


def prototypes(vectors: DataFrame, label: str, vector: str, dim: int = DIM) -> DataFrame:
    """The mean vector of each label."""
    means = vectors.groupBy(label).agg(*(F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim)))
    return means.select(F.col(label).alias("label"), F.array(*(F.col(f"m{i}") for i in range(dim))).alias("prototype"))


def verdict(scene: Column, tiebreak: Column, tiebreak_confidence: Column, margin: Column, by_score: Column) -> Column:
    """category, cut_out and reason of a photo. margin: the smallest of the subject's box in its frame, null without a box."""
    of = lambda category, cut, reason: F.struct(category.alias("category"), cut.alias("cut_out"), F.lit(reason).alias("reason"))
    yes, no = F.lit(True), F.lit(False)
    body = (tiebreak == "exterior_body") & (tiebreak_confidence >= 0.65)
    real = F.when(by_score == "detail", F.lit("exterior")).otherwise(by_score)
    return (
        F.when(scene == "detail", of(F.lit("exterior"), no, "detail"))
        .when((scene == "interior") & body, of(F.lit("exterior"), yes, "tiebreak"))
        .when(scene.isin("interior", "document"), of(scene, no, "label"))
        .when(scene == "exterior", of(scene, yes, "label"))
        .when(margin.isNull() | (margin < 0.02), of(F.lit("marketing"), no, "no_subject"))
        .otherwise(of(real, by_score == "exterior", "subject"))
    )


def hero_and_accents(shots: DataFrame, key: str, first: list[str], then: list[str], accents: int) -> DataFrame:
    """Of each gallery the first angle of `first` it has, then accents by `then`, filled by confidence: key,
    pick, place. shots: one row per angle (angle, file, confidence)."""
    rank = lambda order: F.coalesce(*(F.when(F.col("angle") == a, F.lit(i)) for i, a in enumerate(order)), F.lit(len(order)))
    row = lambda order: F.struct(rank(order).alias("rank"), (-F.col("confidence")).alias("less"), F.col("angle").alias("angle"), F.col("file").alias("file"))
    # A gallery has one row per angle: a few at most.
    grouped = shots.groupBy(key).agg(F.min(row(first)).alias("hero"), F.array_sort(F.collect_list(row(then))).alias("rest"))
    others = F.slice(F.filter("rest", lambda r: r["angle"] != F.col("hero.angle")), 1, accents)
    picks = F.concat(F.array("hero.file"), F.transform(others, lambda r: r["file"]))
    return grouped.select(key, F.posexplode(picks).alias("place", "pick"))


def layout(accents: Column) -> Column:
    return F.when(accents >= 3, "quad").when(accents >= 1, "corners").otherwise("single")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("label IS NOT NULL AND embedding IS NOT NULL")


def q_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    best = gallery.label_by_prototype(e, "embedding", prototypes(e, "label", "embedding"), ["vec_id"])
    return best.select("vec_id", "best", F.round("confidence", 4).alias("confidence"))


def q_verdict_cascade(spark: SparkSession, d: str) -> DataFrame:
    name = lambda c: F.element_at(F.array(*map(F.lit, ("exterior", "interior", "detail", "document", "marketing"))), (c % 5 + 1).cast("int"))
    e = table(spark, d, "events")
    v = verdict(name(F.col("event_id")), F.when(F.col("user_id") % 2 == 0, "exterior_body").otherwise("interior_panel"), F.col("value") / 20, F.when(F.col("event_id") % 7 > 0, F.col("value") / 500), name(F.col("user_id") % 3))
    return e.select(v.alias("v")).select("v.*").groupBy("category", "cut_out", "reason").agg(F.count(F.lit(1)).alias("n"))


def q_best_per_group(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return keyed.best_of(e, ["user_id", "event_type"], "value", "event_id", ["event_id", "value"])


def q_priority_pick(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    shots = keyed.best_of(e, ["user_id", "event_type"], "value", "event_id", ["event_id", "value"]).select("user_id", F.col("event_type").alias("angle"), F.col("event_id").alias("file"), F.col("value").alias("confidence"))
    picks = hero_and_accents(shots, "user_id", ["purchase", "signup"], ["view"], 2)
    return picks.select("user_id", F.col("place").cast("long").alias("place"), "pick")


def q_mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_orderkey")
    return keyed.mode_first_seen(items, ["l_returnflag", "l_linestatus"], "l_quantity", "l_orderkey")


def q_loo_similarity(spark: SparkSession, d: str) -> DataFrame:
    return gallery.likeness(_embeddings(spark, d), "label", "embedding", DIM).select("vec_id", F.round("similarity", 6).alias("similarity"))


def q_foreign_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = gallery.foreign(gallery.likeness(_embeddings(spark, d), "label", "embedding", DIM), "label", certain=-0.15, doubtful=0.0)
    return rows.select("vec_id", "foreign")


def q_impostor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of each gallery's mean to the others' (galleries of a label set, a few)."""
    p = prototypes(_embeddings(spark, d), "label", "embedding")
    a, b = p.select(F.col("label").alias("a"), F.col("prototype").alias("pa")), p.select(F.col("label").alias("b"), F.col("prototype").alias("pb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(numbers.cosine(F.col("pa"), F.col("pb")), 6).alias("cosine"))


def q_calibrate_floor(spark: SparkSession, d: str) -> DataFrame:
    """The likeness below which a photo doesn't belong to its gallery, from all galleries: one row."""
    found = calibration.calibrate(_embeddings(spark, d), "label", "vec_id", "embedding", DIM)
    schema = "certain_similarity double, bootstrap_mean double, bootstrap_sd double, n_galleries long, n_genuine long, n_impostor long, worst_genuine double, margin double"
    return spark.createDataFrame([found] if found else [], schema)


def q_near_dup_greedy(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return gallery.keep_distinct(e, "label", "vec_id", "embedding", 0.35).groupBy("label").agg(F.count(F.lit(1)).alias("kept"))


def q_junk_hamming(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).select(F.col("vec_id").alias("id"), numbers.sign_bits(F.col("embedding"), 32).alias("hash"))
    pairs = keyed.hamming_pairs(e, e, 32, 5).where("left_id < right_id")
    return pairs.select("left_id", "right_id", F.col("distance").cast("long").alias("distance"))


def q_greedy_unique(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value >= 5").select("event_type", "user_id", "event_id", "value")
    return keyed.allocate_greedily(e, ["event_type"], "user_id", [F.desc("value"), F.asc("event_id")]).select("event_type", "user_id", "event_id")


def q_median_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each line's quantity to the median of its part's (a part's lines: a few dozen)."""
    items = table(spark, d, "lineitem")
    median = items.groupBy("l_partkey").agg(F.percentile("l_quantity", 0.5).alias("median"))
    return items.join(median, "l_partkey").groupBy("l_partkey").agg(F.round(F.max(F.abs(F.col("l_quantity") - F.col("median"))), 6).alias("farthest"))


def q_bitrate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", numbers.bitrate(F.lit(48.0), F.col("o_totalprice") / 1000).alias("kbps"), F.round(numbers.ease_out(F.col("o_totalprice") / 400000), 6).alias("eased"), F.round(numbers.beat_pulse(F.col("o_totalprice") / 1000, F.lit(0.5)), 6).alias("pulse"))


def q_fit_layout(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    w, h = numbers.fitted(F.col("p_size") * 10.0, F.col("p_retailprice"), 1080.0, 1350.0, 0.1)
    return p.select("p_partkey", w.alias("w"), h.alias("h"), layout(F.col("p_size") % 5).alias("layout"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SQL_DIMS = """d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"""
_SQL_LIKE = f"""WITH {_SQL_DIMS}, s AS (SELECT label, i, sum(x) AS total, count(*) AS n FROM d GROUP BY 1, 2),
        l AS (SELECT vec_id, label, any_value(n) AS members, sum((total - x) / (n - 1) * x) / (sqrt(sum(((total - x) / (n - 1)) ** 2)) * sqrt(sum(x * x))) AS similarity FROM d JOIN s USING (label, i) GROUP BY 1, 2)"""
_SQL_NAME = "['exterior', 'interior', 'detail', 'document', 'marketing'][({0}) % 5 + 1]"

ORACLES = {
    "zero_shot": f"""WITH {_SQL_DIMS}, p AS (SELECT label AS best, i, avg(x) AS m FROM d GROUP BY 1, 2),
        c AS (SELECT vec_id, best, 100 * sum(m * x) / (sqrt(sum(m * m)) * sqrt(sum(x * x))) AS score FROM d JOIN p USING (i) GROUP BY 1, 2)
        SELECT vec_id, arg_max(best, score) AS best, round(1 / sum(exp(score - top)), 4) AS confidence FROM (SELECT *, max(score) OVER (PARTITION BY vec_id) AS top FROM c) GROUP BY 1""",
    "verdict_cascade": f"""WITH e AS (SELECT {_SQL_NAME.format('event_id')} AS scene, user_id % 2 = 0 AND value / 20 >= 0.65 AS body, CASE WHEN event_id % 7 > 0 THEN value / 500 END AS margin, {_SQL_NAME.format('user_id % 3')} AS best FROM events),
        v AS (SELECT CASE WHEN scene = 'detail' THEN ('exterior', false, 'detail') WHEN scene = 'interior' AND body THEN ('exterior', true, 'tiebreak')
            WHEN scene IN ('interior', 'document') THEN (scene, false, 'label') WHEN scene = 'exterior' THEN (scene, true, 'label')
            WHEN margin IS NULL OR margin < 0.02 THEN ('marketing', false, 'no_subject') ELSE (CASE best WHEN 'detail' THEN 'exterior' ELSE best END, best = 'exterior', 'subject') END AS v FROM e)
        SELECT v[1] AS category, v[2] AS cut_out, v[3] AS reason, count(*) AS n FROM v GROUP BY 1, 2, 3""",
    "best_per_group": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1",
    "priority_pick": """WITH s AS (SELECT user_id, event_type AS angle, event_id AS file, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1),
        h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE angle WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, value DESC, angle) AS hero FROM s),
        a AS (SELECT user_id, file, CASE WHEN hero = 1 THEN 0 ELSE row_number() OVER (PARTITION BY user_id, hero = 1 ORDER BY CASE angle WHEN 'view' THEN 0 ELSE 1 END, value DESC, angle) END AS place FROM h)
        SELECT user_id, place, file AS pick FROM a WHERE place <= 2""",
    "mode_first_seen": """WITH c AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS n, min(l_orderkey) AS first_at FROM lineitem GROUP BY 1, 2, 3)
        SELECT l_returnflag, l_linestatus, l_quantity, n FROM c QUALIFY row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY n DESC, first_at) = 1""",
    "loo_similarity": f"{_SQL_LIKE} SELECT vec_id, round(similarity, 6) AS similarity FROM l",
    "foreign_flag": f"{_SQL_LIKE}, f AS (SELECT vec_id, label, similarity < -0.15 AND members >= 4 AS flag FROM l) SELECT vec_id, flag AND avg(flag::INT) OVER (PARTITION BY label) <= 0.5 AS foreign FROM f",
    "impostor_pairs": f"""WITH {_SQL_DIMS}, p AS (SELECT label, i, avg(x) AS m FROM d GROUP BY 1, 2)
        SELECT a.label AS a, b.label AS b, round(sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))), 6) AS cosine FROM p a JOIN p b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""",
    "junk_hamming": """WITH h AS (SELECT vec_id, list_reduce(list_transform(embedding[1:32], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, x: a * 2 + x) AS hash FROM embeddings)
        SELECT a.vec_id AS left_id, b.vec_id AS right_id, bit_count(xor(a.hash, b.hash))::BIGINT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.hash, b.hash)) <= 5""",
    "greedy_unique": "SELECT event_type, user_id, event_id FROM events WHERE value >= 5 QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) = 1",
    "median_distance": "SELECT l_partkey, round(max(abs(l_quantity - m)), 6) AS farthest FROM lineitem JOIN (SELECT l_partkey, median(l_quantity) AS m FROM lineitem GROUP BY 1) USING (l_partkey) GROUP BY 1",
    "bitrate": """SELECT o_orderkey, greatest(4000, least(20000, floor(48.0 * 8000 / (o_totalprice / 1000))))::INT AS kbps, round(1 - (1 - greatest(0.0, least(1.0, o_totalprice / 400000))) ** 3, 6) AS eased,
        round(1 + 0.03 * exp(-fmod(o_totalprice / 1000, 0.5) / 0.5 / 0.18), 6) AS pulse FROM orders""",
    "fit_layout": """WITH s AS (SELECT *, least(1080.0::DOUBLE * 0.9 / (p_size * 10.0::DOUBLE), 1350.0::DOUBLE * 0.9 / p_retailprice) AS scale FROM part)
        SELECT p_partkey, round_even(p_size * 10.0::DOUBLE * scale, 0)::INT AS w, round_even(p_retailprice * scale, 0)::INT AS h, CASE WHEN p_size % 5 >= 3 THEN 'quad' WHEN p_size % 5 >= 1 THEN 'corners' ELSE 'single' END AS layout FROM s""",
}
