"""Galleries of cut-outs: colours and likeness against the others, foreign members by both, and galleries that settle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import gallery, settling
from quarry.sources.tables import shared_folder, table

#: The vectors of the tables are near to orthogonal, so galleries made of them are judged about zero.
CERTAIN, DOUBTFUL, FAR = -0.15, 0.0, 60.0


def _photos(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as photos in galleries of ten, six of them cut out."""
    e, at = table(spark, d, "embeddings").where("vec_id IS NOT NULL AND size(embedding) = 64"), F.col("vec_id") % 10
    colour = F.transform(F.slice("embedding", 1, 3), lambda c: 128 + 400 * c.cast("double"))
    return e.select(
        F.floor(F.col("vec_id") / 10).alias("gallery"),
        F.col("vec_id").alias("name"),
        F.when(at < 6, "exterior").otherwise("interior").alias("place"),
        F.when(at < 6, at + 1).otherwise(at - 5).alias("number"),
        F.col("embedding").alias("vector"),
        colour.alias("colour"),
        F.when(F.col("vec_id") % 7 < 5, "exterior").when(F.col("vec_id") % 7 == 5, "interior").alias("category"),
        (F.col("vec_id") % 11 == 0).alias("wheel"),
        (F.col("vec_id") % 13 != 0).alias("cut_ok"),
    )


def q_colour_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's colour against the median of the others with its label; a few labels hold all rows."""
    e = table(spark, d, "embeddings").where("label IS NOT NULL AND size(embedding) = 64")
    colours = e.select("label", F.col("vec_id").alias("name"), F.transform(F.slice("embedding", 1, 3), lambda c: 128 + 400 * c.cast("double")).alias("colour"))
    return gallery.colour_distance(colours, "label", "colour", "name").select("label", F.col("name").alias("vec_id"), F.round("distance", 6).alias("distance"))


def q_foreign_members(spark: SparkSession, d: str) -> DataFrame:
    """Members that their gallery doesn't vouch for, by likeness or by likeness and colour."""
    found = settling.foreign_members(_photos(spark, d).where("place = 'exterior'"), "gallery", CERTAIN, DOUBTFUL, FAR, 64)
    return found.select("gallery", F.col("name").alias("vec_id"), "reason")


def q_gallery_settle(spark: SparkSession, d: str) -> DataFrame:
    """What moves until no gallery changes any more."""
    log = settling.settle(_photos(spark, d), shared_folder(spark, "moves-log"), CERTAIN, DOUBTFUL, FAR, 64)
    return log.select("gallery", F.col("name").alias("vec_id"), "outcome", "place", "number")


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_PHOTOS_SQL = """p0 AS MATERIALIZED (SELECT vec_id // 10 AS gallery, vec_id, CASE WHEN vec_id % 10 < 6 THEN 'exterior' ELSE 'interior' END AS place, CASE WHEN vec_id % 10 < 6 THEN vec_id % 10 + 1 ELSE vec_id % 10 - 5 END AS number,
        embedding AS x, list_transform(embedding[1:3], lambda c: 128 + 400 * c::DOUBLE) AS c, CASE WHEN vec_id % 7 < 5 THEN 'exterior' WHEN vec_id % 7 = 5 THEN 'interior' END AS category,
        vec_id % 11 = 0 AS wheel, vec_id % 13 <> 0 AS cut_ok, false AS asked FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64)"""


def _foreign_sql(name: str, members: str) -> str:
    return f"""{name}_d AS (SELECT gallery, vec_id, unnest(x)::DOUBLE AS x, generate_subscripts(x, 1) AS i FROM {members}),
        {name}_s AS (SELECT gallery, i, sum(x) AS total, count(*) AS n FROM {name}_d GROUP BY 1, 2),
        {name}_l AS (SELECT gallery, vec_id, any_value(n) AS n, sum((total - x) * x) / (sqrt(sum((total - x) ** 2)) * sqrt(sum(x * x))) AS similarity FROM {name}_d JOIN {name}_s USING (gallery, i) WHERE n >= 4 GROUP BY 1, 2),
        {name}_m AS (SELECT a.gallery, a.vec_id, ch, any_value(a.c[ch]) AS v, median(b.c[ch]) AS m FROM {members} a JOIN {members} b ON a.gallery = b.gallery AND a.vec_id <> b.vec_id CROSS JOIN range(1, 4) r(ch) GROUP BY 1, 2, 3),
        {name}_c AS (SELECT gallery, vec_id, sqrt(sum((v - m) ** 2)) AS distance FROM {name}_m GROUP BY 1, 2),
        {name}_t AS (SELECT *, similarity < {CERTAIN} OR (similarity < {DOUBTFUL} AND distance > {FAR}) AS flag FROM {name}_l JOIN {name}_c USING (gallery, vec_id)),
        {name} AS MATERIALIZED (SELECT gallery, vec_id, similarity FROM (SELECT *, avg(flag::INT) OVER (PARTITION BY gallery) AS share FROM {name}_t) WHERE flag AND share <= 0.5)"""


def _settle_sql(demotes: int = 5, sweeps: int = 5) -> str:
    """The rounds one after another; those after the last that moves something change nothing."""
    parts = [_PHOTOS_SQL]
    for k in range(demotes + sweeps):
        if k < demotes:
            parts += [f"e{k} AS (SELECT * FROM p{k} WHERE place = 'exterior')", _foreign_sql(f"f{k}", f"e{k}")]
            parts.append(
                f"""m{k} AS MATERIALIZED (SELECT gallery, vec_id, 'demoted' AS outcome, 'interior' AS place, coalesce(last, 0) + row_number() OVER (PARTITION BY gallery ORDER BY similarity, vec_id) AS number
                FROM f{k} LEFT JOIN (SELECT gallery, max(number) AS last FROM p{k} WHERE place = 'interior' GROUP BY 1) USING (gallery))"""
            )
        else:
            parts.append(
                f"""a{k} AS MATERIALIZED (SELECT *, CASE WHEN category IS NULL THEN 'classify_failed' WHEN wheel THEN 'wheel_eligible_skipped' WHEN NOT cut_ok THEN 'cutout_failed' WHEN coalesce(held, 0) + 1 < 4 THEN 'insufficient_gallery' END AS early
                FROM (SELECT * FROM p{k} WHERE place = 'interior' AND NOT asked AND (category IS NULL OR category = 'exterior') QUALIFY row_number() OVER (PARTITION BY gallery ORDER BY number, vec_id) = 1)
                LEFT JOIN (SELECT gallery, count(*) AS held, max(number) AS last FROM p{k} WHERE place = 'exterior' GROUP BY 1) USING (gallery))"""
            )
            parts.append(
                f"""e{k} AS (SELECT gallery, vec_id, x, c FROM p{k} WHERE place = 'exterior' AND gallery IN (SELECT gallery FROM a{k} WHERE early IS NULL)
                UNION ALL SELECT gallery, vec_id, x, c FROM a{k} WHERE early IS NULL)"""
            )
            parts.append(_foreign_sql(f"f{k}", f"e{k}"))
            parts.append(
                f"""o{k} AS (SELECT a.*, coalesce(early, CASE WHEN f.vec_id IS NOT NULL THEN 'rejected_by_gallery' ELSE 'promoted' END) AS outcome FROM a{k} a LEFT JOIN f{k} f USING (gallery, vec_id)),
                m{k} AS MATERIALIZED (SELECT gallery, vec_id, outcome, CASE outcome WHEN 'promoted' THEN 'exterior' ELSE 'interior' END AS place, CASE outcome WHEN 'promoted' THEN coalesce(last, 0) + 1 ELSE number END AS number FROM o{k})"""
            )
        parts.append(
            f"""p{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (coalesce(m.place, p.place) AS place, coalesce(m.number, p.number) AS number, p.asked OR m.outcome IS NOT NULL AS asked) FROM p{k} p LEFT JOIN m{k} m USING (gallery, vec_id))"""
        )
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(f'SELECT * FROM m{k}' for k in range(demotes + sweeps))}"


ORACLES = {
    "colour_distance": """WITH v AS (SELECT label, vec_id, list_transform(embedding[1:3], lambda c: 128 + 400 * c::DOUBLE) AS c FROM embeddings WHERE label IS NOT NULL AND len(embedding) = 64),
        m AS (SELECT a.label, a.vec_id, ch, any_value(a.c[ch]) AS v, median(b.c[ch]) AS m FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id CROSS JOIN range(1, 4) r(ch) GROUP BY 1, 2, 3)
        SELECT label, vec_id, round(sqrt(sum((v - m) ** 2)), 6) AS distance FROM m GROUP BY 1, 2""",
    "foreign_members": f"""WITH {_PHOTOS_SQL}, e AS (SELECT * FROM p0 WHERE place = 'exterior'), {_foreign_sql("f", "e")}
        SELECT gallery, vec_id, CASE WHEN similarity < {CERTAIN} THEN 'certain' ELSE 'doubtful+colour' END AS reason FROM f""",
    "gallery_settle": _settle_sql(),
}
