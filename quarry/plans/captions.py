"""Captions that a listing's own features confirm, and lookups and colours for composing: assets, calibrations, gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import colours
from quarry.operators import keyed, lookups, matching
from quarry.sources.tables import table

# What a photo may show, and the words of a feature list that confirm it, in their order.
CONFIRMED_BY = {
    "backup_camera": ["back-up camera", "backup camera", "rear view camera", "rearview camera"],
    "phone_mirroring": ["apple carplay", "carplay", "android auto"],
    "navigation_map": ["navigation"],
    "digital_cluster": ["digital instrument", "instrument cluster", "driver information"],
    "climate_controls": ["automatic temperature control", "dual climate", "climate control", "air conditioning"],
    "heated_seat_controls": ["heated front seat", "heated seat", "2nd row heated"],
    "sunroof": ["sunroof", "moonroof"],
    "leather_seats": ["leather seat", "leather-trimmed", "leather upholstery"],
    "cargo_area": ["cargo", "trunk"],
    "wireless_charging": ["wireless charging"],
    "usb_ports": ["usb"],
    "steering_controls": ["steering wheel mounted", "steering wheel audio"],
    "rear_seats": ["split folding rear seat", "60/40", "split-folding", "third row", "rear bench", "fold-flat"],
    "steering_wheel": ["leather-wrapped steering wheel", "leather steering wheel", "heated steering wheel", "tilt steering", "telescoping steering"],
}
# Labels that never caption, and the confidence below which none does.
ABSTAIN, SURE = ["none", "misc_controls", "cloth_seats", "dashboard"], 0.55


def confirmed(label: Column, features: Column) -> Column:
    """The vehicle's own wording for what a photo shows; null if its features don't say so."""
    keywords = F.create_map(*(c for k, words in CONFIRMED_BY.items() for c in (F.lit(k), F.array(*map(F.lit, words)))))
    return matching.first_confirmed(features, F.coalesce(keywords[label], F.array().cast("array<string>")))


def captions(photos: DataFrame, features: DataFrame, gallery: str, photo: str) -> DataFrame:
    """gallery, photo, caption: photos (gallery, photo, label, confidence) that may be captioned, each feature once a gallery, for the surest photo (of equally
    sure ones the first). Labels below `SURE`, and those that only absorb the unnameable, abstain."""
    sure = photos.where((F.col("confidence") >= SURE) & ~F.col("label").isin(ABSTAIN))
    said = sure.join(features, gallery).withColumn("caption", confirmed(F.col("label"), F.col("features"))).where("caption IS NOT NULL")
    return keyed.allocate_greedily(said.select(gallery, photo, "caption", "confidence"), [gallery], "caption", [F.desc("confidence"), F.asc(photo)]).select(gallery, photo, "caption")


_POOL = ["Apple CarPlay And Android Auto", "Rear Bench 60/40 Split", "Dual Climate Control", "Heated Front Seats", "Power Moonroof", "USB Ports", "Leather Steering Wheel", "Cargo Mat", "Android Auto", "Air Conditioning", "Navigation", "Third Row Seats"]


def _pool(seed: Column) -> Column:
    """The features of the pool whose bit is set in a number made of the seed."""
    bits = (seed * 2654435761) % 4096
    return F.filter(F.array(*(F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, t) for i, t in enumerate(_POOL))), lambda t: t.isNotNull())


def q_feature_captions(spark: SparkSession, d: str) -> DataFrame:
    """Events as interior photos of users' vehicles."""
    e = table(spark, d, "events")
    labels = F.array(*(F.lit(x) for x in [*CONFIRMED_BY, *ABSTAIN, "unheard_of"]))
    photos = e.select("user_id", "event_id", F.get(labels, (F.col("event_id") % (len(CONFIRMED_BY) + len(ABSTAIN) + 1)).cast("int")).alias("label"), (F.col("value") / 60).alias("confidence"))
    return captions(photos, e.select("user_id").distinct().select("user_id", _pool(F.col("user_id")).alias("features")), "user_id", "event_id")


def q_greedy_matching(spark: SparkSession, d: str) -> DataFrame:
    """Customers and days of orders, each once, dearest orders first."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").cast("string").alias("day"), "o_totalprice")
    taken = matching.match_greedily(o, ["o_custkey"], ["day"], [(-F.col("o_totalprice")).alias("less"), F.col("o_orderkey").alias("key")])
    return taken.select("o_custkey", "day", "o_orderkey")


def q_nearest_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' folders and calibrations of some folders above them."""
    s = table(spark, d, "supplier")
    folder = F.concat(F.lit("/n"), F.col("s_nationkey") % 5, F.lit("/a/b/"), F.col("s_nationkey"), F.lit("/c/d/"), F.col("s_suppkey"))
    marks = s.where("s_nationkey IS NOT NULL").select(F.explode(F.array(F.when(F.col("s_nationkey") % 5 < 4, F.struct(F.concat(F.lit("/n"), F.col("s_nationkey") % 5, F.lit("/a")).alias("path"), F.lit(0.5).alias("v"))),
        F.when(F.col("s_nationkey") % 3 == 0, F.struct(F.concat(F.lit("/n"), F.col("s_nationkey") % 5, F.lit("/a/b/"), F.col("s_nationkey")).alias("path"), F.when(F.col("s_nationkey") % 2 == 0, F.lit(0.6)).alias("v"))))).alias("m")).where("m IS NOT NULL").select("m.path", F.col("m.v").alias("certain"))
    return lookups.nearest_above(s.select("s_suppkey", folder.alias("path")), marks, "path", "certain").select("s_suppkey", "path", "certain", "found")


def q_asset_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts as assets of their type, named and tagged; every part asks for its brand, and customers for segments that aren't there."""
    p = table(spark, d, "part")
    assets = p.select(F.col("p_type").alias("category"), F.col("p_name").alias("name"), F.array("p_brand", (F.col("p_size") * 100 + F.col("p_partkey") % 100).cast("string")).alias("tags"), F.concat("p_partkey", F.lit(".png")).alias("file"), F.col("p_partkey").alias("position"))
    value = F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).when(F.col("p_partkey") % 4 == 2, (F.col("p_size") * 100 + F.col("p_partkey") % 100).cast("string"))
    wanted = F.when(F.col("p_partkey") % 8 == 3, "none of them").otherwise(F.initcap("p_name"))
    asked = p.select(F.when(F.col("p_partkey") % 50 == 0, "none").otherwise(F.col("p_type")).alias("category"), value.alias("value"), wanted.alias("default_name"), "p_partkey")
    return lookups.resolve(asked, assets).select("p_partkey", "file", F.col("entry.name").alias("name"), "error")


def q_gradient_stops(spark: SparkSession, d: str) -> DataFrame:
    """Parts' colours: a word in the name, or a sample measured from the part's numbers; interiors by size."""
    words = F.array(*(F.lit(w) for w in ["Black Leather", "ivory", "Dark Red", "Iconic", "Steel Blue", "navyblue", "Sandstone"]))
    byte = lambda k: (F.col("p_partkey") * k % 256).cast("double")
    sample = F.when(F.col("p_partkey") % 5 < 4, F.struct(byte(7).alias("r"), byte(13).alias("g"), byte(29).alias("b")))
    named = table(spark, d, "part").select("p_partkey", "p_name", F.get(words, (F.col("p_size") % 8).cast("int")).alias("interior"), sample.alias("sample"))
    made = colours.with_gradient(named, "p_name", "interior", "sample")
    return made.select("p_partkey", *(F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("first", "second") for c in "rgb"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _matching_sql(rounds: int = 40) -> str:
    parts = ["r0 AS MATERIALIZED (SELECT o_orderkey, o_custkey, o_orderdate::DATE::VARCHAR AS day, o_totalprice FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL)"]
    for k in range(rounds):
        order = "ORDER BY o_totalprice DESC, o_orderkey"
        parts.append(f"t{k} AS MATERIALIZED (SELECT * FROM r{k} QUALIFY row_number() OVER (PARTITION BY o_custkey {order}) = 1 AND row_number() OVER (PARTITION BY day {order}) = 1)")
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT * FROM r{k} WHERE o_custkey NOT IN (SELECT o_custkey FROM t{k}) AND day NOT IN (SELECT day FROM t{k}))")
    return f"WITH {', '.join(parts)} {' UNION ALL '.join(f'SELECT o_custkey, day, o_orderkey FROM t{k}' for k in range(rounds))}"


def _hsv_sql(name: str, source: str) -> str:
    return f"""{name}_x AS (SELECT p_partkey, {source}[1] / 255 AS r, {source}[2] / 255 AS g, {source}[3] / 255 AS b FROM src),
        {name} AS (SELECT p_partkey, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d, CASE WHEN d = 0 THEN 0 ELSE d / v END AS s,
            CASE WHEN d = 0 THEN 0 WHEN r = v THEN (g - b) / d WHEN g = v THEN 2 + (b - r) / d ELSE 4 + (r - g) / d END / 6 AS t, t - floor(t) AS h FROM {name}_x)"""


_NAMED_SQL = "CASE " + " ".join(f"WHEN lower({{0}}) LIKE '%{w}%' THEN {[float(x) for x in colours.COLOR_WORDS[w]]}" for w in sorted(colours.COLOR_WORDS, key=len, reverse=True)) + " END"


def _byte_sql(h: str, s: str, v: str, at: int) -> str:
    """One channel by its distance on the colour wheel: channel n is v - v*s*max(0, min(k, 4-k, 1)) with k = (n + 6h) mod 6."""
    k = f"fmod({(5, 3, 1)[at]} + 6 * ({h} - floor({h})), 6)"
    return f"round_even(255 * ({v} - {v} * {s} * greatest(0, least({k}, 4 - {k}, 1))), 0)::INT"


ORACLES = {
    "feature_captions": f"""WITH labels AS (SELECT {_list([*CONFIRMED_BY, *ABSTAIN, "unheard_of"])} AS l),
        words AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {i}, '{w}')" for k, ws in CONFIRMED_BY.items() for i, w in enumerate(ws))}) w(label, k, word)),
        features AS (SELECT user_id, f.i, f.text FROM (SELECT DISTINCT user_id FROM events) JOIN (VALUES {", ".join(f"({i}, '{t}')" for i, t in enumerate(_POOL))}) f(i, text) ON ((user_id * 2654435761) % 4096) & (1 << f.i) <> 0),
        photos AS (SELECT user_id, event_id, l[event_id % {len(CONFIRMED_BY) + len(ABSTAIN) + 1} + 1] AS label, value / 60 AS confidence FROM events, labels),
        said AS (SELECT user_id, event_id, confidence, text AS caption FROM photos JOIN words USING (label) JOIN features USING (user_id) WHERE confidence >= {SURE} AND contains(lower(text), word)
            QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY k, i) = 1)
        SELECT user_id, event_id, caption FROM said QUALIFY row_number() OVER (PARTITION BY user_id, caption ORDER BY confidence DESC, event_id) = 1""",
    "greedy_matching": _matching_sql(),
    "nearest_calibration": """WITH p AS (SELECT s_suppkey, s_nationkey, '/n' || s_nationkey % 5 || '/a/b/' || s_nationkey || '/c/d/' || s_suppkey AS path FROM supplier)
        SELECT s_suppkey, path, CASE WHEN s_nationkey % 3 = 0 THEN CASE WHEN s_nationkey % 2 = 0 THEN 0.6 END WHEN s_nationkey % 5 < 4 THEN 0.5 END::DOUBLE AS certain, s_nationkey % 3 = 0 OR s_nationkey % 5 < 4 AS found FROM p""",
    "asset_lookup": """WITH a AS (SELECT p_type AS category, p_name AS name, unnest([p_brand, (p_size * 100 + p_partkey % 100)::VARCHAR]) AS tag, p_partkey FROM part),
        q AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'none' ELSE p_type END AS category, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_brand WHEN 2 THEN (p_size * 100 + p_partkey % 100)::VARCHAR END AS value, CASE WHEN p_partkey % 8 = 3 THEN 'none of them' ELSE p_name END AS wanted FROM part),
        n AS (SELECT p_type AS category, lower(p_name) AS key, count(*) AS n, min(p_partkey) AS hit FROM part GROUP BY 1, 2),
        t AS (SELECT category, tag, count(DISTINCT p_partkey) AS n, min(p_partkey) AS hit FROM a GROUP BY 1, 2),
        f AS (SELECT p_type AS category, min(p_partkey) AS hit FROM part GROUP BY 1),
        r AS (SELECT q.p_partkey, value, f.hit AS first, n.n AS names, t.n AS tags, CASE WHEN n.n = 1 THEN n.hit WHEN t.n = 1 THEN t.hit END AS by_value, w.hit AS by_default FROM q LEFT JOIN f USING (category) LEFT JOIN n ON n.category = q.category AND n.key = lower(value)
            LEFT JOIN t ON t.category = q.category AND t.tag = value LEFT JOIN n w ON w.category = q.category AND w.key = lower(wanted)),
        e AS (SELECT *, CASE WHEN value IS NOT NULL THEN by_value ELSE coalesce(by_default, first) END AS hit FROM r)
        SELECT e.p_partkey, hit || '.png' AS file, p.p_name AS name, CASE WHEN first IS NULL THEN 'empty' WHEN value IS NOT NULL AND by_value IS NULL THEN CASE WHEN names IS NULL AND tags IS NULL THEN 'no match' ELSE 'ambiguous' END END AS error FROM e LEFT JOIN part p ON p.p_partkey = e.hit""",
    "gradient_stops": f"""WITH src AS (SELECT p_partkey, coalesce({_NAMED_SQL.format("p_name")}, CASE WHEN p_partkey % 5 < 4 THEN [(p_partkey * 7 % 256)::DOUBLE, (p_partkey * 13 % 256)::DOUBLE, (p_partkey * 29 % 256)::DOUBLE] END, [110.0, 122.0, 138.0]) AS e,
            coalesce({_NAMED_SQL.format("(['Black Leather', 'ivory', 'Dark Red', 'Iconic', 'Steel Blue', 'navyblue', 'Sandstone'][p_size % 8 + 1])")}, [26.0, 26.0, 30.0]) AS i FROM part),
        {_hsv_sql("x", "e")}, {_hsv_sql("y", "i")},
        j AS (SELECT p_partkey, x.h AS h1, y.h AS h2, CASE WHEN x.s > 0.1 THEN least(greatest(x.s, 0.28), 0.78) ELSE x.s END AS s1, CASE WHEN y.s > 0.1 THEN least(greatest(y.s, 0.28), 0.78) ELSE y.s END AS s2, 0.1::DOUBLE + x.v * (0.52::DOUBLE - 0.1::DOUBLE) AS a, 0.1::DOUBLE + y.v * (0.52::DOUBLE - 0.1::DOUBLE) AS b, greatest(x.s, y.s) <= 0.15 AS neutral FROM x JOIN y USING (p_partkey)),
        m AS (SELECT *, (a + b) / 2 AS mid, abs(a - b) < 0.14 AS near, CASE WHEN a >= b THEN 0.07 ELSE -0.07 END AS half, abs(h1 - h2 + 0.5 - floor(h1 - h2 + 0.5) - 0.5) < 0.02 AND abs(s1 - s2) < 0.05 AS alike FROM j),
        v AS (SELECT *, CASE WHEN near THEN least(greatest(mid + half, 0.1), 0.52) ELSE a END AS v1, CASE WHEN near THEN least(greatest(mid - half, 0.1), 0.52) ELSE b END AS v2 FROM m),
        w AS (SELECT *, alike AND neutral AND v1 >= v2 AS t1, alike AND neutral AND v1 < v2 AS t2 FROM v),
        z AS (SELECT p_partkey, v1, v2, CASE WHEN t1 THEN 0.6 ELSE h1 END AS k1, CASE WHEN t1 THEN 0.3 ELSE s1 END AS u1, CASE WHEN t2 THEN 0.6 WHEN alike AND NOT neutral THEN h2 + 0.055 ELSE h2 END AS k2, CASE WHEN t2 THEN 0.3 ELSE s2 END AS u2 FROM w)
        SELECT p_partkey, {", ".join(f"{_byte_sql(f'k{n}', f'u{n}', f'v{n}', c)} AS {side}_{'rgb'[c]}" for n, side in ((1, "first"), (2, "second")) for c in range(3))} FROM z""",
}
