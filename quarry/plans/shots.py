"""Which shots of a gallery go where: hero and accents, the four roles of a quad, the conveyor, carousels and spins.

A gallery is one row: its shots (file, angle, confidence) in the order of the angle sidecar, its cut-out files by name and its wheel files by
name; a gallery without angles goes by file names. A gallery holds a vehicle's photos, a few dozen; picks are folds over such arrays, so
galleries of any number need the one shuffle that gathers them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

# Orders of angles.
HERO = ["front_3q", "rear_3q", "side", "front", "rear"]
ACCENT = ["side", "front", "rear_3q", "rear", "front_3q"]
CAROUSEL = ["front_3q", "front", "side", "rear_3q", "rear"]
SPIN = ["front", "front_3q", "side", "rear_3q", "rear"]
FRONT, REAR = ["front", "front_3q"], ["rear", "rear_3q"]

SHOT = "struct<file:string,angle:string,confidence:double>"


def galleries(shots: DataFrame, key: str) -> DataFrame:
    """One row per gallery from rows (key, file, angle, confidence, position): shots, tops (the surest shot of each angle, the first of
    equal ones, by the angles' first appearance), files and wheels by name. Rows without an angle are files alone; the angle `wheel` is for
    wheel shots."""
    wheel = F.coalesce(F.col("angle") == "wheel", F.lit(False))
    shot = F.struct("file", "angle", F.col("confidence").cast("double").alias("confidence"))
    runs = shots.groupBy(key, "angle").agg(
        F.max_by(shot, F.struct(F.col("confidence"), -F.col("position"))).alias("top"), F.min("position").alias("seen"), F.collect_list(F.struct("position", shot.alias("shot"))).alias("shots")
    )
    known = F.col("angle").isNotNull() & ~wheel
    names = F.transform("shots", lambda s: s["shot"]["file"])
    rows = lambda c: F.transform(F.array_sort(c), lambda s: s["shot"]).cast(f"array<{SHOT}>")
    return runs.groupBy(key).agg(
        rows(F.flatten(F.collect_list(F.when(known, F.col("shots"))))).alias("shots"),
        rows(F.collect_list(F.when(known, F.struct("seen", F.col("top").alias("shot"))))).alias("tops"),
        F.array_sort(F.flatten(F.collect_list(F.when(~wheel, names)))).alias("files"),
        F.array_sort(F.flatten(F.collect_list(F.when(wheel, names)))).alias("wheels"),
    )


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _files(shots: Column) -> Column:
    return F.transform(shots, lambda s: s["file"])


def by_angle(tops: Column, angles: Column) -> Column:
    """The files of the angles that there are, in the order of `angles`."""
    return F.flatten(F.transform(angles, lambda a: _files(F.filter(tops, lambda s: s["angle"] == a))))


def surest_first(shots: Column) -> Column:
    """Shots by confidence, equal ones as they stand."""
    placed = F.transform(shots, lambda s, i: F.struct((-s["confidence"]).alias("less"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(placed), lambda p: p["s"])


def line_up(g: Column) -> Column:
    """All shots as heroes and accents would be taken: the hero, other angles by priority, then whatever is left by confidence. The hero with n accents is
    the first n + 1 of them."""
    first = F.slice(F.concat(by_angle(g["tops"], _texts(HERO)), _files(g["tops"])), 1, 1)
    all_of = F.array_distinct(F.concat(first, by_angle(g["tops"], _texts(ACCENT)), _files(surest_first(g["shots"]))))
    return F.when(F.size(g["tops"]) > 0, all_of).otherwise(g["files"])


def quad(g: Column) -> Column:
    """Hero, front, back and side, each with its fallbacks; a shot has one role."""
    roles = [F.slice(by_angle(g["tops"], _texts(a)), 1, 1) for a in (["front_3q", "front", "side"], ["front", "front_3q"], ["rear", "rear_3q"], ["side"])]
    return F.when(F.size(g["tops"]) > 0, F.array_distinct(F.concat(*roles))).otherwise(F.slice(g["files"], 1, 4))


def conveyor(g: Column) -> Column:
    """Hero, left and right: the first unused of a role's angles, else the surest unused angle. A fold over the roles whose state is what is used."""
    others = _files(surest_first(g["tops"]))
    wanted = F.array(*(F.concat(by_angle(g["tops"], _texts(a)), others) for a in (HERO, FRONT, REAR)))
    taken = F.aggregate(wanted, F.array().cast("array<string>"), lambda used, files: F.concat(used, F.slice(F.array_except(files, used), 1, 1)))
    return F.when(F.size(g["tops"]) > 0, taken).otherwise(F.slice(g["files"], 1, 3))


def _pair(file: Column, angle: Column) -> Column:
    return F.struct(file.alias("file"), angle.alias("angle"))


def carousel(g: Column, every: bool = False) -> Column:
    """file and angle: the surest shot of each angle, or every shot by confidence, front to rear; unknown angles after the known ones, as they first appear; wheels last."""
    shots = surest_first(g["shots"]) if every else g["tops"]
    angles = F.array_distinct(F.concat(_texts(CAROUSEL), F.transform(g["tops"], lambda s: s["angle"])))
    walk = F.flatten(F.transform(angles, lambda a: F.transform(F.filter(shots, lambda s: s["angle"] == a), lambda s: _pair(s["file"], s["angle"]))))
    plain = F.transform(g["files"], lambda f: _pair(f, F.lit("unknown")))
    return F.concat(F.when(F.size(g["tops"]) > 0, walk).otherwise(plain), F.transform(g["wheels"], lambda f: _pair(f, F.lit("wheel"))))


def seated(pairs: Column, three: Column) -> Column:
    """A carousel turned so that it opens like the conveyor's three: its hero first, its right next, its left last, the rest as they stand."""
    of = lambda i: F.filter(pairs, lambda p: p["file"] == F.get(three, F.lit(i)))
    return F.concat(of(0), of(2), F.filter(pairs, lambda p: ~F.array_contains(three, p["file"])), of(1))


def layout(four: Column) -> Column:
    """The layout that a quad's filled roles allow."""
    return F.when(F.size(four) >= 4, "quad").when(F.size(four) >= 2, "corners").otherwise("single")


def spin(g: Column) -> Column:
    """file and angle of the surest shot of each known angle, in geometric order."""
    return F.flatten(F.transform(_texts(SPIN), lambda a: F.transform(F.filter(g["tops"], lambda s: s["angle"] == a), lambda s: _pair(s["file"], s["angle"]))))


def picks(made: DataFrame, key: str, accents: int = 2) -> DataFrame:
    """All picks of each gallery (of `galleries`): key, hero_shots, quad, conveyor, layout, adaptive, carousel, all_shots, opening, spin."""
    g = F.struct("shots", "tops", "files", "wheels")
    once = made.select(key, line_up(g).alias("line_up"), quad(g).alias("quad"), conveyor(g).alias("conveyor"), carousel(g).alias("carousel"), carousel(g, True).alias("all_shots"), spin(g).alias("spin"))
    adaptive = F.when(F.size("quad") >= 4, F.col("quad")).otherwise(F.slice("line_up", F.lit(1), F.greatest(F.size("quad"), F.lit(1))))
    return once.select(
        key, F.slice("line_up", 1, accents + 1).alias("hero_shots"), "quad", "conveyor", layout(F.col("quad")).alias("layout"), adaptive.alias("adaptive"), "carousel", "all_shots", seated(F.col("all_shots"), F.col("conveyor")).alias("opening"), "spin"
    )


def _shots(spark: SparkSession, d: str) -> DataFrame:
    """Orders' lines as shots: a supplier's number tells the angle (some unknown, some none), the discount how sure it is."""
    # Dealt by order once: the aggregates by line, by angle and by gallery that follow need no shuffle of their own.
    dealt = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_discount").repartition("l_orderkey")
    line = dealt.groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_suppkey", "l_discount"), F.struct("l_suppkey", "l_partkey", "l_discount")).alias("l"))
    names = _texts([*CAROUSEL, "detail", "wheel"])
    angle = F.when(F.col("l_orderkey") % 9 > 0, F.get(names, (F.col("l.l_suppkey") % 7).cast("int")))
    return line.select("l_orderkey", F.concat("l_linenumber", F.lit(".png")).alias("file"), angle.alias("angle"), (1 - F.col("l.l_discount")).alias("confidence"), F.col("l_linenumber").alias("position"))


def _told(pairs: str) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["file"], F.lit(":"), p["angle"])), ",")


def q_shot_picks(spark: SparkSession, d: str) -> DataFrame:
    found = picks(galleries(_shots(spark, d), "l_orderkey"), "l_orderkey")
    plain, pairs = ("hero_shots", "quad", "conveyor", "adaptive"), ("carousel", "all_shots", "opening", "spin")
    return found.select("l_orderkey", "layout", *(F.array_join(c, ",").alias(c) for c in plain), *(_told(c).alias(c) for c in pairs))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}


def _priority(angles: list[str]) -> str:
    return "[" + ", ".join(f"'{a}'" for a in angles) + "]"


def _best_of_angle(angles: list[str]) -> str:
    return f"list_filter(list_transform({_priority(angles)}, lambda a: list_filter(tops, lambda s: s.angle = a)[1].file), lambda f: f IS NOT NULL)"


def _by_angle(shots: str) -> str:
    return f"flatten(list_transform(angles, lambda a: list_transform(list_filter({shots}, lambda s: s.angle = a), lambda s: s.file || ':' || s.angle)))"


ORACLES = {
    # The sequential picks are recursions: a step adds the first wanted file that isn't used yet.
    "shot_picks": f"""WITH RECURSIVE line AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_discount FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey, l_discount) = 1),
        shot AS (SELECT l_orderkey, l_linenumber || '.png' AS file, CASE WHEN l_orderkey % 9 > 0 THEN {_priority([*CAROUSEL, "detail", "wheel"])}[l_suppkey % 7 + 1] END AS angle, 1 - l_discount AS confidence, l_linenumber AS position FROM line),
        top AS (SELECT *, min(position) OVER (PARTITION BY l_orderkey, angle) AS seen FROM shot WHERE angle <> 'wheel' QUALIFY row_number() OVER (PARTITION BY l_orderkey, angle ORDER BY confidence DESC, position) = 1),
        g AS (SELECT l_orderkey, list(file ORDER BY file) FILTER (WHERE angle IS DISTINCT FROM 'wheel') AS files, coalesce(list(file ORDER BY file) FILTER (WHERE angle = 'wheel'), []) AS wheels,
            list(struct_pack(file, angle) ORDER BY confidence DESC, position) FILTER (WHERE angle <> 'wheel') AS shots FROM shot GROUP BY 1),
        t AS (SELECT l_orderkey, list(struct_pack(file, angle) ORDER BY seen) AS tops, list(file ORDER BY confidence DESC, seen) AS surest FROM top GROUP BY 1),
        k AS (SELECT *, list_concat(list_filter({_priority(CAROUSEL)}, lambda a: list_contains(list_transform(tops, lambda s: s.angle), a)), list_filter(list_transform(tops, lambda s: s.angle), lambda a: NOT list_contains({_priority(CAROUSEL)}, a))) AS angles FROM g LEFT JOIN t USING (l_orderkey)),
        w AS (SELECT l_orderkey, coalesce(({_best_of_angle(HERO)})[1], tops[1].file) AS hero, list_concat({_best_of_angle(ACCENT)}, list_transform(shots, lambda s: s.file)) AS accents,
            [list_concat({_best_of_angle(HERO)}, surest), list_concat({_best_of_angle(FRONT)}, surest), list_concat({_best_of_angle(REAR)}, surest)] AS seats,
            list_distinct_in_order AS quad FROM (SELECT *, [({_best_of_angle(["front_3q", "front", "side"])})[1], ({_best_of_angle(FRONT)})[1], ({_best_of_angle(REAR)})[1], ({_best_of_angle(["side"])})[1]] AS r,
            list_filter(r, lambda f, i: f IS NOT NULL AND coalesce(list_position(r, f), 0) = i) AS list_distinct_in_order FROM k) WHERE tops IS NOT NULL),
        h AS (SELECT l_orderkey, 0 AS i, [hero] AS h FROM w
            UNION ALL SELECT l_orderkey, i + 1, CASE WHEN len(h) > 2 OR list_contains(h, accents[i + 1]) THEN h ELSE list_append(h, accents[i + 1]) END FROM h JOIN w USING (l_orderkey) WHERE i < len(accents)),
        c AS (SELECT l_orderkey, 0 AS i, []::VARCHAR[] AS c FROM w
            UNION ALL SELECT l_orderkey, i + 1, list_concat(c, list_filter(seats[i + 1], lambda f: NOT list_contains(c, f))[1:1]) FROM c JOIN w USING (l_orderkey) WHERE i < 3),
        o AS (SELECT k.*, w.quad AS q, h.h, c.c FROM k LEFT JOIN w USING (l_orderkey) LEFT JOIN h ON h.l_orderkey = k.l_orderkey AND h.i = len(w.accents) LEFT JOIN c ON c.l_orderkey = k.l_orderkey AND c.i = 3),
        p AS (SELECT l_orderkey, coalesce(h, files[1:3], []) AS hero_shots, coalesce(q, files[1:4], []) AS quad, coalesce(c, files[1:3], []) AS conveyor, coalesce(h, files, []) AS line_up,
            list_concat(CASE WHEN tops IS NULL THEN list_transform(coalesce(files, []), lambda f: f || ':unknown') ELSE {_by_angle("tops")} END, list_transform(wheels, lambda f: f || ':wheel')) AS carousel,
            list_concat(CASE WHEN tops IS NULL THEN list_transform(coalesce(files, []), lambda f: f || ':unknown') ELSE {_by_angle("shots")} END, list_transform(wheels, lambda f: f || ':wheel')) AS all_shots,
            coalesce(list_transform(list_filter(list_transform({_priority(SPIN)}, lambda a: list_filter(tops, lambda s: s.angle = a)[1]), lambda s: s IS NOT NULL), lambda s: s.file || ':' || s.angle), []) AS spin FROM o)
        SELECT l_orderkey, CASE WHEN len(quad) >= 4 THEN 'quad' WHEN len(quad) >= 2 THEN 'corners' ELSE 'single' END AS layout, array_to_string(hero_shots, ',') AS hero_shots, array_to_string(quad, ',') AS quad, array_to_string(conveyor, ',') AS conveyor,
            array_to_string(CASE WHEN len(quad) >= 4 THEN quad ELSE line_up[1:greatest(len(quad), 1)] END, ',') AS adaptive, array_to_string(carousel, ',') AS carousel, array_to_string(all_shots, ',') AS all_shots,
            array_to_string(list_concat(list_filter(all_shots, lambda s: split_part(s, ':', 1) = conveyor[1]), list_filter(all_shots, lambda s: split_part(s, ':', 1) = conveyor[3]),
                list_filter(all_shots, lambda s: NOT list_contains(conveyor, split_part(s, ':', 1))), list_filter(all_shots, lambda s: split_part(s, ':', 1) = conveyor[2])), ',') AS opening, array_to_string(spin, ',') AS spin FROM p""",
}
