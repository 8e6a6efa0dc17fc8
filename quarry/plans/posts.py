"""Listing copy for several channels, and equipment search."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.plans.feed import vehicles
from quarry.sources.tables import table

#: The post's limit, the facts that a short post drops, first to last, and its number of tags.
THREADS_LIMIT, THREADS_TAGS = 500, 6
TRIM_ORDER = ["stock", "vin", "drivetrain", "engine", "color", "carfax", "mileage"]
FACT_ORDER = ["mileage", "carfax", "color", "engine", "drivetrain", "vin", "stock"]


def money_phrase(price: Column) -> Column:
    """Truncated, not rounded."""
    return F.coalesce(F.concat(F.lit("$"), F.format_number(price.cast("long"), 0)), F.lit("Call for Price"))


def hashtags(parts: list[Column], limit: int = 14) -> Column:
    """From specific to broad, each once."""
    return F.slice(F.array_distinct(F.array_compact(F.array(*(text.hashtag(p) for p in parts)))), 1, limit)


def caption(headline: Column, price: Column, facts: Column, tags: Column) -> Column:
    return F.concat_ws("\n", headline, price, text.empty_to_null(F.array_join(F.array_compact(facts), "\n")), text.empty_to_null(F.array_join(tags, " ")))


def hook(headline: Column, price: Column, mileage: Column, longest: int = 125) -> Column:
    """One line that shows without a tap: with mileage if it still fits."""
    long = F.concat_ws(" | ", headline, price, mileage)
    return F.when(F.length(long) <= longest, long).otherwise(F.concat_ws(" | ", headline, price))


def trimmed(hook_line: Column, facts: dict[str, Column], call: Column, tags: Column, limit: int = THREADS_LIMIT) -> Column:
    """A short post: whole facts go, in TRIM_ORDER, until the text with all tags fits; then tags from the end; at
    last it is cut at a space. One expression per step of the fixed order, so it stays in the engine."""

    def post(gone: int, n_tags: Column) -> Column:
        kept = [facts[k] for k in FACT_ORDER if k in facts and k not in TRIM_ORDER[:gone]]
        shown = text.empty_to_null(F.array_join(F.array_compact(F.array(*kept, F.lit(None).cast("string"))), " · "))
        return F.concat_ws("\n\n", hook_line, shown, call, text.empty_to_null(F.array_join(F.slice(tags, 1, F.greatest(n_tags, F.lit(0))), " ")))

    every = F.size(tags)
    steps = [post(gone, every) for gone in range(len(TRIM_ORDER) + 1)]
    steps += [post(len(TRIM_ORDER), every - i) for i in range(1, THREADS_TAGS + 1)]
    fits = F.coalesce(*(F.when(F.length(s) <= limit, s) for s in steps))
    cut = F.regexp_replace(F.regexp_replace(F.substring(steps[-1], 1, limit), " [^ ]*$", ""), "[ ·—\n]+$", "")
    return F.concat(F.coalesce(fits, cut), F.lit("\n"))


def long_post(headline: Column, address: Column, lines: list[Column], sections: list[tuple[str, Column]]) -> Column:
    """Greeting, headline, address, facts (null ones are left out), then sections of features: a feature that an
    earlier section has, whatever its case and punctuation, isn't repeated, and empty sections go."""
    blocks, seen = [], F.array().cast("array<string>")
    for title, items in sections:
        kept = fresh(items, seen)
        seen = F.concat(seen, F.transform(items, text.feature_key))
        blocks.append(F.when(F.size(kept) > 0, F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), x)), "\n"))))
    return F.concat(F.trim(F.concat_ws("\n", headline, address, F.lit(""), *lines, *blocks)), F.lit("\n"))


def fresh(items: Column, earlier: Column) -> Column:
    """Items whose key no earlier section has, each key once, first wording first."""
    keys = F.transform(items, text.feature_key)
    return F.filter(items, lambda x, i: ~F.array_contains(earlier, text.feature_key(x)) & (F.array_position(keys, text.feature_key(x)) == i + 1))


#: Concepts in order with what stands for them in equipment text, words that alone don't tell a
#: concept, words without meaning in a query, and the trims that are looked for.
CONCEPTS = {
    "console": ["console"],
    "bucket seat": ["bucket"],
    "bench seat": ["bench", "split fold", "split-fold", "flip-up", "flip up", "40/20/40", "60/40", "50/50"],
    "captain's chairs": ["captain"],
    "third row": ["3rd row", "third row", "3rd-row"],
    "heated seats": ["heated seat", "htd seat", "htd/ventilated", "heated, "],
    "ventilated seats": ["ventilated", "cooled seat"],
    "leather": ["leather"],
    "moonroof": ["moonroof", "sunroof"],
    "navigation": ["navigation", "nav system"],
    "tow package": ["tow", "trailer tow", "5th wheel", "gooseneck"],
    "running boards": ["running board", "side step"],
    "bedliner": ["bedliner", "bed liner"],
    "tonneau cover": ["tonneau"],
    "4wd": ["4x4", "four wheel drive", "4wd"],
    "diesel": ["power stroke", "diesel", "duramax", "cummins"],
    "remote start": ["remote start"],
    "power seat": ["power driv", "power pass", "pwr driv", "pwr pass", "power seat"],
}
GENERIC = {"seat", "seats", "row"}
STOPWORDS = {"a", "an", "and", "the", "with", "no", "not", "without", "has", "have"}
TRIMS = (
    "xl", "xlt", "lariat", "king ranch", "platinum", "limited", "raptor", "badlands", "big bend", "outer banks", "sasquatch", "tremor", "sport", "premium", "select",
    "se", "sel", "sport utility", "base", "custom", "luxe", "n line", "st line", "sle", "denali", "at4", "z71", "trail boss", "high country",
)
#: Body types with the tags people search for, and the words of a price disclosure.
BODY_TAGS = {
    "suv": "SUV", "sport utility": "SUV", "truck": "Truck", "pickup": "Truck", "crew cab pickup": "Truck", "sedan": "Sedan", "coupe": "Coupe",
    "convertible": "Convertible", "hatchback": "Hatchback", "van": "Van", "cargo van": "WorkVan", "minivan": "Minivan", "wagon": "Wagon",
}
INCENTIVES = ("price includes", "rebate", "incentive", "discount", "cash allowance")
_DENIED = r"\b(?:no|not|without)\s+(.+?)(?=,| and |$)"


class Search:
    """What a query asks for: model terms, groups of wanted words, unwanted words."""

    def __init__(self, query: str, trims: Iterable[str] = TRIMS):
        asked = query.lower()
        self.models = [t for t in map(str.lower, trims) if re.search(rf"\b{re.escape(t)}\b", asked)] + re.findall(r"\bf-?\d{3}(?:sd)?\b", asked)
        self.unwanted = [w for denied in re.findall(_DENIED, asked) for w in self._words(denied)]
        phrases = map(self._bare, re.split(r",| and ", re.sub(_DENIED, "", asked)))
        self.wanted = [self._words(p) for p in phrases if p]

    def _bare(self, phrase: str) -> str:
        for m in self.models:
            phrase = phrase.replace(m, "")
        return " ".join(w for w in phrase.split() if w not in STOPWORDS)

    @staticmethod
    def _words(phrase: str) -> list[str]:
        """Of the first concept that shares a telling word; else the phrase itself."""
        told = set(re.findall(r"[a-z0-9/]+", phrase)) - GENERIC
        return next((words for name, words in CONCEPTS.items() if told & set(name.split())), [phrase.strip()])

    def column(self, model: Column, equipment: Column) -> Column:
        has = lambda words: F.coalesce(*[F.when(equipment.contains(w), True) for w in words], F.lit(False))
        out = F.lit(True)
        for m in self.models:
            out = out & model.contains(m)
        for group in self.wanted:
            out = out & has(group)
        return out & ~has(self.unwanted) if self.unwanted else out


def is_disclosure(description: Column) -> Column:
    """A price disclosure, which new vehicles' posts leave out."""
    return description.contains("$") & F.lower(description).rlike("|".join(INCENTIVES))


def body_tag(body: Column) -> Column:
    """The tag of the longest known body type that the text contains; else a tag of the text itself."""
    known = sorted(BODY_TAGS, key=len, reverse=True)
    return F.coalesce(*(F.when(F.lower(body).contains(k), F.lit(f"#{BODY_TAGS[k]}")) for k in known), text.hashtag(body))


def searchable(records: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Records with the rows of each source beside them, if any source has one."""
    out = records
    for name, df in sources.items():
        out = out.join(df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(name)), key, "left")
    present = F.lit(False)
    for name in sources:
        present = present | F.col(name).isNotNull()
    return out.where(present)


def concept_of(phrases: DataFrame, phrase: str, dictionary: list[str]) -> DataFrame:
    """Adds concept: the longest entry of a fixed dictionary that the phrase contains, first in order among equals."""
    order = sorted(range(len(dictionary)), key=lambda i: (-len(dictionary[i]), i))
    return phrases.withColumn("concept", F.coalesce(*(F.when(F.lower(phrase).contains(dictionary[i]), F.lit(dictionary[i])) for i in order)))


def q_hashtags(spark: SparkSession, d: str) -> DataFrame:
    tags = hashtags([F.concat_ws(" ", "p_brand", "p_name"), F.col("p_type"), F.col("p_brand"), F.col("p_type")], 3)
    return table(spark, d, "part").select("p_partkey", F.array_join(tags, " ").alias("tags"))


def q_caption(spark: SparkSession, d: str) -> DataFrame:
    facts = F.array(F.when(F.col("p_size") >= 10, F.concat(F.lit("Size "), F.col("p_size").cast("string"))), F.col("p_type"))
    return vehicles(spark, d).select("id", caption(F.col("title"), money_phrase(F.col("p_retailprice")), facts, F.array(F.lit("#parts"))).alias("caption"))


def q_threads_trim(spark: SparkSession, d: str) -> DataFrame:
    v = vehicles(spark, d)
    facts = {"mileage": F.concat(F.col("p_size").cast("string"), F.lit(" miles")), "color": F.repeat("p_name", F.lit(6)), "engine": F.repeat("p_type", F.col("p_size").cast("int")), "stock": F.concat(F.lit("Stock "), F.col("id").cast("string"))}
    post = trimmed(F.col("title"), facts, F.lit("Come and see it"), F.array(F.lit("#parts"), F.concat(F.lit("#"), F.col("p_type"))), 150)
    return v.select("id", post.alias("post"))


def q_long_post(spark: SparkSession, d: str) -> DataFrame:
    v = vehicles(spark, d)
    post = long_post(F.col("title"), F.lit("1 Main St"), [F.concat(F.lit("Price: "), money_phrase(F.col("p_retailprice")))], [("Name", F.array("p_name", F.upper("p_name"), F.col("p_type"))), ("Type", F.array("p_type")), ("Brand", F.array("p_brand"))])
    return v.select("id", post.alias("post"))


def q_one_owner_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.col("text").rlike(r"(?i)\b1[\s-]*owner\b") | F.col("text").rlike(r"(?i)\bone\b"), F.lit(False)).alias("flag"))


def q_equipment_search(spark: SparkSession, d: str) -> DataFrame:
    wanted = Search("the License and leather seats, not navigation")
    low = F.lower("text")
    docs = table(spark, d, "documents")
    found = Search("licensed not pathetic")
    return docs.where(found.column(low, low)).select("doc_id", wanted.column(low, low).alias("strict"))


def q_searchable_fleet(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    labels = table(spark, d, "labels")
    toxic = labels.where("toxic = 1").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    good = labels.where("quality = 1").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return searchable(docs, {"sticker": toxic, "vision": good}, "doc_id").select("doc_id", "sticker.toxic", "vision.quality")


def q_concept_lookup(spark: SparkSession, d: str) -> DataFrame:
    words = ["red", "ring", "small ring", "widget", "blue", "steel", "large"]
    return concept_of(table(spark, d, "part"), "p_name", words).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))


def q_hook_line(spark: SparkSession, d: str) -> DataFrame:
    v = vehicles(spark, d)
    return v.select("id", hook(F.col("title"), money_phrase(F.col("p_retailprice")), F.when(F.col("p_size") >= 10, F.concat(F.col("p_size").cast("string"), F.lit(" mi"))), 28).alias("hook"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SQL_TITLE = "p_brand || ' ' || p_name"
_SQL_MONEY = "'$' || format('{:,}', floor(p_retailprice)::BIGINT)"

ORACLES = {
    "caption": f"SELECT p_partkey AS id, concat_ws(chr(10), {_SQL_TITLE}, {_SQL_MONEY}, CASE WHEN p_size >= 10 THEN 'Size ' || p_size END, p_type, '#parts') AS caption FROM part",
    "hook_line": f"""WITH h AS (SELECT p_partkey, {_SQL_TITLE} || ' | ' || {_SQL_MONEY} AS short, CASE WHEN p_size >= 10 THEN ' | ' || p_size || ' mi' ELSE '' END AS more FROM part)
        SELECT p_partkey AS id, CASE WHEN length(short || more) <= 28 THEN short || more ELSE short END AS hook FROM h""",
    "hashtags": """WITH w AS (SELECT p_partkey, p_type, replace(p_brand, '#', '') AS brand, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), '') AS name FROM part)
        SELECT p_partkey, concat_ws(' ', CASE WHEN length(brand || name) <= 28 THEN '#' || brand || name END, '#' || p_type, '#' || brand) AS tags FROM w""",
    "threads_trim": f"""WITH f AS (SELECT p_partkey AS id, {_SQL_TITLE} AS head, chr(10) || chr(10) AS gap, p_size || ' miles' AS mileage, repeat(p_name, 6) AS color, repeat(p_type, p_size) AS engine, 'Stock ' || p_partkey AS stock, '#parts #' || p_type AS tags FROM part),
        c AS (SELECT id, unnest([concat_ws(gap, head, concat_ws(' · ', mileage, color, engine, stock), 'Come and see it', tags), concat_ws(gap, head, concat_ws(' · ', mileage, color, engine), 'Come and see it', tags),
            concat_ws(gap, head, concat_ws(' · ', mileage, color), 'Come and see it', tags), concat_ws(gap, head, mileage, 'Come and see it', tags), concat_ws(gap, head, 'Come and see it', tags)]) AS post, unnest([1, 2, 3, 4, 5]) AS step FROM f)
        SELECT id, arg_min(post, step) || chr(10) AS post FROM c WHERE length(post) <= 150 GROUP BY 1""",
    "one_owner_flag": r"SELECT doc_id, coalesce(regexp_matches(text, '(?i)\b1[\s-]*owner\b') OR regexp_matches(text, '(?i)\bone\b'), false) AS flag FROM documents",
    "equipment_search": """SELECT doc_id, contains(lower(text), 'license') AND contains(lower(text), 'leather') AND NOT (contains(lower(text), 'navigation') OR contains(lower(text), 'nav system')) AS strict
        FROM documents WHERE contains(lower(text), 'licensed') AND NOT contains(lower(text), 'pathetic')""",
    "searchable_fleet": """WITH l AS (SELECT doc_id, max(CASE WHEN toxic = 1 THEN 1 END) AS toxic, max(CASE WHEN quality = 1 THEN 1 END) AS quality FROM labels GROUP BY 1)
        SELECT doc_id, toxic, quality FROM documents JOIN l USING (doc_id) WHERE toxic IS NOT NULL OR quality IS NOT NULL""",
    "concept_lookup": """WITH w(word, i) AS (VALUES ('red', 0), ('ring', 1), ('small ring', 2), ('widget', 3), ('blue', 4), ('steel', 5), ('large', 6)),
        c AS (SELECT p_partkey, (SELECT arg_max(word, length(word) * 100 - i) FROM w WHERE contains(lower(p_name), word)) AS concept FROM part) SELECT concept, count(*) AS n FROM c GROUP BY 1""",
    "long_post": f"""SELECT p_partkey AS id, {_SQL_TITLE} || chr(10) || '1 Main St' || chr(10) || chr(10) || 'Price: ' || {_SQL_MONEY} || chr(10) || chr(10) || 'Name' || chr(10) || '- ' || p_name || chr(10) || '- ' || p_type
        || chr(10) || chr(10) || 'Brand' || chr(10) || '- ' || p_brand || chr(10) AS post FROM part""",
}
