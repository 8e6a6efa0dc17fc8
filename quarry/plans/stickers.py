"""Window stickers: words with their places become lines, prices, warranties; and numbering and stamping of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import sequences
from quarry.sources.tables import table

MONEY = r"^-?\$?[0-9][0-9,]*(\.[0-9]{2})?$"
WARRANTY = r"(?i)^\s*(\d+)\s*YR/([\d,]+)\s+(.+?)\s*$"


def words_of(markup: Column) -> Column:
    """Words with their boxes from a PDF's text in bbox markup: x, y, text."""
    raw = F.regexp_extract_all(markup, F.lit(r"(?s)<word [^>]*>.*?</word>"), F.lit(0))
    number = lambda w, name: F.regexp_extract(w, rf'\b{name}="([-0-9.]+)"', 1).try_cast("double")
    return F.transform(raw, lambda w: F.struct(number(w, "xMin").alias("x"), number(w, "yMin").alias("y"), F.regexp_extract(w, r"(?s)>(.*?)</word>", 1).alias("text")))


def lines(words: DataFrame, key: str, tolerance: float = 3.0) -> DataFrame:
    """Rows of words whose y is within the tolerance of the row's first: key, anchor, words (in order of x)."""
    grouped = sequences.anchored(words.withColumn("y", F.col("y").cast("double")), [key], "y", tolerance).groupBy(key, "anchor")
    return grouped.agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]).alias("words"))


def after_label(words: Column, label: list[str]) -> Column:
    """The place after the label as consecutive words (any case); null if it isn't there."""
    low = F.transform(words, lambda w: F.regexp_replace(F.lower(w), ":$", ""))
    places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.slice(low, i + 1, len(label)) == F.array(*map(F.lit, label)))
    return F.get(places, F.lit(0)) + len(label)


def price_after(words: Column, label: list[str]) -> Column:
    at = after_label(words, label)
    return F.when(at.isNotNull(), F.get(F.filter(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), lambda w: w.rlike(MONEY)), F.lit(0)))


def warranty(line: Column) -> Column:
    """`3YR/36,000 bumper` as `3-Year / 36,000-Mile Bumper`; null for other lines."""
    part = lambda i: F.regexp_extract(line, WARRANTY, i)
    return F.when(line.rlike(WARRANTY), F.concat(part(1), F.lit("-Year / "), part(2), F.lit("-Mile "), text.title_case(part(3))))


def stamped(records: DataFrame, gone: DataFrame, key: str, now: Column) -> DataFrame:
    """delisted_at set for rows in `gone`; a stamp is neither overwritten nor cleared."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return records.join(marks, key, "left").withColumn("delisted_at", F.coalesce("delisted_at", F.when(F.col("_gone"), now))).drop("_gone")


def numbered_on(new: DataFrame, existing: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Numbers for new rows that go on after the largest of their key."""
    last = existing.groupBy(*key).agg(F.max("number").alias("_last"))
    return new.join(last, key, "left").withColumn("number", F.coalesce("_last", F.lit(0)) + F.row_number().over(Window.partitionBy(*key).orderBy(*order))).drop("_last")


def q_sticker_prices(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    word = lambda x, y, t: F.struct(F.lit(x).alias("x"), (F.lit(y) + F.col("p_size") % 3).cast("double").alias("y"), t.alias("text"))
    made = F.array(word(30.0, 100.0, F.concat(F.lit("$"), F.format_number("p_retailprice", 2))), word(10.0, 101.0, F.lit("TOTAL")), word(20.0, 102.0, F.lit("MSRP:")), word(10.0, 110.0, F.lit("$1")))
    words = part.select("p_partkey", F.explode(made).alias("w")).select("p_partkey", "w.*")
    found = lines(words, "p_partkey").select("p_partkey", price_after(F.col("words"), ["total", "msrp"]).alias("price"))
    return found.where("price IS NOT NULL")


def q_warranties(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_size").cast("string"), F.lit("YR/36,000 "), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", warranty(line).alias("warranty"))


def q_delist_stamp(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") == 1, "2020-01-01").alias("delisted_at"))
    gone = table(spark, d, "lineitem").where("l_quantity = 1").select(F.col("l_partkey").alias("p_partkey"))
    return stamped(part, gone, "p_partkey", F.lit("2024-06-01"))


def q_numbered_files(spark: SparkSession, d: str) -> DataFrame:
    """Events of a kind numbered on after those of another kind."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    first = e.where("event_type = 'view'").withColumn("number", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return numbered_on(e.where("event_type = 'click'").drop("event_type"), first, ["user_id"], ["event_id"]).select("user_id", "event_id", F.col("number").cast("long").alias("number"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

ORACLES = {
    "sticker_prices": "SELECT p_partkey, '$' || format('{:,.2f}', p_retailprice) AS price FROM part",
    "warranties": """WITH w AS (SELECT *, string_split(p_name, ' ') AS names FROM part)
        SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || '-Year / 36,000-Mile ' || array_to_string(list_transform(names, lambda x: upper(x[1]) || x[2:]), ' ') END AS warranty FROM w""",
    "delist_stamp": """SELECT p_partkey, CASE WHEN p_size = 1 THEN '2020-01-01' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1) THEN '2024-06-01' END AS delisted_at FROM part""",
    "numbered_files": """WITH v AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
        SELECT user_id, event_id, coalesce(n, 0) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number FROM events LEFT JOIN v USING (user_id) WHERE event_type = 'click'""",
}
