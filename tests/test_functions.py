import pytest
from pyspark.sql import functions as F

from quarry.functions import numbers, text
from quarry.plans import feed, photos, posts


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r[0] for r in df.select(column(F.col("c")).alias("x"), "i").orderBy("i").collect()]


@pytest.mark.parametrize(
    ("column", "cases"),
    [
        (text.url_without_query, {"http://a/b/?x=1#y": "http://a/b", "http://a/b//": "http://a/b", "": "", None: None}),
        (text.segment_after, {"http://a/used/Vehicle/1HGCM/x/": "1HGCM", "http://a/vehicle/last": None, "http://a/b": None, "not a url": None}),
        (text.dedup_key, {"http://a/vehicle/1hgcm82633a004352/x?y": "vin:1HGCM82633A004352", "http://a/x/?q": "url:http://a/x"}),
        (text.is_detail_url, {"http://a/vehicle/x": True, "http://a/vehicles/x": False}),
        (text.feature_key, {" Heated -- Seats! ": "heated seats", "": ""}),
        (text.hashtag, {"F-150": "#F150", "ford": "#ford", "crew cab XLT": "#CrewCabXLT", "a" * 29: None, "!!": None}),
        (text.city_state, {"1 Main St, Springfield, IL 62701": "Springfield, IL", "Springfield, IL": "Springfield, IL", "Springfield": "Springfield"}),
        (text.tidy_text, {"a<br/>b <b>c</b> &amp;  d": "a\nb c & d", "&lt;b&gt;": "<b>", "x\n\n\n\ny": "x\n\ny", " ": None, None: None}),
        (text.title_case, {"2ND ROW AM/FM-LED": "2Nd Row Am/Fm-Led"}),
        (text.slug, {"Café  au_lait!": "Cafe-au-lait", "": "vehicle", "x" * 90: "x" * 80, None: None, "\u00e9\u00fc \ufb01n": "eu-fin", " _a - b__c_ ": "a---b-c", "\u4e2d\u6587": "vehicle", "--a\x1cb--": "a-b"}),
        (text.image_url_upsized, {"http://a/640x480/b/10x10/": "http://a/2048x2048/b/2048x2048/"}),
        (numbers.bare_price, {"$25,382": "25382", "+2.5": "2", "3.5": "4", "Call": None, "": None}),
        (numbers.truthy, {"0": False, "0.0": False, "1": True, "x": True, "": False, "NaN": True}),
        (feed.condition_state, {"New": "new", "CERTIFIED PRE-OWNED": "used", "odd": "used", None: "used"}),
        (posts.body_tag, {"Crew Cab Pickup": "#Truck", "Cargo Van": "#WorkVan", "Dune Buggy": "#DuneBuggy"}),
        (posts.is_disclosure, {"Price includes $500": True, "a $500 wheel": False, "rebate": False}),
    ],
)
def test_columns(spark, column, cases):
    assert values(spark, column, list(cases)) == list(cases.values())


def test_balanced_json_ends_at_its_own_brace(spark):
    rows = ['x data = {"a": "}{", "b": {"c": "\\"}"}}; {', "x data = {oops}", "none", None, 'data = {"a": {']
    assert values(spark, lambda c: text.balanced_json(c, "data ="), rows) == ['{"a": "}{", "b": {"c": "\\"}"}}', None, None, None, None]


def test_money_is_truncated_in_posts(spark):
    df = spark.createDataFrame([(1999.99,), (None,)], "p double")
    assert {r[0] for r in df.select(posts.money_phrase(F.col("p"))).collect()} == {"$1,999", "Call for Price"}


def test_short_post_drops_facts_before_tags(spark):
    facts = {"mileage": F.lit("m" * 20), "stock": F.lit("s" * 20), "vin": F.lit(None).cast("string")}
    tags = F.array(F.lit("#a"), F.lit("#b"))
    made = lambda limit: spark.range(1).select(posts.trimmed(F.lit("head line"), facts, F.lit("go"), tags, limit)).first()[0]
    assert made(500) == "head line\n\n" + "m" * 20 + " · " + "s" * 20 + "\n\ngo\n\n#a #b\n"
    assert made(45) == "head line\n\n" + "m" * 20 + "\n\ngo\n\n#a #b\n"
    assert made(22) == "head line\n\ngo\n\n#a #b\n"
    assert made(17) == "head line\n\ngo\n\n#a\n"
    assert made(6) == "head\n"


def test_search_compiles_to_predicates(spark):
    s = posts.Search("XLT F-150 with moonroof and heated seats, no leather seats")
    assert s.models == ["xlt", "f-150"]
    assert s.wanted == [posts.CONCEPTS["moonroof"], posts.CONCEPTS["heated seats"]]
    assert s.unwanted == ["leather"]
    rows = [(1, "ford f-150 xlt", "moonroof heated seat"), (2, "ford f-150 xlt", "moonroof heated seat leather"), (3, "ford f-250 xlt", "moonroof heated seat"), (4, "ford f-150 xlt", None)]
    df = spark.createDataFrame(rows, "id int, model string, equipment string")
    assert [r.id for r in df.where(s.column(F.col("model"), F.col("equipment"))).collect()] == [1]
    assert df.where(posts.Search("").column(F.col("model"), F.col("equipment"))).count() == 4


def test_verdicts(spark):
    rows = [("interior", "exterior_body", 0.65, None, "x"), ("interior", "exterior_body", 0.6, None, "x"), ("marketing", "", 0.0, None, "exterior"), ("marketing", "", 0.0, 0.02, "detail"), ("exterior", "", 0.0, 0.0, "")]
    df = spark.createDataFrame(rows, "scene string, t string, c double, m double, b string")
    got = [tuple(r[0]) for r in df.select(photos.verdict(*(F.col(x) for x in ("scene", "t", "c", "m", "b")))).collect()]
    assert got == [("exterior", True, "tiebreak"), ("interior", False, "label"), ("marketing", False, "no_subject"), ("exterior", False, "subject"), ("exterior", True, "label")]


def test_cents_round_the_double_and_not_its_text(spark):
    assert values(spark, lambda c: numbers.cents(c.cast("double")), ["1.005", "2.675", "1.125", "-1.125", "10.1", None]) == [1.0, 2.68, 1.13, -1.13, 10.1, None]
