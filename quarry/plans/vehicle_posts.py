"""Vehicle records to post texts, and the note of what decided them.

Every text is one column expression over a record, so a fleet of any size is written in one map-only pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.plans import posts
from quarry.sources.tables import spread, table

#: The fields of a record that posts read.
RECORD = (
    "url string, vin string, stock_number string, year string, make string, model string, trim string, condition string, mileage bigint, title string, "
    "exterior_color_factory string, interior_color string, engine string, transmission string, drivetrain string, mpg_city string, mpg_highway string, body_type string, "
    "ev_battery_range string, ev_mpge_combined string, cab_style string, box_length string, display_price string, pricing_rows array<struct<label: string, text: string>>, "
    "dealer_description string, carfax_one_owner boolean, main_features array<string>, features_structured map<string, array<string>>, "
    "sticker struct<pricing: struct<total_msrp: string>, equipment: struct<exterior: array<string>, interior: array<string>, functional_tech: array<string>, safety_security: array<string>>, "
    "optional_equipment: array<string>, warranties: array<string>>"
)
#: Mileage below this isn't shown in short texts; generic tags; tags by condition; numbers of tags; equipment sections; the make whose sticker carries a link and warranties, and the link's form.
SHOWN_FROM = 100
GENERIC_TAGS = ("CarsForSale", "ForSale", "CarDealership")
CONDITION_TAGS = {"certified": "CertifiedPreOwned", "new": "NewCar", "other": "UsedCars"}
TAGS, SHORT_TAGS = 14, 6
SECTIONS = {"exterior": "Exterior", "interior": "Interior", "functional_tech": "Functional & Tech", "safety_security": "Safety & Security"}
STICKER_LINKS = {"ford": "http://v.ford.com/?v={vin}&c=1&s=1"}
WARRANTY_MAKES = ("ford",)


@dataclass(frozen=True)
class Dealer:
    """What a dealer puts into every post."""

    greeting: str
    address: str
    city_tags: tuple[str, ...] = ()


def read_vehicles(spark: SparkSession, path: str) -> DataFrame:
    """Vehicle records, one JSON document a file; fields that posts don't read are left out."""
    return spark.read.schema(RECORD).json(path, multiLine=True)


def _given(name: str) -> Column:
    return text.empty_to_null(F.col(name))


def _is_new() -> Column:
    return F.coalesce(F.lower(F.trim("condition")) == "new", F.lit(False))


def _made_by(makes: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.trim("make")).isin(*makes), F.lit(False))


def _amount(price: Column) -> Column:
    """The number in a price text; null if there's none."""
    return F.regexp_replace(price, "[$,]", "").try_cast("double")


def _whole(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 0))


def _msrp() -> Column:
    return text.empty_to_null(F.col("sticker.pricing.total_msrp"))


def _listed_msrp() -> Column:
    rows = F.filter("pricing_rows", lambda r: F.upper(F.trim(r["label"])) == "MSRP")
    return F.when(F.size(rows) > 0, F.struct(F.get(rows, F.lit(0))["text"].alias("text")))


def shown_price() -> Column:
    """New vehicles show the sticker's or the listed MSRP, all others the listed price."""
    listed = _listed_msrp()
    new = F.coalesce(_msrp(), F.when(listed.isNotNull(), F.coalesce(listed["text"], F.lit(""))), F.col("display_price"))
    price = text.empty_to_null(F.when(_is_new(), new).otherwise(F.col("display_price")))
    return F.when(price != "0", price)


def original_msrp() -> Column:
    """The sticker's price of a vehicle that isn't new, if it is above what is asked now."""
    msrp = _amount(_msrp())
    return F.when(~_is_new() & (msrp > _amount(shown_price())), _whole(F.bround(msrp)))


def price_text() -> Column:
    """Truncated to dollars; a text without a number stays as it is; null without a price."""
    price = shown_price()
    return F.coalesce(_whole(_amount(price).cast("long")), price)


def headline() -> Column:
    return F.trim(F.concat(F.when(_is_new(), "New ").otherwise(""), F.coalesce(_given("title"), F.lit("Vehicle"))))


def shown_mileage() -> Column:
    return F.when(F.col("mileage") >= SHOWN_FROM, F.format_number("mileage", 0))


def hook(longest: int = 125) -> Column:
    """Headline and price, and the mileage where that still fits."""
    line = F.concat_ws(" — ", headline(), price_text())
    with_miles = F.concat(line, F.lit(" — "), shown_mileage(), F.lit(" mi"))
    return F.when(F.length(with_miles) <= longest, with_miles).otherwise(line)


def tags(dealer: Dealer, limit: int = TAGS) -> Column:
    """From specific to broad: the model with and without trim and year, make, body, condition, places, generic ones."""
    make, model = _given("make"), _given("model")
    named = lambda *parts: F.when(make.isNotNull() & model.isNotNull(), _all(*parts))
    condition = F.lower(F.trim("condition"))
    state = F.when(condition.startswith("cert"), CONDITION_TAGS["certified"]).when(condition == "new", CONDITION_TAGS["new"]).when(condition != "", CONDITION_TAGS["other"])
    parts = [named(make, model), named(make, model, _given("trim")), named(_given("year"), make, model), make]
    made = [*map(text.hashtag, parts), posts.body_tag(text.empty_to_null(F.lower(F.trim("body_type"))))]
    made += [F.concat(F.lit("#"), state), *(text.hashtag(F.lit(t)) for t in (*dealer.city_tags, *GENERIC_TAGS))]
    return F.slice(F.array_distinct(F.array_compact(F.array(*made))), 1, limit)


def _all(*parts: Column) -> Column:
    """Joined by spaces; null if one is missing."""
    return F.concat(parts[0], *(F.concat(F.lit(" "), p) for p in parts[1:]))


def with_threads(records: DataFrame, dealer: Dealer, limit: int = posts.THREADS_LIMIT) -> DataFrame:
    """Records with threads. What each of its versions is made of comes first, so that it is made once."""
    miles = shown_mileage()
    facts = {
        "mileage": F.when(~hook().contains(F.concat(miles, F.lit(" mi"))), F.concat(miles, F.lit(" miles"))),
        "carfax": F.when(F.col("carfax_one_owner"), "CARFAX 1-Owner"),
        "color": _given("exterior_color_factory"),
        "engine": _given("engine"),
        "drivetrain": _given("drivetrain"),
        "vin": F.concat(F.lit("VIN "), _given("vin")),
        "stock": F.concat(F.lit("Stock #"), _given("stock_number")),
    }
    parts = F.struct(hook().alias("line"), tags(dealer, SHORT_TAGS).alias("tags"), *(c.alias(k) for k, c in facts.items()))
    # An array of one keeps the optimizer from writing the parts out wherever they are used.
    made = records.withColumn("_parts", F.explode(F.array(parts)))
    call = F.concat(F.lit(f"{dealer.greeting} "), text.city_state(F.lit(dealer.address)))
    of = F.col("_parts")
    return made.withColumn("threads", posts.trimmed(of["line"], {k: of[k] for k in facts}, call, of["tags"], limit)).drop("_parts")


def _labelled(label: str, value: Column, unit: str = "") -> Column:
    return F.concat(F.lit(f"{label}: "), value, F.lit(unit))


def _specs() -> list[Column]:
    mpg = text.empty_to_null(F.concat_ws("/", F.concat(_given("mpg_city"), F.lit(" city")), F.concat(_given("mpg_highway"), F.lit(" hwy"))))
    return [
        _labelled("Exterior", _given("exterior_color_factory")),
        _labelled("Interior", _given("interior_color")),
        _labelled("Engine", _given("engine")),
        _labelled("Transmission", _given("transmission")),
        _labelled("Drivetrain", _given("drivetrain")),
        F.coalesce(_labelled("MPG", mpg), _labelled("MPGe", _given("ev_mpge_combined"), " combined")),
    ]


def _block(*lines: Column) -> Column:
    return text.empty_to_null(F.concat_ws("\n", *lines))


def _end(*blocks: Column) -> Column:
    return F.concat(F.concat_ws("\n\n", *blocks), F.lit("\n"))


def instagram(dealer: Dealer) -> Column:
    detail = [_labelled("Mileage", shown_mileage(), " mi"), *_specs(), _labelled("EV range", _given("ev_battery_range"), " mi")]
    detail += [F.when(F.col("carfax_one_owner"), "CARFAX 1-Owner"), F.concat(F.lit("Stock #"), _given("stock_number"))]
    return _end(hook(), _block(*detail), F.lit(f"{dealer.greeting}\n{dealer.address}"), F.array_join(tags(dealer), " "))


def _listed(title: str, items: Column) -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{title}:\n"), lines))


def _sections() -> list[Column]:
    """Equipment by section from the sticker, else the site's features: each feature once, under its first heading."""
    equipment = F.col("sticker.equipment")
    has_sticker = F.coalesce(*(F.when(equipment[k].isNotNull(), True) for k in SECTIONS), F.lit(False))
    named = {title: equipment[k] for k, title in SECTIONS.items()} | {"Optional Equipment": F.col("sticker.optional_equipment")}
    none, seen, out = F.array().cast("array<string>"), F.array(F.lit("")), []
    for title, items in named.items():
        fresh = posts.fresh(F.coalesce(items, none), seen)
        seen = F.concat(seen, F.transform(F.coalesce(items, none), text.feature_key))
        out.append(F.when(has_sticker, _listed(title, fresh)))
    out.append(F.when(has_sticker & _made_by(WARRANTY_MAKES), _listed("Factory Warranties", F.col("sticker.warranties"))))
    own = F.when(F.size("main_features") > 0, F.col("main_features")).otherwise(F.flatten(F.map_values("features_structured")))
    out.append(F.when(~has_sticker, _listed("Features", posts.fresh(F.coalesce(own, none), F.array(F.lit(""))))))
    return out


def _has_sticker() -> Column:
    """Any part of it was read; an empty object is none."""
    return F.coalesce(*(F.when(F.col(f"sticker.{part}").isNotNull(), True) for part in ("pricing", "equipment", "optional_equipment", "warranties")), F.lit(False))


def _quoted(c: Column) -> Column:
    """In single quotes; in double ones if it has single ones alone."""
    escaped, single, double = F.replace(c, F.lit("\\"), F.lit("\\\\")), c.contains("'"), c.contains('"')
    within_single = F.replace(escaped, F.lit("'"), F.lit("\\'"))
    return F.when(single & ~double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), within_single, F.lit("'")))


def more_link() -> Column:
    """Of the maker, where its sticker was read."""
    make = F.lower(F.trim("make"))
    link = F.coalesce(*(F.when(make == m, F.replace(F.lit(form), F.lit("{vin}"), _given("vin"))) for m, form in STICKER_LINKS.items()))
    return F.when(_has_sticker(), link)


def _is_held_back() -> Column:
    """A new vehicle's price disclosure isn't posted."""
    return F.coalesce(_is_new() & posts.is_disclosure(F.col("dealer_description")), F.lit(False))


def facebook(dealer: Dealer) -> Column:
    top = F.concat_ws("\n", F.lit(dealer.greeting), headline(), F.lit(dealer.address))
    facts = [
        _labelled("Price", F.coalesce(price_text(), F.lit("Call for Price"))),
        _labelled("Original MSRP", original_msrp()),
        _labelled("Mileage", F.format_number("mileage", 0), " mi"),
        _labelled("VIN", _given("vin")),
        _labelled("Stock #", _given("stock_number")),
    ]
    specs = [*_specs(), _labelled("EV Range", _given("ev_battery_range"), " mi"), _labelled("Cab", _given("cab_style")), _labelled("Bed length", _given("box_length"))]
    description = F.when(~_is_held_back(), text.empty_to_null(F.regexp_replace("dealer_description", r"^\s+|\s+$", "")))
    return _end(top, _block(*facts), _block(*specs), description, *_sections(), F.when(F.col("carfax_one_owner"), "CARFAX 1-Owner"), _labelled("More details", more_link()))


def price_issues() -> Column:
    """What is odd about the prices, in words."""
    shown, last = _amount(F.regexp_replace("display_price", r"^\++", "")), F.element_at("pricing_rows", -1)
    listed = _amount(F.regexp_replace(last["text"], r"^\++", ""))
    differs = F.concat(
        F.lit("Pricing mismatch: display_price ("), _whole(F.bround(shown)), F.lit(") doesn't match the last pricing_rows entry "), _quoted(last["label"]), F.lit(" ("), _whole(F.bround(listed)), F.lit(").")
    )
    msrp, now = _amount(_msrp()), _amount(shown_price())
    low = F.concat(
        F.lit("Sticker MSRP ("), _whole(F.bround(msrp)), F.lit(") is not higher than the current listed price ("), _whole(F.bround(now)), F.lit(") -- unusual for a used/CPO vehicle, worth a manual check.")
    )
    return F.array_compact(F.array(F.when((F.size("pricing_rows") > 0) & (F.abs(shown - listed) > 1), differs), F.when(~_is_new() & (msrp <= now), low)))


def notes() -> Column:
    """Which conditions decided a record's posts."""
    source = F.when(~_is_new(), "site_display_price").when(_msrp().isNotNull(), "sticker_total_msrp")
    source = source.when(_listed_msrp().isNotNull(), "site_pricing_rows_msrp").otherwise("site_display_price_fallback")
    return F.struct(
        F.when(_is_new(), "new").otherwise("used_or_cpo").alias("condition_bucket"),
        source.alias("price_source"),
        (F.coalesce(F.size("sticker.warranties") > 0, F.lit(False)) & _made_by(WARRANTY_MAKES)).alias("factory_warranties_shown"),
        original_msrp().isNotNull().alias("original_msrp_comparison_shown"),
        _is_held_back().alias("incentive_description_suppressed"),
        more_link().alias("more_details_link"),
        price_issues().alias("pricing_consistency_issues"),
    )


def with_posts(records: DataFrame, dealer: Dealer) -> DataFrame:
    """Records with facebook, threads, instagram and notes."""
    return with_threads(records, dealer).select("*", facebook(dealer).alias("facebook"), instagram(dealer).alias("instagram"), notes().alias("notes"))


_DEALER = Dealer("Ask for us!", "12 Main St, Springfield, XY 12345", ("Springfield", "SpringfieldCars"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records."""
    made = {
        "vin": F.concat(F.lit("VIN"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")),
        "year": F.when(F.col("p_size") % 2 == 0, "2024"),
        "make": F.when(F.col("p_partkey") % 3 == 0, "Ford").otherwise("Other"),
        "model": F.element_at(F.split("p_name", " "), 1),
        "trim": F.when(F.col("p_size") % 3 == 0, F.col("p_type")),
        "condition": F.when(F.col("p_size") < 17, "New").when(F.col("p_size") < 34, "Used").otherwise("Certified Pre-Owned"),
        "mileage": (F.col("p_size") * F.col("p_size") * 7).cast("long"),
        "title": F.concat_ws(" ", "p_brand", "p_name"),
        "engine": F.when(F.col("p_size") % 5 > 0, F.col("p_type")),
        "display_price": F.when(F.col("p_partkey") % 10 != 3, F.concat(F.lit("$"), F.format_number("p_retailprice", 2))),
        "carfax_one_owner": F.col("p_size") % 7 == 0,
        "sticker": F.from_json(F.when(F.col("p_partkey") % 4 == 2, "{}").when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('{"pricing": {"total_msrp": "'), (F.col("p_size") * 50).cast("string"), F.lit('"}, "warranties": ["3 years"]}'))), _sticker_type()),
    }
    fields = [c.strip() for c in _split_fields(RECORD)]
    columns = [made.get(f.split(" ")[0], F.lit(None)).cast(f.split(" ", 1)[1]).alias(f.split(" ")[0]) for f in fields]
    return spread(table(spark, d, "part")).select(F.col("p_partkey").alias("id"), *columns)


def _split_fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def _sticker_type() -> str:
    return next(f.strip().split(" ", 1)[1] for f in _split_fields(RECORD) if f.strip().startswith("sticker "))


def q_vehicle_hook(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", hook(45).alias("hook"))


def q_vehicle_tags(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", F.array_join(tags(_DEALER, 8), " ").alias("tags"))


def q_vehicle_caption(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", instagram(Dealer(_DEALER.greeting, _DEALER.address)).alias("caption"))


def q_vehicle_facebook(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("id", facebook(_DEALER).alias("post"))


def q_vehicle_threads(spark: SparkSession, d: str) -> DataFrame:
    return with_threads(_records(spark, d), _DEALER, 120).select("id", F.col("threads").alias("post"))


def q_post_notes(spark: SparkSession, d: str) -> DataFrame:
    kept = ("condition_bucket", "price_source", "factory_warranties_shown", "original_msrp_comparison_shown", "more_details_link")
    own = _records(spark, d).select("id", notes().alias("n"))
    return own.select("id", *(F.col(f"n.{c}").alias(c) for c in kept), F.array_join("n.pricing_consistency_issues", "|").alias("issues"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SQL_RECORDS = """r AS (
    SELECT p_partkey AS id, 'VIN' || lpad(p_partkey::VARCHAR, 8, '0') AS vin, CASE WHEN p_size % 2 = 0 THEN '2024' END AS year, CASE WHEN p_partkey % 3 = 0 THEN 'Ford' ELSE 'Other' END AS make,
        split_part(p_name, ' ', 1) AS model, CASE WHEN p_size % 3 = 0 THEN p_type END AS trim, CASE WHEN p_size < 17 THEN 'New' WHEN p_size < 34 THEN 'Used' ELSE 'Certified Pre-Owned' END AS condition,
        p_size < 17 AS is_new, p_size * p_size * 7 AS mileage, p_brand || ' ' || p_name AS title, CASE WHEN p_size % 5 > 0 THEN p_type END AS engine,
        CASE WHEN p_partkey % 10 <> 3 THEN p_retailprice END AS price, p_size % 7 = 0 AS one_owner, CASE WHEN p_partkey % 4 = 0 THEN p_size * 50 END AS msrp, p_partkey % 4 = 0 AS sticker FROM part),
    s AS (SELECT *, CASE WHEN is_new THEN coalesce(msrp, price) ELSE price END AS shown, CASE WHEN is_new THEN 'New ' ELSE '' END || title AS head FROM r),
    t AS (SELECT *, '$' || format('{:,}', floor(shown)::BIGINT) AS money, CASE WHEN mileage >= 100 THEN format('{:,}', mileage::BIGINT) END AS miles FROM s),
    hooks AS (SELECT *, concat_ws(' — ', head, money) AS short, concat_ws(' — ', head, money) || ' — ' || miles || ' mi' AS long FROM t)"""
_SQL_LINK = "CASE WHEN sticker AND make = 'Ford' THEN 'http://v.ford.com/?v=' || vin || '&c=1&s=1' END"
_SQL_MSRP = "CASE WHEN NOT is_new AND msrp > shown THEN '$' || format('{:,}', msrp::BIGINT) END"
_SQL_WORD = "upper({0}[1]) || lower({0}[2:])"

ORACLES = {
    "vehicle_hook": f"WITH {_SQL_RECORDS} SELECT id, CASE WHEN length(long) <= 45 THEN long ELSE short END AS hook FROM hooks",
    "vehicle_caption": f"""WITH {_SQL_RECORDS} SELECT id, concat_ws(chr(10) || chr(10), CASE WHEN length(long) <= 125 THEN long ELSE short END,
            nullif(concat_ws(chr(10), 'Mileage: ' || miles || ' mi', 'Engine: ' || engine, CASE WHEN one_owner THEN 'CARFAX 1-Owner' END), ''), 'Ask for us!' || chr(10) || '12 Main St, Springfield, XY 12345',
            array_to_string(list_distinct_in_order, ' ')) || chr(10) AS caption
        FROM (SELECT *, list_filter(tags, lambda x, i: x IS NOT NULL AND list_position(tags, x) = i)[:14] AS list_distinct_in_order FROM (SELECT *, [
            '#' || make || model_word, '#' || make || model_word || trim_word, '#' || year || make || model_word, '#' || make,
            '#' || CASE WHEN condition LIKE 'Cert%' THEN 'CertifiedPreOwned' WHEN is_new THEN 'NewCar' ELSE 'UsedCars' END, '#CarsForSale', '#ForSale', '#CarDealership'] AS tags
            FROM (SELECT *, CASE WHEN upper(model) = model THEN model ELSE {_SQL_WORD.format('model')} END AS model_word, CASE WHEN upper(trim) = trim THEN trim ELSE {_SQL_WORD.format('trim')} END AS trim_word FROM hooks)))""",
    "vehicle_facebook": f"""WITH {_SQL_RECORDS} SELECT id, concat_ws(chr(10) || chr(10), concat_ws(chr(10), 'Ask for us!', head, '12 Main St, Springfield, XY 12345'),
            concat_ws(chr(10), 'Price: ' || coalesce(money, 'Call for Price'), 'Original MSRP: ' || {_SQL_MSRP}, 'Mileage: ' || format('{{:,}}', mileage::BIGINT) || ' mi', 'VIN: ' || vin),
            'Engine: ' || engine, CASE WHEN one_owner THEN 'CARFAX 1-Owner' END, 'More details: ' || {_SQL_LINK}) || chr(10) AS post FROM hooks""",
    "post_notes": f"""WITH {_SQL_RECORDS} SELECT id, CASE WHEN is_new THEN 'new' ELSE 'used_or_cpo' END AS condition_bucket,
            CASE WHEN NOT is_new THEN 'site_display_price' WHEN sticker THEN 'sticker_total_msrp' ELSE 'site_display_price_fallback' END AS price_source,
            sticker AND make = 'Ford' AS factory_warranties_shown, {_SQL_MSRP} IS NOT NULL AS original_msrp_comparison_shown, {_SQL_LINK} AS more_details_link,
            CASE WHEN NOT is_new AND msrp <= shown THEN 'Sticker MSRP ($' || format('{{:,}}', msrp::BIGINT) || ') is not higher than the current listed price ($' || format('{{:,}}', round_even(shown, 0)::BIGINT)
                || ') -- unusual for a used/CPO vehicle, worth a manual check.' ELSE '' END AS issues FROM t""",
}
