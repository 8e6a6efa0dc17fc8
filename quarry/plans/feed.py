"""The syndication feed, prices and page text. Parts stand for vehicles, their line items for photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import numbers, text
from quarry.sources.tables import table

IMAGES, DESCRIPTION = 20, 2000


def condition_state(condition: Column) -> Column:
    """The feed's state of a vehicle: new or used; certified and unknown ones count as used."""
    return F.when(F.lower(condition) == "new", "new").otherwise("used")


def feed_rows(vehicles: DataFrame) -> DataFrame:
    """vehicles: id, title, condition, display_price (text), description, photos, delisted_at. Delisted vehicles and those
    without a price or photos have no row."""
    price = text.empty_to_null(F.col("display_price"))
    live = vehicles.where(F.col("delisted_at").isNull() & numbers.truthy(price) & (F.size("photos") > 0))
    images = [F.get("photos", F.lit(i)).alias(f"image_{i + 1}") for i in range(IMAGES)]
    return live.select("id", "title", condition_state(F.col("condition")).alias("state"), numbers.bare_price(price).alias("price"), F.substring("description", 1, DESCRIPTION).alias("description"), *images)


#: The feed's columns, but for the images, each with the vehicle's field it comes from.
FEED = {
    "vehicle_id": "vin", "title": "title", "description": "dealer_description", "url": "url", "make": "make", "model": "model", "year": "year", "trim": "trim", "vin": "vin", "body_style": "body_type",
    "mileage.value": "mileage", "mileage.unit": None, "price": None, "currency": None, "state_of_vehicle": None, "availability": None, "exterior_color": None, "interior_color": "interior_color",
    "transmission": "transmission", "drivetrain": "drivetrain", "fuel_type": "fuel_type", "address": "dealer_address", "dealer_name": "dealer_name", "dealer_phone": "dealer_phone",
}


def full_feed(records: DataFrame) -> DataFrame:
    """Vehicle records (as pages give them, with delisted_at) in the feed's own columns, ready for `write_feed`. The id is the VIN,
    else the stock number, else the name of the record's folder (where records have one); a missing title is year, make and model."""
    live = records.where(F.col("delisted_at").isNull() & (F.size("photo_urls") > 0) & (numbers.bare_price(F.col("display_price")) != "0"))
    made = {
        "vehicle_id": F.coalesce(*(text.empty_to_null(F.col(c)) for c in ("vin", "stock_number", "folder") if c in records.columns)),
        "title": F.coalesce(text.empty_to_null(F.col("title")), F.trim(F.concat(*(F.coalesce(F.col(c).cast("string"), F.lit("")) if c != " " else F.lit(c) for c in ("year", " ", "make", " ", "model"))))), "description": F.substring("dealer_description", 1, DESCRIPTION), "mileage.unit": F.lit("MI"), "price": numbers.bare_price(F.col("display_price")),
        "currency": F.lit("USD"), "state_of_vehicle": condition_state(F.col("condition")), "availability": F.lit("in stock"), "exterior_color": F.coalesce(text.empty_to_null(F.col("exterior_color_generic")), F.col("exterior_color_factory")),
    }
    columns = [F.coalesce(made[c] if c in made else F.col(field).cast("string"), F.lit("")).alias(c) for c, field in FEED.items()]
    return live.select(*columns, *(F.coalesce(F.get("photo_urls", F.lit(i)), F.lit("")).alias(f"image[{i}].url") for i in range(IMAGES)))


def display_price(condition: Column, price: Column, sticker_msrp: Column, rows: Column) -> Column:
    """What a post shows: new vehicles at the sticker's or the listed MSRP."""
    listed = F.get(F.filter(rows, lambda r: F.upper(F.trim(r["label"])) == "MSRP"), F.lit(0))["text"]
    return F.when(condition == "New", F.coalesce(sticker_msrp, listed, price)).otherwise(price)


def original_msrp(condition: Column, price: Column, msrp: Column) -> Column:
    """For used vehicles an MSRP strictly above the price, as money text."""
    return F.when((condition != "New") & (msrp > price), F.concat(F.lit("$"), F.format_number(F.bround(msrp), 0)))


def vehicles(spark: SparkSession, d: str) -> DataFrame:
    """Parts as vehicles."""
    photos = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")))).alias("photos"))
    part = table(spark, d, "part")
    condition = F.when(F.col("p_size") < 17, "New").when(F.col("p_size") < 34, "Used").when(F.col("p_size") < 45, "Certified Pre-Owned")
    return part.join(photos, part.p_partkey == photos.l_partkey, "left").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_name").alias("title"), condition.alias("condition"),
        F.when(F.col("p_partkey") % 10 != 3, F.concat(F.lit("$"), F.format_number("p_retailprice", 2))).otherwise("").alias("display_price"),
        F.repeat("p_name", F.lit(3)).alias("description"), F.coalesce("photos", F.array().cast("array<string>")).alias("photos"),
        F.when(F.col("p_type") == "PROMO", "2024-01-01").alias("delisted_at"), "p_retailprice", "p_size", "p_brand", "p_name", "p_type",
    )


_SQL_VEHICLES = """vehicles AS (
    SELECT p_partkey AS id, p_brand || ' ' || p_name AS title,
        CASE WHEN p_size < 17 THEN 'New' WHEN p_size < 34 THEN 'Used' WHEN p_size < 45 THEN 'Certified Pre-Owned' END AS condition,
        p_retailprice AS price, p_partkey % 10 <> 3 AS priced, repeat(p_name, 3) AS description, coalesce(photos, []) AS photos,
        CASE WHEN p_type = 'PROMO' THEN '2024-01-01' END AS delisted_at
    FROM part LEFT JOIN (SELECT l_partkey, list_sort(list(DISTINCT 'p' || lpad(l_orderkey::VARCHAR, 8, '0'))) AS photos FROM lineitem GROUP BY 1) ON l_partkey = p_partkey)"""


def q_feed_rows(spark: SparkSession, d: str) -> DataFrame:
    return feed_rows(vehicles(spark, d))


def q_feed_columns(spark: SparkSession, d: str) -> DataFrame:
    """Parts as records, some without a VIN, a stock number or a title, in the feed's own columns."""
    key = F.col("id").cast("string")
    made = {
        "vin": F.when(F.col("id") % 5 != 0, F.concat(F.lit("V"), key)).otherwise(""), "stock_number": F.when(F.col("id") % 10 == 0, F.concat(F.lit("S"), key)), "folder": F.concat(F.lit("lot-"), key),
        "title": F.when(F.col("id") % 4 != 0, F.col("title")), "year": F.when(F.col("p_size") % 2 == 0, F.lit(2024)), "make": F.col("p_brand"), "model": F.when(F.col("p_size") % 3 == 0, F.col("p_name")),
        "condition": F.col("condition"), "display_price": F.col("display_price"), "dealer_description": F.col("description"), "photo_urls": F.col("photos"), "delisted_at": F.col("delisted_at"),
        "exterior_color_generic": F.when(F.col("p_size") % 2 == 0, "Red").otherwise(""), "exterior_color_factory": F.col("p_type"), "mileage": F.col("p_size"),
    }
    rest = {field: F.lit(None).cast("string") for field in FEED.values() if field and field not in made}
    rows = full_feed(vehicles(spark, d).select(*(c.alias(n) for n, c in (made | rest).items())))
    shown = {c: c.replace(".", "_").replace("[", "_").replace("]", "") for c in rows.columns}
    return rows.select(*(F.col(f"`{c}`").alias(n) for c, n in shown.items() if not n.startswith("image") or n in ("image_0_url", "image_19_url")))


def q_money_parse(spark: SparkSession, d: str) -> DataFrame:
    shown = F.concat(F.when(F.col("p_partkey") % 3 == 0, "+").otherwise(""), F.lit("$"), F.format_number("p_retailprice", 1))
    shown = F.when(F.col("p_partkey") % 7 == 0, "Call us").otherwise(shown)
    return table(spark, d, "part").select("p_partkey", numbers.bare_price(shown).alias("price"))


def q_display_price(spark: SparkSession, d: str) -> DataFrame:
    row = lambda label, t: F.struct(F.lit(label).alias("label"), t.alias("text"))
    rows = F.array(row("Dealer price", F.lit("x")), row(" msrp ", F.concat(F.lit("$"), F.col("p_size").cast("string"))))
    v = vehicles(spark, d).withColumn("rows", rows).withColumn("sticker", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("S"), F.col("p_size").cast("string"))))
    return v.select("id", display_price(F.coalesce("condition", F.lit("")), F.col("title"), F.col("sticker"), F.col("rows")).alias("shown"))


def q_msrp_comparison(spark: SparkSession, d: str) -> DataFrame:
    unit = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max(numbers.cents(F.col("l_extendedprice") / F.col("l_quantity"))).alias("msrp"))
    v = vehicles(spark, d)
    return v.join(unit, v.id == unit.l_partkey).select("id", original_msrp(F.coalesce("condition", F.lit("")), F.col("p_retailprice"), F.col("msrp")).alias("msrp"))


def q_condition_map(spark: SparkSession, d: str) -> DataFrame:
    status = F.col("o_orderstatus")
    label = F.when(status == "F", " Used").when(status == "O", "NEW").otherwise("unknown")
    return table(spark, d, "orders").groupBy(condition_state(label).alias("state")).agg(F.count(F.lit(1)).alias("n"))


def q_pricing_consistency(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_extendedprice", F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")).alias("last_row"))
    o = table(spark, d, "orders")
    return o.join(last, o.o_orderkey == last.l_orderkey).select("o_orderkey", (F.abs(F.col("o_totalprice") - F.col("last_row")) > 1).alias("differs"), (F.col("last_row") <= F.col("o_totalprice")).alias("msrp_not_above"))


def q_warnings_list(spark: SparkSession, d: str) -> DataFrame:
    checks = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "negative balance"), F.when(F.col("c_mktsegment") == "MACHINERY", "machinery"), F.when(F.col("c_nationkey") > 20, "far nation")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(checks, "; ").alias("warnings"))


_LINK = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'#]+)["']"""


def q_page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of all pages, without queries; each once, in the first page and place that has it."""
    from quarry.operators.keyed import first_seen

    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("pos", "href"))
    links = links.withColumn("link", text.url_without_query(F.col("href"))).drop("href")
    return first_seen(links, ["link"], ["page_id", "pos"]).select("link", "page_id", F.col("pos").cast("long").alias("pos"))


def q_url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.url_without_query(F.col("url")).alias("url"))


def q_dedup_key(spark: SparkSession, d: str) -> DataFrame:
    vin = F.when(F.col("page_id") % 3 == 0, F.concat(text.url_without_query(F.col("url")), F.lit("/1hgcm82633a"), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit("/")))
    return table(spark, d, "pages").select("page_id", text.dedup_key(F.coalesce(vin, F.col("url"))).alias("key"))


def q_path_segment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.segment_after(F.col("url"), "en").alias("segment"), text.url_path(F.col("url")).alias("path"))


def q_detail_url_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(text.is_detail_url(F.col("url"), "en").alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def q_html_to_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.tidy_text(F.col("html")).alias("text"))


def q_balanced_json(spark: SparkSession, d: str) -> DataFrame:
    blob = F.concat(F.lit("<script>var data = "), F.col("props"), F.lit('; var other = {"a": "}"};</script>'))
    found = text.balanced_json(blob, "var data =")
    return table(spark, d, "events").select("event_id", F.get_json_object(found, "$.k").cast("long").alias("k"))


def q_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count_if(k > 50).alias("large"))


def q_unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    keys = F.json_object_keys("props")
    return table(spark, d, "events").select("event_id", F.size(F.array_except(keys, F.array(F.lit("v")))).cast("long").alias("unknown"))


def q_slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("slug"))


def q_feature_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(text.feature_key(F.concat_ws(" / ", "p_name", "p_brand")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


def q_title_case(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", text.title_case(F.concat_ws("-", "p_name", F.lower("p_type"))).alias("title"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SQL_URL = r"regexp_replace(regexp_replace({0}, '[?#].*$', ''), '/+$', '')"
_SQL_PATH = r"regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"

ORACLES = {
    "feed_rows": f"""WITH {_SQL_VEHICLES}
        SELECT id, title, CASE lower(condition) WHEN 'new' THEN 'new' ELSE 'used' END AS state,
            round_even(round(price, 2), 0)::BIGINT::VARCHAR AS price, left(description, 2000) AS description, {', '.join(f"photos[{i}] AS image_{i}" for i in range(1, 21))}
        FROM vehicles WHERE delisted_at IS NULL AND priced AND price <> 0 AND len(photos) > 0""",
    "feed_columns": f"""WITH {_SQL_VEHICLES}
        SELECT CASE WHEN id % 5 <> 0 THEN 'V' || id WHEN id % 10 = 0 THEN 'S' || id ELSE 'lot-' || id END AS vehicle_id,
            CASE WHEN id % 4 <> 0 THEN title ELSE trim(CASE WHEN p_size % 2 = 0 THEN '2024' ELSE '' END || ' ' || p_brand || ' ' || CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END) END AS title,
            left(description, 2000) AS description, '' AS url, p_brand AS make, CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END AS model, CASE WHEN p_size % 2 = 0 THEN '2024' ELSE '' END AS year, '' AS trim,
            CASE WHEN id % 5 <> 0 THEN 'V' || id ELSE '' END AS vin, '' AS body_style, p_size::VARCHAR AS mileage_value, 'MI' AS mileage_unit, round_even(round(price, 2), 0)::BIGINT::VARCHAR AS price, 'USD' AS currency,
            CASE lower(condition) WHEN 'new' THEN 'new' ELSE 'used' END AS state_of_vehicle, 'in stock' AS availability, CASE WHEN p_size % 2 = 0 THEN 'Red' ELSE p_type END AS exterior_color, '' AS interior_color,
            '' AS transmission, '' AS drivetrain, '' AS fuel_type, '' AS address, '' AS dealer_name, '' AS dealer_phone, coalesce(photos[1], '') AS image_0_url, coalesce(photos[20], '') AS image_19_url
        FROM vehicles JOIN part ON id = p_partkey WHERE delisted_at IS NULL AND priced AND price <> 0 AND len(photos) > 0""",
    "money_parse": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN round_even(round(p_retailprice, 1), 0)::BIGINT::VARCHAR END AS price FROM part",
    "display_price": f"""WITH {_SQL_VEHICLES}
        SELECT id, CASE WHEN p_size < 17 THEN CASE WHEN p_size % 2 = 0 THEN 'S' ELSE '$' END || p_size ELSE title END AS shown FROM vehicles JOIN part ON id = p_partkey""",
    "msrp_comparison": f"""WITH {_SQL_VEHICLES}
        SELECT id, CASE WHEN coalesce(condition, '') <> 'New' AND msrp > price THEN '$' || format('{{:,}}', round_even(msrp, 0)::BIGINT) END AS msrp
        FROM vehicles JOIN (SELECT l_partkey, max(round(l_extendedprice / l_quantity, 2)) AS msrp FROM lineitem GROUP BY 1) ON l_partkey = id""",
    "condition_map": "SELECT CASE o_orderstatus WHEN 'O' THEN 'new' ELSE 'used' END AS state, count(*) AS n FROM orders GROUP BY 1",
    "pricing_consistency": """SELECT o_orderkey, abs(o_totalprice - last_row) > 1 AS differs, last_row <= o_totalprice AS msrp_not_above
        FROM orders JOIN (SELECT l_orderkey, l_extendedprice AS last_row FROM lineitem
            QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1) ON l_orderkey = o_orderkey""",
    "warnings_list": """SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machinery' END,
        CASE WHEN c_nationkey > 20 THEN 'far nation' END) AS warnings FROM customer""",
    "page_links": f"""WITH found AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*href\\s*=\\s*["'']([^"''#]+)["'']', 1) AS hrefs FROM pages),
        placed AS (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) - 1 AS pos FROM found)
        SELECT {_SQL_URL.format('href')} AS link, page_id, pos FROM placed QUALIFY row_number() OVER (PARTITION BY link ORDER BY page_id, pos) = 1""",
    "url_normalize": f"SELECT page_id, {_SQL_URL.format('url')} AS url FROM pages",
    "dedup_key": f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'vin:1HGCM82633A' || lpad(page_id::VARCHAR, 6, '0') ELSE 'url:' || {_SQL_URL.format('url')} END AS key FROM pages""",
    "path_segment": f"""WITH p AS (SELECT page_id, {_SQL_PATH.format('url')} AS path FROM pages),
        s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p),
        found AS (SELECT *, coalesce(list_position(list_transform(parts, lambda x: lower(x)), 'en'), 0) AS i FROM s)
        SELECT page_id, CASE WHEN i > 0 AND i + 1 < len(parts) THEN parts[i + 1] END AS segment, path FROM found""",
    "detail_url_flag": f"SELECT contains({_SQL_PATH.format('url')}, '/en/') AS detail, count(*) AS n FROM pages GROUP BY 1",
    "balanced_json": "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events",
    "json_props": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(*) FILTER ((props->>'$.k')::BIGINT > 50) AS large FROM events GROUP BY 1",
    "unknown_keys": "SELECT event_id, len(list_filter(json_keys(props), lambda x: x <> 'v'))::BIGINT AS unknown FROM events",
    "slugify": "SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' ' || p_brand || ' ' || p_type, '[^A-Za-z0-9_ -]', '', 'g'), '[ _]+', '-', 'g') AS slug FROM part",
    "feature_key": "SELECT trim(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS feature, count(*) AS n FROM part GROUP BY 1",
    "title_case": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS names, lower(p_type) AS kind FROM part)
        SELECT p_partkey, array_to_string(list_transform(names, lambda x: upper(x[1]) || x[2:]), ' ') || '-' || upper(kind[1]) || kind[2:] AS title FROM w""",
}
