"""Pages to vehicles: the embedded data object, schema.org data where it is missing, and what is derived.

The object is cut out of the page by an Arrow UDF (its end needs brace counting); everything after it is one
projection over a typed parse. Leaves that sites write as text or as number are read as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import numbers, text
from quarry.sources.tables import spread, table

#: The keys of the embedded object that are read.
PAYLOAD = """struct<vin:string,stockNumber:string,year:string,make:string,model:string,trim:string,used:boolean,conditions_array:array<string>,
    certifications:struct<certifiedByManufacturer:boolean,certifiedByDealer:boolean>,vehicleStatus:string,mileage:bigint,displayPrice:string,price:string,
    evBatteryRange:string,evMpgCombined:string,cabStyle:string,boxLength:string,dealerDescription:string,dealerComments:string,tags:array<string>,
    specifications:struct<engine:string,transmission_new:string,transmission:string,drivetrain:string,fuelType:string,mpgCityLow:string,mpgCityHigh:string,mpgHighwayLow:string,mpgHighwayHigh:string,vehicleType:array<string>>,
    flattened_pricing:array<struct<pricing:struct<Label:string,Text:string>>>,
    features:struct<mainFeatures:array<string>,featuresStructured:map<string,array<string>>>,
    location:struct<name:string,address1:string,address2:string,city:string,state:string,zipCode:string,contactNumber:string>,
    visual:struct<colors:struct<exterior:struct<factory:string,generic:string>,interior:struct<factory:string>>,image:struct<source:string>,
        combinedPhotos:array<struct<source:string>>,dealerPhotos:array<struct<source:string>>,stockPhotos:array<struct<source:string>>,dealerVideos:array<string>>,
    expando:struct<WindowStickerUrl:string>>"""
LINKED = "struct<`@type`:string,vehicleIdentificationNumber:string,name:string,color:string,fuelType:string,bodyType:string,description:string,image:string,vehicleEngine:struct<name:string>>"
EXTRACTORS = [("vehicle data", "window.vehicleData ="), ("data layer", "vdp_gtm_payload = ")]
ONE_OWNER = r"(?i)\b1[\s-]*owner\b"


def condition(p: Column) -> Column:
    """From flags; only without them from the list of badges, which mixes conditions and marketing."""
    certified = F.coalesce(p["certifications"]["certifiedByManufacturer"], F.lit(False)) | F.coalesce(p["certifications"]["certifiedByDealer"], F.lit(False))
    return F.when(p["used"], F.when(certified, "Certified Pre-Owned").otherwise("Used")).when(~p["used"], "New").otherwise(F.try_element_at(p["conditions_array"], F.lit(-1)))


def mpg(low: Column, high: Column) -> Column:
    """Null if neither is rated; one number if they are equal."""
    rated = F.coalesce(numbers.truthy(low), F.lit(False)) | F.coalesce(numbers.truthy(high), F.lit(False))
    return F.when(rated, F.when(low.eqNullSafe(high), low).otherwise(F.concat(F.coalesce(low, F.lit("")), F.lit("-"), F.coalesce(high, F.lit("")))))


def address(where: Column) -> Column:
    city = text.empty_to_null(F.trim(F.concat_ws(" ", text.empty_to_null(F.concat_ws(", ", text.empty_to_null(where["city"]), text.empty_to_null(where["state"]))), text.empty_to_null(where["zipCode"]))))
    return text.empty_to_null(F.concat_ws(", ", text.empty_to_null(where["address1"]), text.empty_to_null(where["address2"]), city))


def photos(visual: Column, fallback: Column) -> Column:
    """Distinct by source in order, then at full size; one picture of the page where there are none."""
    none = F.array().cast("array<struct<source:string>>")
    combined = F.coalesce(visual["combinedPhotos"], none)
    listed = F.when(F.size(combined) > 0, combined).otherwise(F.concat(F.coalesce(visual["dealerPhotos"], none), F.coalesce(visual["stockPhotos"], none)))
    sources = F.array_distinct(F.filter(F.transform(listed, lambda x: x["source"]), lambda s: s != ""))
    one = F.array_compact(F.array(F.coalesce(text.empty_to_null(visual["image"]["source"]), fallback)))
    return F.transform(F.when(F.size(sources) > 0, sources).otherwise(one), text.image_url_upsized)


def linked_data(html: Column) -> Column:
    """The first schema.org node of a vehicle, alone or in a graph."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    graph = F.flatten(F.transform(scripts, lambda s: F.coalesce(F.from_json(F.get_json_object(s, "$.@graph"), f"array<{LINKED}>"), F.array(F.from_json(s, LINKED)))))
    return F.get(F.filter(graph, lambda n: n["@type"].isin("Car", "Vehicle")), F.lit(0))


def vehicles(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """One vehicle per page (url, html), with warnings about what the page lacks."""
    blob, name = text.first_extracted(F.col(html), EXTRACTORS)
    parsed = pages.select(F.col(url).alias("url"), F.col(html).alias("html"), blob.alias("blob"), name.alias("extractor"))
    payload = F.coalesce(F.get_json_object("blob", "$.vdp_gtm_payload"), F.col("blob"))
    parsed = parsed.select("url", "html", "extractor", F.from_json(payload, PAYLOAD).alias("p"), linked_data(F.col("html")).alias("l"))
    p, linked, none = F.col("p"), F.col("l"), F.array().cast("array<string>")
    some = text.empty_to_null
    specs, price = p["specifications"], F.coalesce(some(p["displayPrice"]), some(p["price"]))
    main = F.coalesce(p["features"]["mainFeatures"], none)
    structured = F.coalesce(F.flatten(F.map_values(p["features"]["featuresStructured"])), none)
    rows = F.filter(F.transform(F.coalesce(p["flattened_pricing"], F.array().cast("array<struct<pricing:struct<Label:string,Text:string>>>")), lambda r: F.struct(r["pricing"]["Label"].alias("label"), r["pricing"]["Text"].alias("text"))), lambda r: (r["label"] != "") & (r["text"] != ""))
    title = some(F.concat_ws(" ", some(p["year"]), some(p["make"]), some(p["model"]), some(p["trim"])))
    out = parsed.select(
        "url", "extractor", F.coalesce(some(p["vin"]), linked["vehicleIdentificationNumber"]).alias("vin"), p["stockNumber"].alias("stock_number"),
        *(some(p[c]).alias(c) for c in ("year", "make", "model", "trim")), condition(p).alias("condition"), p["vehicleStatus"].alias("vehicle_status"), p["mileage"].alias("mileage"),
        F.coalesce(title, linked["name"]).alias("title"), F.coalesce(some(p["visual"]["colors"]["exterior"]["factory"]), linked["color"]).alias("exterior_color_factory"),
        p["visual"]["colors"]["exterior"]["generic"].alias("exterior_color_generic"), p["visual"]["colors"]["interior"]["factory"].alias("interior_color"),
        F.coalesce(some(specs["engine"]), linked["vehicleEngine"]["name"]).alias("engine"), F.trim(F.coalesce(some(specs["transmission_new"]), specs["transmission"])).alias("transmission"),
        specs["drivetrain"].alias("drivetrain"), F.coalesce(some(specs["fuelType"]), linked["fuelType"]).alias("fuel_type"),
        mpg(specs["mpgCityLow"], specs["mpgCityHigh"]).alias("mpg_city"), mpg(specs["mpgHighwayLow"], specs["mpgHighwayHigh"]).alias("mpg_highway"),
        F.coalesce(some(F.array_join(specs["vehicleType"], ", ")), linked["bodyType"]).alias("body_type"), p["evBatteryRange"].alias("ev_battery_range"), p["evMpgCombined"].alias("ev_mpge_combined"),
        some(p["cabStyle"]).alias("cab_style"), p["boxLength"].alias("box_length"), F.when(numbers.truthy(price), price).alias("display_price"), rows.alias("pricing_rows"),
        text.tidy_text(F.coalesce(some(p["dealerDescription"]), linked["description"])).alias("dealer_description"), text.tidy_text(p["dealerComments"]).alias("dealer_comments"),
        main.alias("main_features"), p["features"]["featuresStructured"].alias("features_structured"), F.coalesce(p["tags"], none).alias("tags"),
        p["location"]["name"].alias("dealer_name"), address(p["location"]).alias("dealer_address"), p["location"]["contactNumber"].alias("dealer_phone"),
        photos(p["visual"], linked["image"]).alias("photo_urls"),
        F.coalesce(F.transform(p["visual"]["dealerVideos"], lambda v: F.coalesce(F.get_json_object(v, "$.source"), v)), none).alias("video_urls"), some(p["expando"]["WindowStickerUrl"]).alias("window_sticker_url"),
        some(F.regexp_extract("html", r'href="(https?://[^"]*carfax[^"]*)"', 1)).alias("carfax_url"), F.exists(F.concat(main, structured), lambda x: x.rlike(ONE_OWNER)).alias("carfax_one_owner"),
    )
    lacks = [("extractor", "no embedded data"), ("display_price", "no price"), ("window_sticker_url", "no window sticker")]
    checks = [F.when(F.col(c).isNull(), F.lit(w)) for c, w in lacks] + [F.when(F.size("photo_urls") == 0, F.lit("no photos"))]
    return out.withColumn("warnings", F.array_compact(F.array(*checks)))


def admitted(rows: DataFrame) -> DataFrame:
    """Adds quarantine: why a vehicle isn't taken on (its VIN isn't the URL's, or it has neither VIN, price nor photos)."""
    other = F.upper("vin") != F.upper(text.vin_in_path(F.col("url")))
    empty = F.col("vin").isNull() & F.col("display_price").isNull() & (F.size("photo_urls") == 0)
    return rows.withColumn("quarantine", F.when(other, "vin differs from the url's").when(empty, "nothing found"))


def stand_in_pages(spark: SparkSession, d: str) -> DataFrame:
    """Vehicle pages made of parts: an embedded object in most, schema.org data in some."""
    part = spread(table(spark, d, "part"))
    vin = F.concat(F.lit("1HGCM82633A"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"))
    photo = lambda i: F.struct(F.concat(F.lit("http://img/640x480/"), (F.col("p_size") % i).cast("string"), F.lit(".jpg")).alias("source"))
    blob = F.to_json(F.struct(
        vin.alias("vin"), F.lit(2020).alias("year"), F.col("p_brand").alias("make"), F.col("p_name").alias("model"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") % 3 == 1).alias("used"),
        F.struct((F.col("p_size") % 2 == 0).alias("certifiedByDealer")).alias("certifications"), F.array(F.lit("Gold"), F.lit("Demo")).alias("conditions_array"), F.col("p_retailprice").cast("int").alias("displayPrice"),
        F.struct(F.lit("0").alias("mpgCityLow"), (F.col("p_size") % 4).cast("string").alias("mpgCityHigh"), F.array(F.lit("SUV"), F.col("p_type")).alias("vehicleType")).alias("specifications"),
        F.struct(F.array(photo(2), photo(3)).alias("dealerPhotos"), F.array(photo(2)).alias("stockPhotos")).alias("visual"),
        F.struct(F.array(F.when(F.col("p_size") % 5 == 0, "1-Owner").otherwise("roof {open}")).alias("mainFeatures")).alias("features"),
        F.struct(F.lit("1 Main St").alias("address1"), F.lit("Springfield").alias("city"), F.lit("IL").alias("state"), F.lit("62701").alias("zipCode")).alias("location"),
    ))
    with_blob = F.concat(F.lit("<script>window.vehicleData = {\"vdp_gtm_payload\": "), blob, F.lit("};</script>"))
    linked = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": "Car", "name": "'), F.col("p_name"), F.lit('", "vehicleIdentificationNumber": "'), vin, F.lit('"}]}</script>'))
    url = F.concat(F.lit("http://dealer.example/vehicle/"), F.when(F.col("p_partkey") % 11 == 0, "2HGCM82633A000000").otherwise(vin), F.lit("/x"))
    return part.select("p_partkey", url.alias("url"), F.when(F.col("p_partkey") % 7 > 0, with_blob).otherwise(linked).alias("html"))


def q_page_to_vehicle(spark: SparkSession, d: str) -> DataFrame:
    v = admitted(vehicles(stand_in_pages(spark, d)))
    return v.select("vin", "title", "condition", "mpg_city", "body_type", "display_price", F.array_join("photo_urls", " ").alias("photos"), "carfax_one_owner", "dealer_address", F.array_join("warnings", "; ").alias("warnings"), "quarantine")


QUERIES = {"page_to_vehicle": q_page_to_vehicle}

ORACLES = {
    "page_to_vehicle": """WITH b AS (SELECT *, p_partkey % 7 > 0 AS blob, '1HGCM82633A' || lpad(p_partkey::VARCHAR, 6, '0') AS vin FROM part)
        SELECT vin, CASE WHEN blob THEN '2020 ' || p_brand || ' ' || p_name ELSE p_name END AS title,
            CASE WHEN NOT blob THEN NULL WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 2 = 0 THEN 'Certified Pre-Owned' ELSE 'Used' END WHEN p_size % 3 = 2 THEN 'New' ELSE 'Demo' END AS condition,
            CASE WHEN blob AND p_size % 4 > 0 THEN '0-' || (p_size % 4) END AS mpg_city, CASE WHEN blob THEN 'SUV, ' || p_type END AS body_type,
            CASE WHEN blob THEN trunc(p_retailprice)::INT::VARCHAR END AS display_price,
            CASE WHEN blob THEN 'http://img/2048x2048/' || (p_size % 2) || '.jpg' || CASE WHEN p_size % 2 <> p_size % 3 THEN ' http://img/2048x2048/' || (p_size % 3) || '.jpg' ELSE '' END ELSE '' END AS photos,
            blob AND p_size % 5 = 0 AS carfax_one_owner, CASE WHEN blob THEN '1 Main St, Springfield, IL 62701' END AS dealer_address,
            CASE WHEN blob THEN 'no window sticker' ELSE 'no embedded data; no price; no window sticker; no photos' END AS warnings,
            CASE WHEN p_partkey % 11 = 0 THEN 'vin differs from the url''s' END AS quarantine
        FROM b""",
}
