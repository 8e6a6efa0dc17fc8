import json

from pyspark.sql import functions as F

from quarry.plans import feed, normalize, stickers


def page(payload, name="window.vehicleData ="):
    return f"<html><script>{name} {json.dumps({'vdp_gtm_payload': payload})};</script></html>"


def vehicle(spark, html, url="http://d/vehicle/1HGCM82633A004352/x"):
    return normalize.admitted(normalize.vehicles(spark.createDataFrame([(url, html)], "url string, html string"))).first()


def test_fields_of_the_embedded_object(spark):
    v = vehicle(spark, page({
        "vin": "1hgcm82633a004352", "year": 2021, "make": "Ford", "model": "F-150", "trim": "", "used": True, "certifications": {"certifiedByManufacturer": False, "certifiedByDealer": True},
        "mileage": 12, "displayPrice": "0", "price": 25000, "specifications": {"mpgCityLow": "20", "mpgCityHigh": 20, "mpgHighwayLow": "0", "mpgHighwayHigh": "0", "transmission": " auto ", "vehicleType": []},
        "flattened_pricing": [{"pricing": {"Label": "MSRP", "Text": "$1"}}, {"pricing": {"Label": "", "Text": "$2"}}, {}], "dealerDescription": "a<br>b &amp; c", "features": {"mainFeatures": ["roof"], "featuresStructured": {"x": ["1 owner"]}},
        "location": {"address1": "1 Main St", "address2": None, "city": "Springfield", "state": "", "zipCode": 62701},
        "visual": {"combinedPhotos": [], "dealerPhotos": [{"source": "http://i/1x1/a"}, {"source": "http://i/2x2/a"}, {"source": ""}], "stockPhotos": [{"source": "http://i/1x1/a"}], "dealerVideos": [{"source": "v1"}, "v2"]},
        "expando": {"WindowStickerUrl": ""},
    }))
    assert (v.title, v.condition, v.mpg_city, v.mpg_highway, v.transmission, v.body_type) == ("2021 Ford F-150", "Certified Pre-Owned", "20", None, "auto", None)
    assert v.display_price is None and [tuple(r) for r in v.pricing_rows] == [("MSRP", "$1")]
    assert v.dealer_description == "a\nb & c" and v.dealer_address == "1 Main St, Springfield 62701" and v.carfax_one_owner
    assert v.photo_urls == ["http://i/2048x2048/a", "http://i/2048x2048/a"] and v.video_urls == ["v1", "v2"]
    assert v.warnings == ["no price", "no window sticker"] and v.quarantine is None


def test_pages_that_lack_it(spark):
    ld = '<script type="application/ld+json">{"@type": "Car", "name": "N", "vehicleIdentificationNumber": "1HGCM82633A004353", "image": "http://i/9x9/z"}</script>'
    v = vehicle(spark, ld)
    assert (v.title, v.photo_urls, v.quarantine) == ("N", ["http://i/2048x2048/z"], "vin differs from the url's")
    for html in (None, "", "window.vehicleData = {broken", page({}, "other =")):
        v = vehicle(spark, html)
        assert v.quarantine == "nothing found" and "no embedded data" in v.warnings
    assert vehicle(spark, page({"conditions_array": ["Gold", "Used"]})).condition == "Used"
    assert vehicle(spark, page({"vin": "x"}, "vdp_gtm_payload = ")).extractor == "data layer"


def test_sticker_words_and_prices(spark):
    markup = '<word xMin="10.5" yMin="100" xMax="1" yMax="2">Total</word>\n<word xMin="20" yMin="101">MSRP</word><word xMin="30" yMin="99.5">$54,770.00</word><word xMin="5" yMin="120">x</word>'
    words = spark.createDataFrame([(1, markup)], "id int, m string").select("id", F.explode(stickers.words_of(F.col("m"))).alias("w")).select("id", "w.*")
    rows = sorted(stickers.lines(words, "id").select("anchor", "words", stickers.price_after(F.col("words"), ["total", "msrp"]).alias("p")).collect())
    assert [(r.anchor, r.words, r.p) for r in rows] == [(99.5, ["Total", "MSRP", "$54,770.00"], "$54,770.00"), (120.0, ["x"], None)]


def test_stamps_stay(spark):
    records = spark.createDataFrame([("a", "old"), ("b", None), ("c", None)], "vin string, delisted_at string")
    gone = spark.createDataFrame([("a",), ("b",), ("b",)], "vin string")
    assert {tuple(r) for r in stickers.stamped(records, gone, "vin", F.lit("now")).fillna("").collect()} == {("a", "old"), ("b", "now"), ("c", "")}


def test_feed_of_pages(spark):
    html = page({"vin": "V1", "year": 2021, "make": "Ford", "used": True, "displayPrice": "$25,382.50", "visual": {"combinedPhotos": [{"source": f"http://i/1x1/{i}"} for i in range(30)]}})
    free = page({"vin": "V2", "price": 0, "visual": {"combinedPhotos": [{"source": "x"}]}})
    pages = spark.createDataFrame([("u", html), ("w", free), ("z", page({"vin": "V3", "price": 5}))], "url string, html string")
    rows = feed.full_feed(normalize.vehicles(pages).withColumn("delisted_at", F.lit(None).cast("string"))).collect()
    assert [(r.vehicle_id, r.title, r.price, r.state_of_vehicle, r["image[19].url"], r["trim"]) for r in rows] == [("V1", "2021 Ford", "25382", "used", "http://i/2048x2048/19", "")]
    assert len(rows[0]) == len(feed.FEED) + feed.IMAGES
