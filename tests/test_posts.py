"""Posts of records with all fields, and of those whose sticker is an empty object."""

import json

import pytest

from quarry.plans import vehicle_posts

DEALER = vehicle_posts.Dealer("Ask for us!", "12 Main St, Springfield, XY 12345", ("Springfield",))
FULL = {
    "vin": "1FTFW1E50PFA00001", "year": "2023", "make": "Ford", "model": "F-150", "trim": "XLT", "condition": "Used", "mileage": 12345, "title": "2023 Ford F-150 XLT", "stock_number": "S1",
    "engine": "3.5L V6", "display_price": "$45,000", "pricing_rows": [{"label": "Dealer's Price", "text": "$44,000"}], "dealer_description": "  One fine truck.  ", "carfax_one_owner": True,
    "main_features": ["Unused here"], "sticker": {
        "pricing": {"total_msrp": "$60,500"}, "equipment": {"exterior": ["Tow Hooks", "tow hooks"], "interior": ["Tow-Hooks", "Heated Seats"]},
        "optional_equipment": ["Bed Liner"], "warranties": ["3-Year / 36,000-Mile Bumper to Bumper"],
    },
}


@pytest.fixture(scope="module")
def posts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    made = {
        "full": FULL,
        "empty": FULL | {"vin": "EMPTY", "sticker": {}},
        "none": {k: v for k, v in FULL.items() if k != "sticker"} | {"vin": "NONE", "pricing_rows": [{"label": 'a "b" \'c\'', "text": "$1"}]},
    }
    for name, record in made.items():
        (folder / f"{name}.json").write_text(json.dumps(record))
    return {r.vin: r for r in vehicle_posts.with_posts(vehicle_posts.read_vehicles(spark, str(folder)), DEALER).collect()}


def test_sticker_sections_name_each_feature_once(posts):
    post = posts[FULL["vin"]].facebook
    for said in ("Price: $45,000", "Original MSRP: $60,500", "Mileage: 12,345 mi", "VIN: 1FTFW1E50PFA00001", "Stock #: S1", "One fine truck.", "CARFAX 1-Owner", "3-Year / 36,000-Mile", "Bed Liner", "Heated Seats"):
        assert said in post
    assert post.lower().replace("-", " ").count("tow hooks") == 1
    assert "Unused here" not in post and "More details: http://v.ford.com/?v=1FTFW1E50PFA00001&c=1&s=1" in post


def test_an_empty_sticker_is_none(posts):
    for vin in ("EMPTY", "NONE"):
        assert "More details" not in posts[vin].facebook and "Unused here" in posts[vin].facebook
        assert posts[vin].notes.more_details_link is None and not posts[vin].notes.factory_warranties_shown


def test_labels_are_quoted_as_they_need(posts):
    assert posts["EMPTY"].notes.pricing_consistency_issues == ["Pricing mismatch: display_price ($45,000) doesn't match the last pricing_rows entry \"Dealer's Price\" ($44,000)."]
    assert "entry 'a \"b\" \\'c\\'' ($1)" in posts["NONE"].notes.pricing_consistency_issues[0]
