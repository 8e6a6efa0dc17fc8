"""Window stickers from words with places: side-by-side blocks, missing headers, junk and ties."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.text import titled
from quarry.plans import sticker_blocks
from quarry.plans.sticker_blocks import blocks, word_rows


def test_title_case_as_python_has_it(spark):
    texts = ["ACTIVE GRILLE SHUTTERS", "8yr/36,000 don't", "", "am/fm-2nd row", "élan à é", None, "x1y2"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(titled(F.col("t"))).collect()]
    assert got == [t.title() if t is not None else None for t in texts]


def rows_by_hand(words, tolerance=1.5):
    rows = []
    for x, y, t in sorted(words, key=lambda w: (w[1], w[0], w[2])):
        if rows and abs(y - rows[-1][0][1]) <= tolerance:
            rows[-1].append((x, y, t))
        else:
            rows.append([(x, y, t)])
    return [sorted(r) for r in rows]


def test_rows_of_words(spark):
    rng = random.Random(3)
    pages = [[(float(rng.randint(0, 9)), rng.randint(0, 60) / 4, rng.choice("abc")) for _ in range(n)] for n in (0, 1, 2, 40)]
    df = spark.createDataFrame(list(enumerate(pages)), f"i int, words array<{sticker_blocks.WORD}>").orderBy("i")
    assert [[[tuple(w) for w in row] for row in r[0]] for r in df.select(word_rows(F.col("words"))).collect()] == [rows_by_hand(p) for p in pages]


def line(x, y, text):
    return [(x + 12.0 * i, float(y), t) for i, t in enumerate(text.split())]


PAGE = [
    *line(30, 40, "VEHICLE DESCRIPTION"), *line(30, 52, "F-150 RAPTOR"), *line(30, 62, "2024 4X4 SUPERCREW"), *line(30, 72, "5 PASSENGER"), *line(30, 82, "3.5L V6 ENGINE"), *line(30, 92, "10-SPEED AUTO TRANS"), *line(30, 97, "2ND MANUAL NOTE"),
    (440.0, 51.0, "EXTERIOR"), *line(440, 60, "AVALANCHE"), (440.0, 72.0, "INTERIOR"), *line(440, 90, "TOO FAR BELOW"), *line(640, 52, "FUEL ECONOMY"),
    *line(30, 110, "STANDARD EQUIPMENT INCLUDED"), (30.0, 125.0, "EXTERIOR"), (180.0, 125.5, "INTERIOR"), (330.0, 125.0, "FUNCTIONAL"), (480.0, 125.0, "SAFETY/SECURITY"),
    *line(30, 140, "STEERING:TILT/TELESCOPE,"), *line(30, 149, "CRUISE & AUDIO"), *line(30, 154, "TOW HOOKS"), *line(180, 140, "POWER WINDOWS"), *line(480, 140, "AIRBAGS"), *line(640, 140, "BEYOND THE GRID"),
    (480.0, 158.0, "WARRANTY"), *line(480, 167, "3YR/36,000 BUMPER / BUMPER"), *line(480, 176, "8YR/100,000 HYBRID UNIQUE"), *line(480, 185, "-COMPONENTS IF EQUIPPED"), *line(480, 194, "SEE DEALER"),
    *line(30, 200, "INCLUDED ON THIS VEHICLE"), *line(420, 206, "PRICE INFORMATION"), *line(30, 212, "OPTIONAL EQUIPMENT/OTHER"), *line(30, 224, ".RAPTOR SERIES"), *line(420, 224, "BASE PRICE $76,775.00"),
    *line(30, 236, "FLOOR MATS NO CHARGE"), *line(420, 236, "DESTINATION & DELIVERY 1,995.00"), *line(420, 246, "TOTAL MSRP"), *line(420, 256, "TOTAL MSRP N/A $80,000.00 $1.00"), *line(30, 270, "SOLD TO"), *line(30, 280, "1FTEW1E50MFA00001 X"),
    (700.0, 10.0, "\x9f"), (710.0, 10.0, "\ue012"), (720.0, 10.0, " "), (30.0, 52.5, "\x07"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rng = random.Random(1)
    rows = [("whole", *w) for w in PAGE] + [("empty", 1.0, 1.0, "WORDS")] + [("bare", *w) for w in line(30, 40, "VEHICLE DESCRIPTION") + line(30, 52, "EDGE")]
    rows += [("junk", 1.0, 1.0, None), ("junk", None, 1.0, "X"), ("junk", 1.0, 1.0, "\x01")]
    rng.shuffle(rows)
    words = spark.createDataFrame(rows, "k string, x double, y double, text string").withColumn("rows", F.lit(1)).repartition(3)
    return {r.k: r.asDict(True) for r in blocks(words, "k").collect()}


def test_a_whole_sticker(parsed):
    got = parsed["whole"]
    assert got["overview"] == {
        "vin": "1FTEW1E50MFA00001", "model_line": "F-150 Raptor", "trim_drivetrain": "2024 4X4 Supercrew", "seating_capacity": "5 Passenger", "engine": "3.5L V6 Engine", "transmission": "2Nd Manual Note",
        "exterior_color": "Avalanche", "interior_trim": None, "model": "2024 F-150 Raptor 4X4 Supercrew",
    }
    assert got["equipment"] == {"exterior": ["Steering:Tilt/Telescope, Cruise & Audio", "Tow Hooks"], "interior": ["Power Windows"], "functional_tech": [], "safety_security": ["Airbags"]}
    assert got["warranties"] == ["3-Year / 36,000-Mile Bumper-to-Bumper", "8-Year / 100,000-Mile Hybrid Unique - Components If Equipped", "See Dealer"]
    assert got["optional_equipment"] == ["Raptor Series"]
    assert got["pricing"] == {"base_price": "$76,775.00", "destination_and_delivery": "$1,995.00", "total_vehicle_and_options": None, "total_msrp": "$80,000.00"}


def test_stickers_without_their_headers(parsed):
    for k in ("empty", "bare"):
        got = parsed[k]
        assert (got["equipment"], got["optional_equipment"], got["warranties"], set(got["pricing"].values())) == ({}, [], [], {None})
    assert parsed["bare"]["overview"]["model_line"] == "Edge" and set(parsed["empty"]["overview"].values()) == {None} and "junk" not in parsed


def test_no_words(spark):
    assert blocks(spark.createDataFrame([], "k long, x double, y double, text string"), "k").isEmpty()
