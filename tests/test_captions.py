"""Confirmation, greedy matching, lookups and colours against their rules in plain Python."""

import colorsys
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import colours
from quarry.operators import lookups, matching
from quarry.plans import captions


def test_confirmation_goes_by_keyword_then_by_feature(spark):
    rows = [
        ("rear_seats", ["Third Row", "Rear Bench 60/40"], "Rear Bench 60/40"),
        ("phone_mirroring", ["Android Auto", "CarPlay Plus", "Apple CARPLAY"], "Apple CARPLAY"),
        ("usb_ports", ["2 USB Ports", "USB-C"], "2 USB Ports"),
        ("usb_ports", ["Radio"], None),
        ("usb_ports", [], None),
        ("usb_ports", None, None),
        ("unheard_of", ["USB"], None),
        ("none", ["none"], None),
        (None, ["USB"], None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, label string, features array<string>, said string")
    assert [r[0] for r in df.orderBy("i").select(captions.confirmed(F.col("label"), F.col("features"))).collect()] == [r[2] for r in rows]


def test_a_feature_captions_the_surest_photo_once(spark):
    photos = spark.createDataFrame(
        [("g", "a", "usb_ports", 0.6), ("g", "b", "usb_ports", 0.9), ("g", "c", "usb_ports", 0.9), ("g", "d", "none", 0.99), ("g", "e", "sunroof", 0.54), ("g", "f", "cargo_area", 0.55), ("h", "a", "usb_ports", 0.7), ("i", "a", "usb_ports", 0.7)],
        "g string, p string, label string, confidence double",
    )
    features = spark.createDataFrame([("g", ["USB", "Moonroof", "Cargo Net"]), ("h", ["Usb"])], "g string, features array<string>")
    assert sorted(tuple(r) for r in captions.captions(photos, features, "g", "p").collect()) == [("g", "b", "USB"), ("g", "f", "Cargo Net"), ("h", "a", "Usb")]


def taken_in_order(pairs):
    left, right, out = set(), set(), set()
    for w, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((w, a, b))
    return out


@pytest.mark.parametrize("kind", ["random", "ties", "chain", "repeated"])
def test_matching_equals_one_pass(spark, kind):
    rng = random.Random(7)
    pairs = {
        "random": [(rng.randint(0, 40), rng.randint(0, 30), rng.randint(0, 20)) for _ in range(300)],
        "ties": [(1, a, b) for a in range(6) for b in range(5)],
        "chain": [(100 - i, (i + 1) // 2, i // 2) for i in range(10)],  # each pair is blocked until the one before it is taken
        "repeated": [(3, 1, 1), (3, 1, 1), (2, 1, 2), (2, 2, 1), (1, 2, 2)],
    }[kind]
    df = spark.createDataFrame([*pairs, (99, None, 1), (99, 1, None)], "w int, a int, b int")
    got = [tuple(r) for r in matching.match_greedily(df, ["a"], ["b"], [(-F.col("w")).alias("less")]).collect()]
    assert len(got) == len(set(got)) and set(got) == taken_in_order(pairs)


def test_matching_of_nothing(spark):
    assert matching.match_greedily(spark.createDataFrame([], "w int, a int, b int"), ["a"], ["b"], [F.col("w")]).isEmpty()


def test_the_nearest_calibration_within_six_levels(spark):
    marks = spark.createDataFrame([("/a", 0.1), ("/a/b/c/", 0.3), ("/a/n", None), ("/", 0.9), ("/t", 0.5), ("/t", 0.4), (None, 0.7)], "path string, certain double")
    paths = {"/a/b/c/d": 0.3, "/a/b/x": 0.1, "/a/1/2/3/4/5": 0.1, "/a/1/2/3/4/5/6": None, "/a/n/x": None, "/z": 0.9, "/t/u": 0.4, "/": 0.9, "/1/2/3/4/5/6": None}
    got = {r.path: (r.certain, r.found) for r in lookups.nearest_above(spark.createDataFrame([(p,) for p in paths] * 2, "path string"), marks, "path", "certain").collect()}
    assert {p: v for p, (v, _) in got.items()} == paths
    assert [p for p, (_, found) in got.items() if not found] == ["/a/1/2/3/4/5/6", "/1/2/3/4/5/6"] or {p for p, (_, f) in got.items() if not f} == {"/a/1/2/3/4/5/6", "/1/2/3/4/5/6"}


def test_assets_by_name_by_tag_and_by_default(spark):
    assets = spark.createDataFrame([("bg", "American Flag", ["flag", "x"], "1", 1), ("bg", "Twin", ["t", "t"], "2", 2), ("bg", "twin", ["u"], "3", 3), ("bg", "u", ["x"], "4", 4), ("bg", None, None, "5", 5), ("a", "Z", [], "6", 9)], "category string, name string, tags array<string>, file string, position int")
    asked = [
        ("bg", "american FLAG", None, "1", None), ("bg", "flag", None, "1", None), ("bg", "FLAG", None, None, "no match"), ("bg", "twin", None, None, "ambiguous"), ("bg", "t", None, "2", None), ("bg", "x", None, None, "ambiguous"),
        ("bg", "u", None, "4", None), ("bg", "nope", None, None, "no match"), ("bg", None, "U", "4", None), ("bg", None, "nope", "1", None), ("bg", None, "TWIN", "2", None), ("bg", None, None, "1", None), ("none", None, "x", None, "empty"), ("none", "x", None, None, "empty"), ("a", "Z", None, "6", None),
    ]
    df = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(asked)], "i int, category string, value string, default_name string")
    got = lookups.resolve(df, assets).orderBy("i").collect()
    assert [(r.file, r.error) for r in got] == [a[3:] for a in asked]
    assert got[0].entry.name == "American Flag" and got[7].entry is None


def stops_by_hand(e, i):
    def pressed(rgb):
        h, s, v = colorsys.rgb_to_hsv(*(c / 255 for c in rgb))
        return h, (min(max(s, 0.28), 0.78) if s > 0.1 else s), 0.1 + v * 0.42

    (h1, s1, v1), (h2, s2, v2) = pressed(e), pressed(i)
    plain = max(colorsys.rgb_to_hsv(*(c / 255 for c in x))[1] for x in (e, i)) <= 0.15
    if abs(v1 - v2) < 0.14:
        low, high = (v1 + v2) / 2 - 0.07, (v1 + v2) / 2 + 0.07
        v1, v2 = (min(max(x, 0.1), 0.52) for x in ((high, low) if v1 >= v2 else (low, high)))
    if abs((h1 - h2 + 0.5) % 1 - 0.5) < 0.02 and abs(s1 - s2) < 0.05:
        if not plain:
            h2 += 0.055
        elif v1 >= v2:
            h1, s1 = 0.6, 0.3
        else:
            h2, s2 = 0.6, 0.3
    return [[c * 255 for c in colorsys.hsv_to_rgb(h % 1, s, v)] for h, s, v in ((h1, s1, v1), (h2, s2, v2))]


def test_gradient_stops(spark):
    rng = random.Random(2)
    words = list(colours.COLOR_WORDS.values())
    pairs = [(a, b) for a in words[::3] for b in words[::4]] + [((255, 0, 4), (255, 4, 0)), ((0, 0, 0), (0, 0, 0)), ((255, 255, 255), (250, 250, 250)), ((10, 10, 10), (255, 255, 255)), ((168, 34, 44), (168, 34, 44))]
    pairs += [tuple(tuple(rng.randint(0, 255) for _ in range(3)) for _ in range(2)) for _ in range(100)]
    rgb = "struct<r:double,g:double,b:double>"
    df = spark.createDataFrame([(n, tuple(map(float, a)), tuple(map(float, b))) for n, (a, b) in enumerate(pairs)], f"n int, a {rgb}, b {rgb}")
    for r in colours.with_stops(df, "a", "b").collect():
        for got, said in zip((r.first, r.second), stops_by_hand(*pairs[r.n]), strict=True):
            assert all(abs(g - s) <= 0.5 + 1e-6 for g, s in zip(got, said, strict=True))


def test_colour_names(spark):
    names = {"Dark Navy Blue Metallic": "navy", "Iconic Silver": "silver", "Sandstone": "stone", "Avalanche": None, "": None, None: None, "TURQUOISE black": "turquoise"}
    names["Dark Navy Blue Metallic"] = "navy"
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in names], "n string").select("n", colours.named(F.col("n"))).collect()}
    assert {n: None if c is None else tuple(c) for n, c in got.items()} == {n: None if w is None else tuple(map(float, colours.COLOR_WORDS[w])) for n, w in names.items()}
