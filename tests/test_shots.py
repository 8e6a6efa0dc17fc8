"""Shot pickers: a real gallery's picks, and the rules for missing and unknown angles."""

from quarry.plans import shots

# Angles of a gallery of eight cut-outs and one wheel shot, and what is picked of it.
GALLERY = [("01.png", "front_3q", 0.993), ("02.png", "front", 0.968), ("03.png", "front_3q", 0.996), ("04.png", "side", 0.985), ("05.png", "rear_3q", 0.966), ("06.png", "rear", 0.894), ("07.png", "rear_3q", 0.963), ("08.png", "side", 0.95), ("10.png", "wheel", 1.0)]
EXPECTED = {
    "hero_shots": ["03.png", "04.png", "02.png"],
    "quad": ["03.png", "02.png", "06.png", "04.png"],
    "conveyor": ["03.png", "02.png", "06.png"],
    "layout": "quad",
    "adaptive": ["03.png", "02.png", "06.png", "04.png"],
    "carousel": [("03.png", "front_3q"), ("02.png", "front"), ("04.png", "side"), ("05.png", "rear_3q"), ("06.png", "rear"), ("10.png", "wheel")],
    "all_shots": [("03.png", "front_3q"), ("01.png", "front_3q"), ("02.png", "front"), ("04.png", "side"), ("08.png", "side"), ("05.png", "rear_3q"), ("07.png", "rear_3q"), ("06.png", "rear"), ("10.png", "wheel")],
    "opening": [("03.png", "front_3q"), ("06.png", "rear"), ("01.png", "front_3q"), ("04.png", "side"), ("08.png", "side"), ("05.png", "rear_3q"), ("07.png", "rear_3q"), ("10.png", "wheel"), ("02.png", "front")],
}


def picked(spark, **galleries):
    rows = [(k, f, a, c, i) for k, g in galleries.items() for i, (f, a, c) in enumerate(g)]
    made = shots.galleries(spark.createDataFrame(rows, "k string, file string, angle string, confidence double, position int"), "k")
    plain = lambda v: [tuple(x) if not isinstance(x, str) else x for x in v] if isinstance(v, list) else v
    return {r.k: {c: plain(v) for c, v in r.asDict().items() if c != "k"} for r in shots.picks(made, "k").collect()}


def test_picks(spark):
    got = picked(
        spark,
        real=GALLERY,
        plain=[("3.png", None, None), ("1.png", None, None), ("2.png", None, None), ("5.png", None, None), ("4.png", None, None)],
        no_front=[("a", "front_3q", 0.5), ("b", "rear_3q", 0.9), ("c", "side", 0.7), ("d", "side", 0.7)],
        unknown=[("a", "front", 0.9), ("b", "future", 0.95), ("c", "front", 0.9)],
        only_new=[("a", "future", 0.2), ("b", "other", 0.9)],
        spin=[("03.png", "rear", 0.9), ("01.png", "front", 0.9), ("02.png", "side", 0.7), ("04.png", "side", 0.95)],
        wheels=[("w2", "wheel", 1.0), ("w1", "wheel", 1.0)],
    )
    assert {c: got["real"][c] for c in EXPECTED} == EXPECTED
    plain = got["plain"]
    assert plain["hero_shots"] == plain["conveyor"] == ["1.png", "2.png", "3.png"] and plain["quad"] == ["1.png", "2.png", "3.png", "4.png"] and plain["spin"] == []
    assert plain["carousel"] == [(f"{i}.png", "unknown") for i in range(1, 6)]
    few = got["no_front"]
    assert few["quad"] == ["a", "b", "c"] and few["layout"] == "corners" and few["adaptive"] == few["hero_shots"] == ["a", "c", "b"]
    assert few["conveyor"] == ["a", "b", "c"]  # no front is left: the surest unused angle, then no rear: the next
    assert few["all_shots"] == [("a", "front_3q"), ("c", "side"), ("d", "side"), ("b", "rear_3q")]
    unknown = got["unknown"]
    assert unknown["carousel"] == [("a", "front"), ("b", "future")] and unknown["spin"] == [("a", "front")]
    assert unknown["hero_shots"] == ["a", "b", "c"] and unknown["quad"] == ["a"] and unknown["layout"] == "single" and unknown["adaptive"] == ["a"]
    assert got["only_new"]["hero_shots"] == ["a", "b"] and got["only_new"]["conveyor"] == ["b", "a"] and got["only_new"]["quad"] == []
    assert got["spin"]["spin"] == [("01.png", "front"), ("04.png", "side"), ("03.png", "rear")]
    assert got["wheels"]["carousel"] == [("w1", "wheel"), ("w2", "wheel")] and got["wheels"]["hero_shots"] == []
