"""Leave-one-out medians, ranks of hot keys, and galleries that settle, against the rules in plain Python."""

import statistics

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import gallery, sequences, settling
from quarry.sources.tables import shared_folder


def test_ranks_of_a_hot_key(spark):
    rows = [("hot", i * 7919 % 1000, i) for i in range(1000)] + [("cold", 5, -1), ("cold", 4, -2), (None, 1, -3)]
    df = spark.createDataFrame(rows, "k string, v long, id long").repartition(6)
    got = {(r.k, r.id): r["rank"] for r in sequences.ranked(df, ["k"], ["v", "id"]).collect() if r.k}
    for k in ("hot", "cold"):
        assert [got[k, i] for _, i in sorted((v, i) for key, v, i in rows if key == k)] == list(range(sum(r[0] == k for r in rows)))


def distance(colours, at):
    others = [c for j, c in enumerate(colours) if j != at]
    return sum((colours[at][ch] - statistics.median(c[ch] for c in others)) ** 2 for ch in range(3)) ** 0.5 if others else None


def test_medians_without_a_member(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, n in enumerate((1, 2, 3, 4, 5, 8, 9)):
        rows += [(g, 100 * g + i, rng.integers(0, 4, 3).astype(float).tolist()) for i in range(n)]
    df = spark.createDataFrame([*rows, (1, 99, None)], "g long, name long, colour array<double>")
    got = {r.name: r.distance for r in gallery.colour_distance(df, "g", "colour", "name").collect()}
    assert got == {r.name: r.distance for r in gallery.colour_distance(df, "g", "colour", "name", hot=False).collect()}
    for g in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == g]
        for at, (_, name, _) in enumerate(mine):
            said = distance([c for _, _, c in mine], at)
            assert got[name] == said if said is None else abs(got[name] - said) < 1e-9
    assert got[99] is None


RULE = {"certain": 0.58, "doubtful": 0.75, "far": 110.0}


def foreign(members):
    """Names of the foreign members, the least alike first. members: (name, vector, colour)."""
    ones = [m for m in members if m[2] is not None]
    if len(ones) < 4:
        return []
    found = []
    for i, (name, v, _) in enumerate(ones):
        mean = np.mean([np.array(o[1]) for j, o in enumerate(ones) if j != i], axis=0)
        sim = float(np.dot(v, mean) / np.linalg.norm(v) / np.linalg.norm(mean))
        if sim < RULE["certain"] or (sim < RULE["doubtful"] and distance([o[2] for o in ones], i) > RULE["far"]):
            found.append((sim, name))
    return [] if len(found) > len(ones) / 2 else [n for _, n in sorted(found)]


def settled(photos):
    """The rule, one gallery after another: name -> (outcomes, place, number)."""
    now = {p["name"]: dict(p, outcomes=[]) for p in photos}
    while True:
        moved = False
        for g in sorted({p["gallery"] for p in now.values()}):
            mine = [p for p in now.values() if p["gallery"] == g]
            for name in foreign([(p["name"], p["vector"], p["colour"]) for p in mine if p["place"] == "exterior"]):
                last = max([p["number"] for p in mine if p["place"] == "interior"], default=0)
                now[name].update(place="interior", number=last + 1, outcomes=["demoted"])
                moved = True
        if not moved:
            break
    for p in sorted(now.values(), key=lambda p: (p["gallery"], p["number"], p["name"])):
        if p["place"] != "interior" or p["outcomes"] or p["category"] not in (None, "exterior"):
            continue
        out = [q for q in now.values() if q["gallery"] == p["gallery"] and q["place"] == "exterior"]
        if p["category"] is None:
            outcome = "classify_failed"
        elif p["wheel"]:
            outcome = "wheel_eligible_skipped"
        elif not p["cut_ok"]:
            outcome = "cutout_failed"
        elif len(out) + 1 < 4:
            outcome = "insufficient_gallery"
        elif p["name"] in foreign([(q["name"], q["vector"], q["colour"]) for q in [*out, p]]):
            outcome = "rejected_by_gallery"
        else:
            outcome = "promoted"
            p.update(place="exterior", number=max((q["number"] for q in out), default=0) + 1)
        p["outcomes"].append(outcome)
    return {n: (p["outcomes"], p["place"], p["number"]) for n, p in now.items()}


def photos_of(rng):
    rows = []
    for g in range(6):
        base = rng.normal(size=4) * 3
        paint = rng.integers(0, 255, 3).astype(float)
        for i in range(int(rng.integers(3, 8))):
            odd = rng.random() < 0.25
            rows.append({"gallery": g, "name": f"{g}-e{i}", "place": "exterior", "number": i + 1, "odd": odd, "base": base, "paint": paint, "category": "exterior", "wheel": False, "cut_ok": True})
        for i in range(int(rng.integers(1, 4))):
            category = ["exterior", "interior", None][int(rng.choice(3, p=[0.75, 0.15, 0.1]))]
            rows.append({"gallery": g, "name": f"{g}-i{i}", "place": "interior", "number": i + 1, "odd": rng.random() < 0.5, "base": base, "paint": paint, "category": category, "wheel": bool(rng.random() < 0.1), "cut_ok": bool(rng.random() < 0.85)})
    for r in rows:
        base, paint, odd = r.pop("base"), r.pop("paint"), r.pop("odd")
        r["vector"] = (rng.normal(size=4) * 3 if odd else base + rng.normal(size=4)).tolist()
        r["colour"] = None if rng.random() < 0.05 else (rng.integers(0, 255, 3).astype(float) if odd else paint + rng.integers(-20, 20, 3)).tolist()
    return rows


SHAPE = "gallery long, name string, place string, number long, vector array<double>, colour array<double>, category string, wheel boolean, cut_ok boolean"


def test_galleries_settle_as_the_rule_says_and_stay_so(spark):
    rng = np.random.default_rng(11)
    outcomes = set()
    rows = photos_of(rng)
    photos = spark.createDataFrame([tuple(r[c.split()[0]] for c in SHAPE.split(", ")) for r in rows], SHAPE)
    folder = shared_folder(spark, "log")
    log = settling.settle(photos, folder, **RULE, dim=4)
    said = settled(rows)
    entries = {}
    for r in sorted(log.collect()):
        entries.setdefault(r.name, []).append(r.outcome)
    assert entries == {n: o for n, (o, *_) in said.items() if o}
    outcomes |= {o for v in entries.values() for o in v}
    after = {r.name: (r.place, r.number) for r in settling.as_moved(photos, log).collect()}
    assert after == {n: (place, number) for n, (_, place, number) in said.items()}
    again = settling.settle(photos, folder, **RULE, dim=4)
    assert sorted(again.collect()) == sorted(log.collect())  # a second run moves nothing
    assert {"demoted", "promoted", "rejected_by_gallery"} <= outcomes


def test_a_killed_run_goes_on(spark):
    rows = photos_of(np.random.default_rng(12))[:14]
    photos = spark.createDataFrame([tuple(r[c.split()[0]] for c in SHAPE.split(", ")) for r in rows], SHAPE)
    whole = settling.settle(photos, shared_folder(spark, "log"), **RULE, dim=4)
    folder, swap, left = shared_folder(spark, "log"), settling.Publication.swap, [2]

    def once(self, *a):
        if not left[0]:
            raise OSError("killed")
        left[0] -= 1
        return swap(self, *a)

    settling.Publication.swap = once
    try:
        settling.settle(photos, folder, **RULE, dim=4)
    except OSError:
        pass
    finally:
        settling.Publication.swap = swap
    assert sorted(settling.settle(photos, folder, **RULE, dim=4).collect()) == sorted(whole.collect())


def test_no_photos(spark):
    assert settling.settle(spark.createDataFrame([], SHAPE), shared_folder(spark, "log"), dim=4).isEmpty()
    assert gallery.colour_distance(spark.createDataFrame([], "g long, name long, colour array<double>"), "g", "colour", "name").filter(F.lit(True)).isEmpty()
