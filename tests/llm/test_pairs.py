"""Near-duplicates of documents and vectors, against brute force over all pairs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import components as components_module
from quarry.llm import near_dedup, vector_dedup
from quarry.llm.components import components


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """doc_id -> (n_shingles, smallest id reachable)."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 85 * len(x | y):
            root[find(b)] = find(a)
    least = {}
    for k, (i, s) in enumerate(sets):
        r = find(k)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(find(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += [passage + " " + " ".join(word() for _ in range(150)) for _ in range(40)]
    star = [word() for _ in range(200)]
    for _ in range(60):  # copies near the original, not near each other
        copy = list(star)
        for at in rng.sample(range(20), 3):
            copy[at * 10] = word()
        texts.append(" ".join(copy))
    texts.append(" ".join(star))
    for base in list(texts[:30]):
        words = base.split()
        for edits in (0, 1, 2, 5):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append("  \n".join(copy).upper())
    texts += [None, "", " \t", "one two", "ONE  two", "one three", "one two", "é é é é é é", "É é é é é é", "\x1f a b c", "a\x85b c d e f g"]
    return [(i, t) for i, t in enumerate(texts)] + [(5, texts[7]), (5, texts[5]), (None, texts[9]), (None, "only null"), (None, None)]


def test_groups_are_those_of_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")
    got = near_dedup.groups(df.repartition(7)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("part", [near_dedup.PART, 40])
def test_pairs_among_form_letters_are_found(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "PART", part)
    rng = random.Random(8)
    form = [f"w{i}" for i in range(200)]
    new = lambda words, slots: [f"x{rng.random()}" if i in slots else w for i, w in enumerate(words)]
    texts = []
    for i in range(3000):  # about 0.7 alike, all of them
        slots = rng.sample(range(5, 200, 5), 7)
        texts.append(new(form, slots[:4]))
        if i % 20 == 0:  # 0.86
            texts.append(new(texts[-1], slots[4:]))
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for _, t in rows]
    number = {s: i for i, s in enumerate(s for s, n in Counter(s for x in sets for s in x).items() if n > 1)}
    has = np.zeros((len(sets), len(number)), np.float32)
    for i, x in enumerate(sets):
        has[i, [number[s] for s in x if s in number]] = 1
    both, sizes = has @ has.T, np.array([len(x) for x in sets])
    pairs = np.argwhere(np.triu(100 * both >= 85 * (sizes[:, None] + sizes - both), 1)).tolist()
    assert len(pairs) == 150
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(len(rows))} | {b: a for a, b in pairs}


def test_one_of_each_group_is_kept_whole(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(3, text, "a"), (2, text + " end", "b"), (9, "other", "c"), (4, None, "d")], "doc_id long, text string, _gone string")
    assert sorted((r.doc_id, r.text, r._gone) for r in near_dedup.keep_one(df).fillna("", ["text"]).collect()) == [(2, text + " end", "b"), (4, "", "d"), (9, "other", "c")]


def test_rows_and_not_ids_are_dropped(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(100))
    rows = [(1, text("a")), (None, text("a") + " end"), (None, text("b")), (5, text("a") + " fin"), (5, text("c")), (7, text("d")), (7, text("d")), (None, text("e")), (None, text("e")), (8, ""), (None, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _id string")
    got = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(df).collect()), key=str)
    assert got == sorted([(1, text("a")), (None, text("b")), (5, text("c")), (7, text("d")), (None, text("e")), (8, ""), (None, None)], key=str)


def test_empty_table(spark):
    assert near_dedup.groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert vector_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_components_of_long_chains_and_hubs(spark):
    rng = random.Random(1)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:], strict=False)) + [(7, i) for i in range(8, 40)] + [(1, 1), (50, 49), (49, 50)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in chain}, **{i: 7 for i in range(7, 40)}, 50: 49, 49: 49}


@pytest.mark.parametrize("together, rounds", [(components_module.TOGETHER, 0), (16, 30)])
def test_few_links_need_no_rounds_however_many_partitions(spark, monkeypatch, together, rounds):
    monkeypatch.setattr(components_module, "TOGETHER", together)
    written = []
    monkeypatch.setattr(components_module, "materialize", lambda df, label, write=components_module.materialize: written.append(label) or write(df, label))
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = [(i, i + 1) for i in range(120) if i != 60]
        random.Random(2).shuffle(links)
        got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: 0 if i <= 60 else 61 for i in range(121)}
    assert written.count("star") <= rounds


def vectors():
    rng = random.Random(5)
    unit = lambda: [rng.gauss(0, 1) for _ in range(64)]
    rows = []
    for _ in range(12):
        base = unit()
        for _ in range(rng.randint(1, 30)):
            rows.append([x + rng.gauss(0, 0.12) for x in base])
    rows += [unit() for _ in range(300)]
    rows = [(i, v, i % 3) for i, v in enumerate(rows)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(10)] + [(1100 + i, [2 * x for x in rows[i][1]], rows[i][2]) for i in range(5)]
    rows += [(1200, rows[0][1], None), (1201, None, 0), (1202, [0.0] * 64, 0), (1203, [0.0] * 64, 0), (1204, [math.nan] + [1.0] * 63, 0), (1205, [math.inf] + [1.0] * 63, 0)]
    return rows + [(1206, [None] + [1.0] * 63, 0), (1207, [1.0, 0.0], 0), (1208, [1.0, 0.0], 0), (1209, [], 0), (1210, [1.0, 2.0, 3.0], 1), (1211, [2.0, 4.0, 6.0], 1), (1212, [3.0, 2.0, 1.0], 1), (1213, [1.0, 2.0, 3.0], 2), *((1300 + i, [1.0 + 0.001 * i, 0.5, 0.25, float(i % 5)], i % 2) for i in range(50)), (None, rows[0][1], 0), (None, rows[0][1], 0)]


@pytest.mark.parametrize("cell", [vector_dedup.CELL, 8])
def test_links_are_those_of_all_pairs(spark, cell):
    rows = vectors()
    df = spark.createDataFrame([(i, v, y, 1) for i, v, y in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = vector_dedup.link(df, cell=cell).collect()
    able = [k for k, (_, v, y) in enumerate(rows) if y is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    norms = {k: math.sqrt(sum(x * x for x in rows[k][1])) for k in able}
    root, links = {k: k for k in range(len(rows))}, [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    n_pairs = 0
    for a, b in itertools.combinations(able, 2):
        if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and sum(x * y for x, y in zip(rows[a][1], rows[b][1], strict=True)) / norms[a] / norms[b] >= 0.98:
            links[a] += 1
            links[b] += 1
            n_pairs += 1
            root[find(b)] = find(a)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    said = sorted(((i, links[k], least.get(find(k))) for k, (i, _, _) in enumerate(rows)), key=str)
    assert n_pairs > 100
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == said


def test_keys_grow_with_the_number_of_vectors():
    angle = math.acos(0.98)
    for n in (50_000, 10**7, 10**9, 10**11):
        bits, tables = vector_dedup.shape(n, angle)
        assert bits == 16 or n / 2**bits <= vector_dedup.COMPANY
        assert (1 - (1 - angle / math.pi) ** bits) ** tables <= vector_dedup.MISS


def at_threshold(rng, dim, n, mean):
    """Pairs of vectors at cosine 0.98 around a mean."""
    x = rng.standard_normal((n, dim)) + mean * np.ones(dim)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((n, dim))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return x, 0.98 * x + math.sqrt(1 - 0.98**2) * side


@pytest.mark.parametrize("dim,mean,learned", [(64, 0, True), (64, 1, True), (64, 4, True), (16, 0, True), (3, 0, False), (96, 0, False), (5, 2, False)])
def test_pairs_at_the_threshold_meet_in_a_table(dim, mean, learned):
    x, y = at_threshold(np.random.default_rng(4), dim, 3000, mean)
    planes = vector_dedup.Planes(dim, 1_000_000, 0.98, x if learned else None)
    assert (planes.keys(x) == planes.keys(y)).any(1).mean() >= 0.98


def test_rare_lengths_are_not_compared_whole(spark, monkeypatch):
    """Of two lengths one has learned planes, one random ones; a bucket holds few of their vectors."""
    monkeypatch.setattr(vector_dedup, "LEARNED", 1)
    rng, rows = np.random.default_rng(6), []
    for dim, n in ((16, 500), (24, 300)):
        x, y = at_threshold(rng, dim, n, 0)
        rows += [v.tolist() for v in (*x, *(y + 0.1 * x))]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(rows)], "vec_id long, vector array<double>, label int")
    df = df.selectExpr("vec_id", "vector", "label", "sha2(to_json(vector), 256) digest")
    learned, others = vector_dedup._learn(df, 400, 0.98)
    assert list(learned) == [16] and others == {24: 600}
    keys = df.selectExpr("vec_id", "vector").mapInArrow(vector_dedup._tables(learned, others, 0.98), "node long, dim int, keys array<long>").collect()
    for dim, n in ((16, 1000), (24, 600)):
        own = [r["keys"] for r in keys if r.dim == dim]
        assert len(own) == n and max(Counter(k[0] for k in own).values()) < n / 4
    got = {r.vec_id: r.n_links for r in vector_dedup.link(df, vector_col="vector").collect()}
    said = dict.fromkeys(range(len(rows)), 0)
    for low, high in ((0, 1000), (1000, 1600)):
        x = np.array(rows[low:high])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        said |= {low + i: int(c) - 1 for i, c in enumerate((x @ x.T >= 0.98).sum(1))}
    assert sum(said.values()) >= 1600 and sum(got[i] for i in said) >= 0.99 * sum(said.values())
    assert all(got[i] <= n for i, n in said.items())
