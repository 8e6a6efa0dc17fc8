"""Spelling variants against all pairs, WARC round trips and cuts, clustering against plain Lloyd."""

import gzip
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from quarry.llm import centroids, queries, spelling, warc
from quarry.llm.common import fresh_path, table
from tests.oracle import DATA, differences

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted(rows, every=199, min_points=6, min_count=5):
    import re

    low = str.maketrans(LETTERS, LETTERS.lower())
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: c for w, c in n.items() if len(w) >= min_points and c >= min_count}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(n, ratio=5):
    """By comparing all pairs of words that share the left or the right half of the longer one's letters but one."""
    near = {w: set() for w in n}
    holes = {}
    for w in n:
        for i in range(len(w)):
            holes.setdefault((len(w), w[:i] + w[i + 1 :], i), []).append(w)
        for i in range(len(w) + 1):
            holes.setdefault((len(w) + 1, w, i), []).append(w)
    for group in holes.values():
        for a in group:
            near[a] |= {b for b in group if is_near(a, b)}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n}


def spelled(rows):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows.collect()}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("most", [20_000, 8])
def test_spelling_equals_all_pairs(spark, most):
    docs = table(spark, DATA, "documents")
    rows = spelling.variants(docs, min_count=2, ratio=2, most=most, bucket_rows=5_000)
    said = variants_of(counted([(r.doc_id, r.text) for r in docs.collect()], min_count=2), 2)
    assert spelled(rows) == said and len(said) > 1000 and sum(1 for s in said if s[4]) > 100


def test_spelling_of_every_edit_and_chains(spark):
    import random

    rng = random.Random(5)
    made = set()
    for _ in range(60):
        w = "".join(rng.choice("abÿ") for _ in range(rng.randint(6, 9)))
        made |= {w, w[1:], w + "a", "b" + w[1:], w[:3] + w[4:], w[:4] + "ab" + w[4:]}
    text = " ".join(" ".join([w] * rng.choice([1, 2, 5, 10, 26, 130])) for w in sorted(made) if len(w) >= 6)
    docs = docs_of(spark, [(1, text), (2, None), (None, text[:500]), (3, ""), (3, text)])
    said = variants_of(counted([tuple(r) for r in docs.collect()], every=7, min_count=1))
    assert any(r != f for _, f, r, *_ in said if f)  # chains of two steps or more
    for most in (10_000, 3):
        assert spelled(spelling.variants(docs.withColumn("n", docs.text).withColumn("word", docs.text), every=7, min_count=1, most=most, bucket_rows=100)) == said


def test_spelling_of_nothing_and_of_long_words(spark):
    assert spelling.variants(docs_of(spark, [])).count() == 0
    assert spelling.variants(docs_of(spark, [(1, None), (None, "a b")])).count() == 0
    long = "ab" * 3000
    got = spelled(spelling.variants(docs_of(spark, [(1, f"{long} {long}x x{long} {long[:99]}é{long[99:]}")]), every=10**12, min_count=1))
    assert {(w == long, n) for w, *_, n, _ in got} == {(True, 3), (False, 1)}


def test_a_prefix_of_a_third_of_all_words_is_cut(spark):
    words = [f"gemein{a}{b}{c}ende" for a in LETTERS.lower()[:12] for b in LETTERS.lower()[:12] for c in LETTERS.lower()[:3]]
    vocabulary = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    dealt = spelling._dealt(vocabulary, 50)
    assert dealt.groupBy(*spelling._KEY).count().agg({"count": "max"}).first()[0] <= 50
    n = {w: 5 for w in words}
    near = {r.word: r.n_near for r in spelling.neighbours(vocabulary, 50, 200).collect()}
    assert near == {w: x for w, *_, x, _ in variants_of(n)}


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(3)
    for size in (1, 2, 3, 64, 77):
        values = rng.permutation(size)
        a, c = rng.integers(0, size, 50), rng.integers(0, size, 50)
        b, d = a + rng.integers(1, size + 1, 50), c + rng.integers(1, size + 1, 50)
        b, d = np.minimum(b, size), np.minimum(d, size)
        q, v = spelling.WaveletTree(values).report(a, b, c, d)
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == sorted((i, int(x)) for i in range(50) for x in values[a[i] : b[i]] if c[i] <= x < d[i])


PAGES = [
    (1, "http://a.example/x y\r\nz", "p" * 200),
    (2, None, "p" * 200),
    (0, "http://b.example/", "p" * 200),
    (3, "u", None),
    (4, "u", ""),
    (5, "u", "s" * 99),
    (6, "u", "s" * 99),
    (7, "u", "ü" * 50),
    (8, "u", "ü" * 50),
    (8, "u", "ü" * 50),
    (None, "u", "ü" * 50),
    (9, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 5000),
    (None, "u", "lonely " * 40),
    (7, "u", "p" * 200),
]


def told(page, rows):
    mine = [(p, (h or "").encode()) for p, _, h in rows]
    out = []
    for p, h in mine:
        same = [q for q, g in mine if g == h and q is not None]
        first = min(same) if same and len(h) >= 100 else p
        out.append((p, len(h), sha256(h).hexdigest(), "response" if p == first else "revisit", None if p == first else first))
    return out


@pytest.mark.parametrize("split", [37, 1000, 1 << 26])
def test_warc_round_trip_at_every_cut(spark, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", queries.F.lit(1)).repartition(3)
    rows = warc.index_of(warc.read(warc.write(pages, archive_bytes=400), split)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = [(r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=key) == sorted(told(pages, PAGES), key=key)
    assert {r.url for r in rows if r.page == 1} == {"http://a.example/x%20y%0D%0Az"}


def test_warc_payloads_come_back_and_are_stored_once(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = fresh_path(spark, "own")
    written = warc.write(pages, folder).collect()
    assert sum(r.records for r in written) == len(PAGES)
    stored = [bytes(r.payload).decode() for r in warc.read(warc.archives_in(spark, folder)).collect() if r.record_type == "response"]
    assert Counter(stored) == Counter({"p" * 200: 1, "": 2, "s" * 99: 2, "ü" * 50: 1, "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 5000: 1, "lonely " * 40: 1})
    name = written[0].path.removeprefix("file://")
    assert gzip.open(name).read(8) == b"WARC/1.1"  # a plain gzip file of several members


def test_warc_of_nothing_and_of_cut_off_files(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.index_of(warc.read(warc.write(none))).count() == 0
    record = warc._member(warc.record_of(1, "u", b"x" * 300, "0" * 64, None, False))
    (tmp_path / "a.warc.gz").write_bytes(record + b"\x1f\x8b\x08junk" + record[:-3])
    (tmp_path / "b.warc.gz").write_bytes(b"")
    (tmp_path / "c.warc.gz").write_bytes(b"\x1f\x8b\x08junk" + record)
    rows = warc.read(warc.archives_in(spark, str(tmp_path)), 50).collect()
    assert [r.record_id for r in rows] == ["<urn:page:1>"] * 2 and {bytes(r.payload) for r in rows} == {b"x" * 300}


def lloyd(rows, k, rounds, dim, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v):
            kept.append((i, [max(-centroids.BOUND, min(centroids.BOUND, int(np.floor(1024 * c)))) if abs(c) < 1e300 else int(np.sign(c)) * centroids.BOUND for c in v]))
    rank = lambda r: (sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    now = [list(x) for _, x in sorted(kept, key=rank)[:k]]
    for at in range(rounds + 1):
        own = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(now)) for _, x in kept]
        if at < rounds:
            for j in range(len(now)):
                mine = [x for (_, x), o in zip(kept, own, strict=True) if o[1] == j]
                if mine:
                    now[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    total = {j: sum(d for d, o in own if o == j) for j in range(len(now))}
    fits = lambda n: n if n < 1 << 63 else None
    return Counter((i, o, d, fits(total[o]), fits(sum(total.values())), tuple(now[o])) for (i, _), (d, o) in zip(kept, own, strict=True))


def clustered(df):
    return Counter((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in df.collect())


def test_clusters_equal_plain_lloyd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(300)] + [(7, [0.5, 0.5, 0.5])] * 100
    rows += [(None, [0.1, 0.2, 0.3]), (301, None), (302, [1.0, 2.0]), (303, [1.0, None, 2.0]), (304, [float("nan"), 1.0, 1.0]), (305, [float("inf"), 0.0, 0.0]), (306, [])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", queries.F.lit("x")).repartition(3)
    for k, rounds in ((5, 10), (3, 1), (4, 0)):
        assert clustered(centroids.cluster(given, k, rounds, 3)) == lloyd(rows, k, rounds, 3)


def test_clusters_of_few_equal_and_huge_vectors(spark):
    shape = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], shape), dim=2).count() == 0
    for rows in ([(1, [1.0, 1.0])], [(i, [2.0, 2.0]) for i in range(20)], [(i, [1e200 * (-1) ** i, float(i)]) for i in range(20)]):
        assert clustered(centroids.cluster(spark.createDataFrame(rows, shape), 8, 4, 2)) == lloyd(rows, 8, 4, 2)


@pytest.mark.parametrize("name", ["op12_warc", "op13_centroids"])
def test_new_queries_same_as_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name]) == []


def test_spelling_query(spark):
    docs = table(spark, DATA, "documents").collect()
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op11_spelling(spark, DATA).collect()}
    assert got == variants_of(counted([(r.doc_id, r.text) for r in docs]))
