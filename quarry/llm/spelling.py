"""Spelling variants: two-dimensional range reporting.

Words of one length are points: rank in forward order by rank in reverse order. Another word is near to a point if, for some edit position i,
they share the i letters before it and the letters after it; so an edit position of a word is a rectangle, the prefix's interval in
forward order by the suffix's in reverse order, and a wavelet tree over the points reports what lies in it. Replacement asks the points of the
word's own length, insertion those of the next; deletion is insertion seen from the other side. Of the equal positions in a run of
equal letters the leftmost counts, so every pair is reported once.

Points and askers are dealt out so that whatever can meet does, in groups of bounded size: a window [lo, hi) of edit positions has the
first lo letters and those from hi on in common with its answers, and they are its key. A word begins with two windows a length, those of its
halves. A key with more than `most` rows is cut into the two halves of its window, each with a longer key, until windows are single
positions, whose keys have one asker of the shorter length and as many points as there are letters. So no prefix, however many words begin with it,
lands in one task, and each word is sent to about six places. Keys are hashed into buckets of about BUCKET_ROWS rows, and each bucket builds
its wavelet trees, one for each length and window, and answers its rectangles with arrays.

Scale: runs are counted with partial aggregation; only distinct words of enough occurrences are indexed; neighbours are counted and
compared inside a bucket first, so what is shuffled then is a row per word and bucket, never the pairs. Roots are found by pointer doubling;
each step multiplies n by `ratio` at least, so the largest n bounds the number of doublings.

Defined results: a null text holds no words, a null id is written as the empty text, repeated rows count as documents of their own, an
empty table gives an empty result, other columns are left out. Equal n are decided by the smallest word in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ascii_lower, discard, materialize

#: Letters of a word; all have code points up to 255, so a word is a byte a letter in Latin-1.
RUN = "[A-Za-zÀ-ÿ]+"
#: Rows that share a key at most, if its window can be cut.
MOST = 20_000
BUCKET_ROWS = 60_000
_CHUNK = 1 << 16
_KEY = ["m", "lo", "hi", "key"]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, min_points: int = 6, min_count: int = 5) -> DataFrame:
    """word, n: runs of letters with a letter left out where the hash of id and run says so, of enough letters and occurrences."""
    doc = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_points).select("doc", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr(F.col("run"), at + 2))
    made = runs.select(F.when(h % every == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_points)
    return made.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame, windows: Column) -> DataFrame:
    """A row for each window of each word with what its answers share with it."""
    rows = rows.withColumn("w", F.explode(windows)).select("word", "n", "m", F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"))
    rest = F.substr(F.col("word"), F.length("word") - F.col("m") + F.col("hi") + 1)
    shared = F.xxhash64("m", "lo", "hi", F.substr(F.col("word"), F.lit(1), F.col("lo")), rest)
    return rows.select("word", "n", "m", "lo", "hi", shared.alias("key"))


def _window(lo: Column, hi: Column) -> Column:
    return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _dealt(vocabulary: DataFrame, most: int) -> DataFrame:
    """word, n, m, lo, hi, key: each word as point and asker of its own length and as asker of the next, in windows whose keys have at most `most` rows."""
    of = vocabulary.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m"))
    half = F.floor(F.col("m") / 2)
    open_rows, done = _keyed(of, F.array(_window(F.lit(0), half), _window(half, F.col("m")))), []
    while True:
        crowded = open_rows.where("hi - lo > 1").groupBy(*_KEY).count().where(F.col("count") > most).select(*_KEY)
        crowded = materialize(crowded, "crowded")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, [*done, open_rows])
        done.append(open_rows.join(crowded, _KEY, "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        again = open_rows.join(crowded, _KEY, "left_semi")
        open_rows = materialize(_keyed(again, F.array(_window(F.col("lo"), middle), _window(middle, F.col("hi")))), "windows")


class WaveletTree:
    """A permutation, level by level: the bits of its values from the highest on, each level in the order that the bits above give."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in reversed(range(max(1, int(len(values) - 1).bit_length()))):
            ones = (values >> bit) & 1 == 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(~ones)))))
            values = np.concatenate((values[~ones], values[ones]))

    def report(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For places [a, b) and values [c, d): number of the rectangle and value, for every value inside it."""
        q, v = np.arange(len(a)), np.zeros(len(a), np.int64)
        for bit, zeros in self.levels:
            za, zb, ones = zeros[a], zeros[b], zeros[-1]
            q, v = np.concatenate((q, q)), np.concatenate((v, v + (1 << bit)))
            a, b = np.concatenate((za, ones + a - za)), np.concatenate((zb, ones + b - zb))
            inside = (a < b) & (v < d[q]) & (v + (1 << bit) > c[q])
            q, v, a, b = q[inside], v[inside], a[inside], b[inside]
        return q, v


class _Order:
    """Rows in the order of their letters, and intervals of the points that share a row's first letters."""

    def __init__(self, letters: np.ndarray, point: np.ndarray):
        order = np.argsort(np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel(), kind="stable")
        same = letters[order[1:]] == letters[order[:-1]]
        self.common = np.where(same.all(1), letters.shape[1], same.argmin(1))
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))
        self.before = np.concatenate(([0], np.cumsum(point[order])))  # points before a place
        self.points = order[point[order]]  # rows of the points by rank

    def intervals(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the ranks [a, b) of the points that begin with its first i letters."""
        new = np.concatenate(([True], self.common < i))
        starts = np.append(np.flatnonzero(new), len(new))
        group = (np.cumsum(new) - 1)[self.place]
        return self.before[starts[group]], self.before[starts[group + 1]]


def _pairs(text: list[bytes], m: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of askers and of the points near to them by an edit in [lo, hi); words of m letters are points, shorter ones ask for insertion."""
    point = np.array([len(w) == m for w in text])
    if not point.any():
        return
    letters = np.array(text, f"S{m}").view(np.uint8).reshape(len(text), m)
    mirrored = np.array([w[::-1] for w in text], f"S{m}").view(np.uint8).reshape(len(text), m)
    forward, reverse = _Order(letters, point), _Order(mirrored, point)
    rank = np.empty(len(text), np.int64)
    rank[reverse.points] = np.arange(len(reverse.points))
    tree = WaveletTree(rank[forward.points])
    least = np.where(point, 2, 1)  # a point is within its own rectangles
    for i in range(lo, hi):
        (a, b), (c, d) = forward.intervals(i), reverse.intervals(m - 1 - i)
        asks = np.flatnonzero((b - a >= least) & (d - c >= least))
        for at in range(0, len(asks), _CHUNK):
            some = asks[at : at + _CHUNK]
            q, v = tree.report(a[some], b[some], c[some], d[some])
            asker, found = some[q], reverse.points[v]
            fits = asker != found
            if i:
                fits &= point[asker] | (letters[found, i - 1] != letters[found, i])
            yield asker[fits], found[fits]


def _answers(table: pa.Table) -> pa.Table:
    """For each word of a bucket: near words found here, largest n among them and the first word that has it."""
    table = table.combine_chunks()
    m, lo, hi, key, n = (table.column(c).to_numpy() for c in ("m", "lo", "hi", "key", "n"))
    text = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    size = np.fromiter(map(len, text), np.int64, len(text))
    _, of, counts = np.unique(key, return_inverse=True, return_counts=True)
    points = np.bincount(of, size == m, len(counts))
    alive = np.flatnonzero((counts[of] > 1) & (points[of] > 0))
    order = alive[np.lexsort((hi[alive], lo[alive], m[alive]))]
    kind = np.stack([m[order], lo[order], hi[order]], 1)
    cuts = np.flatnonzero((kind[1:] != kind[:-1]).any(1)) + 1
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for rows in np.split(order, cuts) if len(order) else []:
        for asker, found in _pairs([text[r] for r in rows], int(m[rows[0]]), int(lo[rows[0]]), int(hi[rows[0]])):
            longer = size[rows[asker]] != m[rows[0]]
            left += [rows[asker], rows[found[longer]]]
            right += [rows[found], rows[asker[longer]]]
    left, right = np.concatenate(left), np.concatenate(right)
    ordinals = {w: at for at, w in enumerate(sorted(set(text)))}
    ordinal = np.fromiter((ordinals[w] for w in text), np.int64, len(text))
    order = np.lexsort((ordinal[right], -n[right], ordinal[left]))
    left, right = left[order], right[order]
    first = np.flatnonzero(np.concatenate(([True], ordinal[left][1:] != ordinal[left][:-1]))) if len(left) else np.empty(0, np.int64)
    word = lambda rows: pa.array([text[r].decode("latin-1") for r in rows], pa.string())
    near = np.diff(np.append(first, len(left)))
    return pa.table({"word": word(left[first]), "n_near": pa.array(near, pa.int64()), "best_n": pa.array(n[right[first]], pa.int64()), "best": word(right[first])})


def neighbours(vocabulary: DataFrame, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """word, n_near, best_n, best for each word that has near words; vocabulary: word, n."""
    dealt = _dealt(vocabulary, most)
    buckets = max(1, ceil(6 * vocabulary.count() / bucket_rows))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets)))
    found = dealt.groupBy("bucket").applyInArrow(_answers, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """word, root: the end of the chain word -> form of at most `steps` steps."""
    links = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(0, ceil(log2(steps))) if steps else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = materialize(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        links = longer
    return links


def variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, min_points: int = 6, min_count: int = 5, ratio: int = 5, most: int = MOST, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word."""
    vocabulary = materialize(words(docs, id_col, text_col, every, min_points, min_count), "vocabulary")
    near = neighbours(vocabulary, most, bucket_rows)
    follows = F.col("best_n") >= ratio * F.col("n")
    rows = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n")
    )
    rows = materialize(rows, "forms")
    largest = vocabulary.agg(F.max("n")).first()[0] or 1
    ends = roots(rows.where("form IS NOT NULL"), max(0, int(log(largest / min_count, ratio) + 1e-9)))
    discard(vocabulary)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
