"""Holds op3 and op9 against brute force over a folder of tables: python -m tests.llm.recall DIR [op3|op9|planted]

planted: the vectors of DIR, each with a partner at a cosine of 0.98 to 0.99 added to it."""

import os
import re
import string
import sys
import tempfile
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from quarry.llm import queries, vector_dedup

#: A-Z to a-z, nothing else.
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def vectors_of(folder):
    return duckdb.sql(f"SELECT vec_id, label, embedding FROM read_parquet('{folder}/embeddings.parquet{'/*.parquet' if os.path.isdir(folder + '/embeddings.parquet') else ''}') WHERE label IS NOT NULL AND embedding IS NOT NULL").fetchall()


def with_partners(rows):
    rng, out = np.random.default_rng(9), list(rows)
    for i, label, v in rows:
        x = np.array(v, np.float64)
        if len(x) > 1 and np.isfinite(x).all() and x.any():
            side = rng.standard_normal(len(x))
            side -= side @ x / (x @ x) * x
            cosine = rng.uniform(0.98001, 0.99)
            y = cosine * x / np.linalg.norm(x) + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)
            out.append((10**9 + i, label, y.tolist()))
    return out


def links_of_vectors(rows):
    """vec_id -> number of other vectors of its label at 0.98 or more."""
    found = {}
    for key in {(y, len(v)) for _, y, v in rows}:
        own = [(i, v) for i, y, v in rows if (y, len(v)) == key]
        x = np.array([v for _, v in own], np.float64)
        norm = np.linalg.norm(x, axis=1)
        x = x / np.where(norm > 0, norm, 1)[:, None]
        for low in range(0, len(x), 1024):
            counts = (x[low : low + 1024] @ x.T >= 0.98).sum(1) - (norm[low : low + 1024] > 0)
            found |= {own[low + j][0]: int(n) for j, n in enumerate(counts)}
    return found


def components_of_documents(folder, percent=85):
    """doc_id -> smallest doc_id reachable, over all pairs that share one of the rarest shingles of both sets."""
    sets, ids = {}, {}
    at = f"{folder}/documents.parquet{'/*.parquet' if os.path.isdir(folder + '/documents.parquet') else ''}"
    reader = duckdb.connect().execute(f"SELECT doc_id, text FROM read_parquet('{at}')")
    while rows := reader.fetchmany(2000):
        for i, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
            shingles = {hash(tuple(words[k : k + 5])) for k in range(max(1, len(words) - 4))} if words else {("none", i)}
            key = frozenset(shingles) if len(shingles) < 3 else hash(frozenset(shingles))
            sets.setdefault(key, shingles)
            ids.setdefault(key, []).append(i)
    count = Counter(x for own in sets.values() for x in own)
    root, index = {k: k for k in sets}, {}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for key, own in sets.items():
        n = len(own)
        prefix = [x for x in sorted(own, key=lambda x: (count[x], hash(x)))[: n + percent * n // -100 + 1] if count[x] > 1]
        for other in {k for x in prefix for k in index.get(x, ())}:
            if find(other) != find(key):
                both = len(own & sets[other])
                if 100 * both >= percent * (n + len(sets[other]) - both):
                    root[find(key)] = find(other)
        for x in prefix:
            index.setdefault(x, []).append(key)
    least = {}
    for key, own in ids.items():
        least[find(key)] = min(least.get(find(key), min(own)), *own)
    return {i: least[find(key)] for key, own in ids.items() for i in own}


def main(folder, which):
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", 8).config("spark.checkpoint.dir", f"{scratch}/shared").config("spark.sql.warehouse.dir", f"{scratch}/warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if which != "op3":
        rows = vectors_of(folder)
        if which == "planted":
            rows = with_partners(rows)
            pq.write_table(pa.table({"vec_id": [r[0] for r in rows], "label": [r[1] for r in rows], "embedding": pa.array([r[2] for r in rows], pa.list_(pa.float64()))}), f"{scratch}/planted.parquet")
            got = vector_dedup.link(spark.read.parquet(f"{scratch}/planted.parquet"))
        else:
            got = queries.op9_vector_dedup(spark, folder)
        said, got = links_of_vectors(rows), {r.vec_id: r.n_links for r in got.collect()}
        print("vectors", len(said), "links", sum(said.values()), "found", sum(got.values()), "vectors that differ", sum(got[i] != n for i, n in said.items()))
    else:
        said = components_of_documents(folder)
        got = {r.doc_id: r.component_id for r in queries.op3_near_dedup(spark, folder).collect()}
        print("documents", len(said), "of", len(got), "with company", sum(i != c for i, c in said.items()), "components that differ", sum(got[i] != c for i, c in said.items()))


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2] if len(sys.argv) > 2 else "op9")
