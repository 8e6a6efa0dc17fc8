"""The registered queries against their SQL, and the pipeline's stages."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import queries, toxicity
from tests.oracle import DATA, differences

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the shared tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name]) == []


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        if at < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < docs.count() <= before
            assert docs.where("n_chars <> length(text)").count() == 0 or name == "toxicity"
            before = docs.count()
    assert docs.count() >= before
    shared = spark.conf.get("spark.checkpoint.dir")
    held = set(os.listdir(shared))
    assert corpus_pipeline.run(spark, DATA).count() == docs.count()
    # What the last stage reads stays: the documents before it, and their tokens.
    assert sorted(f.rsplit("-", 1)[0] for f in set(os.listdir(shared)) - held) == ["stage-pii", "tokens"]


def test_near_dedup_stage_links_at_four_fifths(spark):
    words = [f"w{i}" for i in range(100)]
    near = [f"x{i}" if i in (30, 60) else w for i, w in enumerate(words)]  # 86 of 106 shingles
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.keep_one(spark, docs, DATA).collect()] == [1]


def test_fates_are_those_of_the_stages_by_hand(spark):
    """Each stage's decision on a small corpus, against plain Python."""
    letters = "abcdefghij"
    word = lambda i, j: f"{letters[i % 10]}{letters[j % 10]}{letters[(i * j) % 10]}{letters[(i + j) % 10]}{i}"
    text = lambda i: " ".join(word(i, j) + str(j) for j in range(40))
    rows = [(i, "Shared footer\n" + text(i)) for i in range(12)] + [(20, text(3) + " more"), (21, text(5)), (22, "write to ann@example.org please " + text(22))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, DATA).collect()}
    assert lines == {i: t.removeprefix("Shared footer\n") for i, t in rows}
    stage = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in lines.items()], docs.schema)
    one = corpus_pipeline.keep_one(spark, stage, DATA)
    assert {r.doc_id for r in one.collect()} == {*range(12), 22}
    clean = {r.doc_id: r.text for r in corpus_pipeline.sanitise(spark, one, DATA).collect()}
    assert "ann@example.org" not in clean[22] and "[EMAIL]" in clean[22] and clean[4] == text(4)
    pieces = corpus_pipeline.pack(spark, one, DATA).collect()
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_each_stage_takes_awkward_tables(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text of a few words here", "en", "a", 29), (3, "mail bob@example.org now", None, "b", 24)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            if name != "packing":
                assert out.columns == docs.columns
            assert out.count() >= min(docs.count(), 4) if name != "near_dedup" else out.count() <= docs.count()


def test_long_texts_go_to_python_a_few_megabytes_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words of a text ', 300)").alias("text"))
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        toxicity.fit(docs, spark.createDataFrame([], "doc_id long, label int"))
        assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 5_000_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)
