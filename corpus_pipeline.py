"""A training corpus from raw documents: toxic documents go, repeated lines go, one document of each
group of near-duplicates stays, personal data is generalised, and what is left is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import line_dedup, near_dedup, packing, pii, queries, toxicity
from quarry.llm.common import delete, fresh_path, intermediates, table

#: A document with this score or more is rejected.
TOXIC = 0.7


def _with_text(docs: DataFrame, made: DataFrame, text: str) -> DataFrame:
    """The columns of `docs` with the text of `made`; n_chars, where it is kept, follows the text."""
    new = {"text": F.col(text)} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return made.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, queries.toxicity_bank(docs, sf_dir))
    return scored.where(F.col("toxic_score") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, line_dedup.drop_repeated_lines(docs, min_docs=10, min_points=1), "kept_text")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, percent=80, words=5)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, pii.sanitise(docs), "clean_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, f"{queries.TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", keep_one), ("pii", sanitise), ("packing", pack)]

#: Scores of a trained model can't be had from SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; what a stage wrote is deleted once its result, and in the end that of the next, is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for at, (name, stage) in enumerate(STAGES):
        if at == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)  # reads what the last but one wrote
        path = fresh_path(spark, f"stage-{name}")
        with intermediates(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
