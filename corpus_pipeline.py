"""The corpus pipeline: documents to a clean, deduplicated, decontaminated, redacted and mixed corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.llm import decontam, language_id, mixing, secrets, simhash
from sparkloupe.llm._shared import Workspace, tune


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the rows that have a lang, set lang to the predicted one, and drop what is rejected: texts without
    a letter (null and empty ones, too), and texts that two languages encode equally well at every level. A null doc_id
    or lang is no reason to go; where nothing can be learned, all go."""
    tune(spark)
    dictionaries = language_id.fit(docs, ~language_id.held_out())
    predict = language_id.predictor(spark, dictionaries)
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), predict("text").alias("p")).where("not p.rejected")
    return found.select(*(F.col("p.lang").alias(c) if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each near-duplicate group the row with the smallest doc_id. Candidates are linked by SimHash fingerprints,
    as in op6, or share a band of minima; all are confirmed by their sets of shingles. Of rows with one doc_id, the one
    whose columns have the least hash stays, and so do rows whose doc_id is null."""
    groups = simhash.similar_groups(spark, docs).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    row, digest = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    one = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(row, digest).alias("row")).select("row.*")
    kept = one.join(groups, one.doc_id == groups.kept_id, "left_semi")
    return kept.unionByName(docs.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, also with other numbers, names or units. Rows whose doc_id or text is
    null hold none and stay; of rows with one doc_id all go if one holds an item."""
    found = decontam.hits(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("hit")).distinct()
    return docs.join(found, docs.doc_id == found.hit, "left_anti")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in text with a mark; n_chars is counted anew where that changes the text. All rows stay, null
    and empty texts as they are."""
    return secrets.redacted(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, by source weights. Null texts have none; a null source is a source
    of its own; all rows stay."""
    return mixing.mix(spark, docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: The stages fit models and draw at random, which SQL can't express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        done = docs
        docs = space.save(stage(spark, docs, sf_dir), name)
        if i:
            space.drop(done)
    return docs
