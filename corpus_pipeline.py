"""From raw documents to packed sequences: quality, near copies, personal data, mixture, packing.

Every stage takes the documents its predecessor kept and returns documents with the same columns; the last one
returns pieces of packed sequences. `run` writes each stage's result to the shared folder and reads it again,
so a lost executor costs at most one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarbook.llm import mixing, ngram_join, pii, quality
from cellarbook.llm.queries import HELD_OUT, packed, table
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

#: Rows of (doc_id, a number) that are broadcast, about 20 MB; more are joined with a shuffle.
BROADCAST_ROWS = 400_000

# No SQL can express the trained classifiers, tries and tokenizers; tests compare with brute force.
ORACLE_SQL = None


def _side(side: DataFrame, name: str) -> DataFrame:
    """The side of a join, written down, and broadcast if it is small enough."""
    side = write_table(side, scratch_path(side.sparkSession, name))
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels' training part, does not reject."""
    known = table(spark, sf_dir, "labels").where(f"NOT {HELD_OUT}").select("doc_id", F.col("quality").alias("label"))
    return quality.keep(docs, quality.fit(docs, known))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group with similar sets of five-word shingles (0.8 or more).

    Of rows that agree in doc_id and text one stays. Rows without doc_id all stay.
    """
    groups = write_table(ngram_join.group(docs), scratch_path(spark, "groups"))
    if groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").head(1):
        named = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"])
        docs = named.union(docs.where("doc_id IS NULL"))
    others = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(_side(others, "others"), "doc_id", "left_anti").select(docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return pii.redact(docs, pii.fit(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that the sources have their target shares.

    Rows that share a doc_id are taken alike, as often as the one of them that is taken most.
    """
    copies = mixing.mix(docs).groupBy("doc_id").agg(F.max("copies").alias("_copies")).withColumnRenamed("doc_id", "_id")
    joined = docs.join(_side(copies, "copies"), F.col("doc_id").eqNullSafe(F.col("_id")))
    taken = joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return taken.select(docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, as `op3_packing` returns them."""
    return packed(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("personal data", without_personal_data),
    ("mixture of sources", mixed_sources),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), scratch_path(spark, name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
