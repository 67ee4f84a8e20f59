"""Named queries of the corpus operators over the given tables, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarbook.llm import (
    code_books,
    html_extract,
    license_scan,
    mixing,
    ngram_join,
    packing,
    pii,
    quality,
    suffix_dedup,
    token_codes,
    vector_dups,
    vector_search,
    whitening,
)
from cellarbook.llm.tokens import Vocabulary
from cellarbook.operators.joins import fits_broadcast
from cellarbook.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str, end_id: int, cut: str) -> Vocabulary:
    import public_tokenizers

    return Vocabulary(public_tokenizers.path(name), end_id, cut)


@query
def op1_token_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids, written as directly addressable codes and read back."""
    path = scratch_path(spark, "codes")
    token_codes.write_codes(table(spark, folder, "documents"), path, vocabulary("word_bpe_49k.json", 2, "drop_space"))
    read = token_codes.read_codes(spark, path)
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json", 1, "keep_space"))
    digest = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset")


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents cut and packed into sequences of at most 2048 ids."""
    return packed(table(spark, folder, "documents"))


@query
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of each document the weighted mixture of all sources takes."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


HELD_OUT = "coalesce(crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1, false)"


def quality_model(spark: SparkSession, folder: str) -> quality.Model:
    """Fitted on labels outside the held-out third only."""
    known = table(spark, folder, "labels").where(f"NOT {HELD_OUT}").select("doc_id", F.col("quality").alias("label"))
    return quality.fit(table(spark, folder, "documents"), known)


@query
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every whole text by the vote of the nearest labelled documents."""
    scored = quality.score(table(spark, folder, "documents"), quality_model(spark, folder))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", predicted)


def joined_spans(spans) -> F.Column:
    """kind:start:end of an array of spans, comma-joined."""
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", text)


@query
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every whole text: strict matches, and what boosted trees add."""
    docs = table(spark, folder, "documents")
    found = pii.detect(docs, pii.fit(docs))
    strict = F.filter("spans", lambda s: s["strict"])
    kinds = F.transform(strict, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).eqNullSafe)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    digest = F.sha2(joined_spans(strict).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined_spans(F.col("spans")).alias("spans"))


@query
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.group(table(spark, folder, "documents"), words=3, percent=90)


@query
def op7_vector_dups(spark: SparkSession, folder: str) -> DataFrame:
    """Near copies among all embeddings at a cosine of 0.95 or more."""
    return vector_dups.group(table(spark, folder, "embeddings"))


@query
def op9_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 largest inner products of every twentieth embedding with all others."""
    return vector_search.search(table(spark, folder, "embeddings"), "vec_id % 20 = 0", 20)


@query
def op6_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages")
    return html_extract.main_text(pages, html_extract.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices of every whole text, by conditional compression."""
    found = license_scan.scan(table(spark, folder, "documents"))
    names = F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"]))))
    spans = F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("found").cast("long").alias("n_notices"), names.alias("licenses"), F.concat_ws(",", spans).alias("spans"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on the eight leading components of their covariance, each scaled to variance 1."""
    vectors = table(spark, folder, "embeddings")
    model = whitening.fit(vectors)
    error = F.lit(whitening.identity_error(vectors, model)).cast("double").alias("identity_error")
    deviation = F.expr("try_cast(deviation AS long)").alias("deviation")
    n = F.lit(model.n).cast("long").alias("n")
    return whitening.whiten(vectors, model).select("vec_id", "component", n, deviation, "whitened", "explained", error)


@query
def op13_code_books(spark: SparkSession, folder: str) -> DataFrame:
    """Four bytes for every embedding, and what they miss."""
    codes, books = code_books.compress(table(spark, folder, "embeddings"), ["label"])
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if fits_broadcast(codes.select("label")) else sums
    digest = F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256")
    joined = codes.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest)


@query
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every whole text without the 50-byte strings that an earlier document has."""
    left = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed")
    return left.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
