"""Text quality by a similarity-weighted vote of the nearest labelled documents in a latent-semantic space.

Terms are hashed: words, the shapes of words and of neighbouring words ("Thnd***" has the shape "Aa*"), and a
word that repeats the one before it. Weighted counts of a labelled sample are projected on their leading
singular directions. The sample's vectors are broadcast (their number is bounded by SAMPLE), and every
document's vector is multiplied with all of them in blocks; the K nearest vote by their cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm.batches import handed_back, small_batches
from cellarbook.llm.words import chunks, find_words, hash_spans, mix

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 4096
WORD_TERMS, SHAPE_TERMS = 1024, 1024
TERMS = WORD_TERMS + SHAPE_TERMS
DIRECTIONS = 48
NEIGHBOURS = 15

_KINDS = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word's shape: kinds of characters, runs of one kind written once."""
    kinds = _KINDS[data]
    first = np.ones(len(data), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[starts] = True
    before = np.concatenate([[0], np.cumsum(first)])
    return hash_spans(kinds[first], before[starts], before[ends])


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed terms, one row per text; texts lie end to end."""
    texts = len(offsets) - 1
    out = np.zeros(texts * TERMS)
    if len(data):
        words = find_words(data, offsets, lower=True)
        text = np.repeat(np.arange(texts), np.diff(words.first))
        small, shapes = words.hashes, shape_hashes(data, words.starts, words.ends)
        follows = np.flatnonzero(text[1:] == text[:-1]) + 1
        pair = mix(shapes[follows - 1] * np.uint64(3) + shapes[follows])
        same = follows[small[follows] == small[follows - 1]]
        for where, term in (
            (text, small % np.uint64(WORD_TERMS)),
            (text, WORD_TERMS + mix(shapes) % np.uint64(SHAPE_TERMS)),
            (text[follows], WORD_TERMS + pair % np.uint64(SHAPE_TERMS)),
            (text[same], np.full(len(same), WORD_TERMS, np.int64)),
        ):
            out += np.bincount(where * TERMS + term.astype(np.int64), minlength=len(out))
    return out.reshape(texts, TERMS).astype(np.float32)


@dataclass
class Model:
    """Term weights, directions (TERMS x DIRECTIONS), the sample's unit vectors and labels."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        out = _unit(np.log1p(counts) * self.weights) @ self.directions
        return _unit(out)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes for label 1, between 0 and 1; the share of label 1 where nothing is similar."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosines = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(float) ** 8
        total = votes.sum(1)
        share = (votes * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, share, self.labels.mean()), 0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(1, keepdims=True))
    return (rows / np.where(length > 0, length, 1)).astype(np.float32)


def fit_arrays(counts: np.ndarray, labels: np.ndarray) -> Model:
    """Fit on counts of labelled documents: weights by rarity, then the leading singular directions."""
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    weighted = _unit(np.log1p(counts) * weights)
    rng = np.random.Generator(np.random.PCG64(5))
    basis = rng.standard_normal((TERMS, min(DIRECTIONS + 16, TERMS))).astype(np.float32)
    for _ in range(6):  # subspace iteration
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, rotation = np.linalg.svd(weighted @ basis, full_matrices=False)
    model = Model(weights, (basis @ rotation.T)[:, :DIRECTIONS].astype(np.float32), np.zeros(0), labels)
    model.vectors = model.project(counts)
    return model


def _counted(batches):
    for batch in batches:
        for row, rows, data, offsets in chunks(batch.column(1)):
            counts = term_counts(data, offsets)
            packed = pa.array([x.astype("<f4").tobytes() for x in counts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, rows), packed], ["label", "counts"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` of the labelled documents (`labels`: doc_id, label 0 or 1).

    The sample is the documents whose hash of doc_id is smallest, so it does not depend on the order of rows.
    Rows without id or label are left out, and of several labels of a document the smallest counts. The driver
    gets `sample` rows of TERMS numbers, however long the texts are.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by `sample` rows
    rows = texts.select(F.col("label").cast("double"), "text").mapInArrow(lambda batches: handed_back(_counted(batches)), "label double, counts binary")
    rows = rows.limit(2 * sample).collect()  # repeated documents may add rows
    rows.sort(key=lambda r: (r.label, r.counts))
    counts = np.array([np.frombuffer(r.counts, "<f4") for r in rows], np.float32).reshape(-1, TERMS)
    return fit_arrays(counts, np.array([r.label for r in rows]))


def _scores(column: pa.Array, model: Model) -> np.ndarray:
    out = np.zeros(len(column))
    for row, rows, data, offsets in chunks(column, 1 << 20):
        for i in range(0, rows, 512):  # texts whose counts and cosines are in memory at once
            part = offsets[i : min(i + 512, rows) + 1]
            counts = term_counts(data[part[0] : part[-1]], part - part[0])
            out[row + i : row + i + len(counts)] = model.score(counts)
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; the whole text counts, null is empty. Other columns play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            values = pa.array(_scores(batch.column(1), shared.value), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda batches: handed_back(run(batches)), "doc_id long, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), shared.value) >= least))

    return docs.mapInArrow(lambda batches: handed_back(run(batches)), docs.schema)
