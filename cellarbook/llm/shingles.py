"""Sets of word shingles as sorted 64-bit keys, in one order for the whole corpus: rare ones first.

A shingle's key is its hash below a class. The class grows with the frequencies of its words, whose product is
about how often they meet by chance; shingles that many texts share (passages) come last of all. Frequencies
stand in tables of CELLS bytes, where a cell holds the largest level of what falls into it; so their size is
fixed, and a class is a function of the shingle. The order only decides which shingles come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm.words import chunks, find_words, mix
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

CELL_BITS = 22
CELLS = 1 << CELL_BITS
COUNTED = 1 << 19  # shingles that a task counts at once
COMMON = 32  # texts that share a shingle of level 1
BY_WORDS, TOP = 22, 31  # largest class from words, and of all
FREQUENT = 14  # level of a word at which, if all were like it, the class from words is the largest
RAREST = 1 << 20  # a word of level 1 is one of so many

_STEP = np.uint64(0x8CB92BA72F3D8DD7)
_SHIFT = np.uint64(64 - CELL_BITS)


@dataclass
class Levels:
    """Levels of words and of shingles by cell."""

    words: np.ndarray
    shingles: np.ndarray


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int, levels: Levels | None = None) -> list[np.ndarray]:
    """Sorted distinct shingles of each text: keys in the corpus's order (below 2**63), or bare hashes.

    A-Z count as a-z. A text with fewer words has its whole sequence as its only shingle; without words none.
    """
    found = find_words(data, offsets, lower=True, digests=True)
    h, n = found.hashes, len(found.hashes)
    whole = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        whole = mix(whole * _STEP + h[i : i + len(whole)])
    if levels is not None:
        level = np.concatenate([[0], np.cumsum(levels.words[h >> _SHIFT], dtype=np.int64)])
        chance = (level[words:] - level[:-words])[: len(whole)] if len(whole) else level[:0]
        classes = np.minimum(BY_WORDS, chance * BY_WORDS // (words * FREQUENT))
        shared = levels.shingles[whole >> _SHIFT].astype(np.int64)
        classes = np.where(shared > 0, np.minimum(TOP, BY_WORDS + shared), classes)
        whole = classes.astype(np.uint64) << np.uint64(58) | whole >> np.uint64(6)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            own = np.zeros(1, np.uint64)
            for x in h[a:b]:
                own = mix(own * _STEP + x)
            out.append(mix(own + np.uint64(b - a)) >> np.uint64(6))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def corpus_levels(docs: DataFrame, words: int) -> Levels:
    """Levels from the texts of all documents.

    Tasks drop what they see once or twice in a stretch of COUNTED before the counts are added up. The driver
    gets one number for each cell with something common, twice CELLS at most.
    """

    def count(batches):
        def out(sets, seen):
            rows = [(2, np.zeros(1, np.int64), np.array([sum(map(len, seen))]))]
            for kind, parts in enumerate((sets, seen)):
                distinct, n = np.unique(np.concatenate(parts), return_counts=True)
                rows.append((kind, distinct[n > 2].view(np.int64), n[n > 2]))
            kinds = np.concatenate([np.full(len(h), k) for k, h, _ in rows])
            arrays = [pa.array(kinds, pa.int32()), pa.array(np.concatenate([h for _, h, _ in rows]))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.concatenate([n for _, _, n in rows]), pa.int64())], ["kind", "h", "n"])

        sets, seen, size = [], [], 0
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                sets += shingle_sets(data, offsets, words)
                seen.append(find_words(data, offsets, lower=True, digests=True).hashes)
                size += len(seen[-1])
                if size > COUNTED:
                    yield out(sets, seen)
                    sets, seen, size = [], [], 0
        if sets:
            yield out(sets, seen)

    counted = docs.select("text").mapInArrow(count, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))
    counted = write_table(counted.where(f"kind > 0 OR n >= {COMMON}"), scratch_path(docs.sparkSession, "counts"))
    total = counted.where("kind = 2").agg(F.sum("n")).first()[0] or 1
    cell = F.shiftrightunsigned("h", 64 - CELL_BITS).cast("int").alias("cell")
    found = []
    for kind, one in ((1, total / RAREST), (0, COMMON)):
        level = F.least(F.lit(TOP), F.floor(F.log2(F.col("n") / one)) + 1).cast("int").alias("level")
        cells = counted.where((F.col("kind") == kind) & (F.col("n") >= one)).select(cell, level)
        rows = cells.groupBy("cell").agg(F.max("level").alias("level")).toPandas()
        levels = np.zeros(CELLS, np.uint8)
        levels[rows["cell"].to_numpy(np.int64)] = rows["level"].to_numpy(np.uint8)
        found.append(levels)
    return Levels(*found)
