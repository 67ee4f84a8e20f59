"""Harmonic packing of documents into sequences of a fixed capacity.

A piece of length in (capacity / (k+1), capacity / k] is of class k, and a bin of class k takes exactly k
pieces; so a piece's bin and place follow from a counter of its class, and every worker packs its own rows
without asking the others. To leave little room at the ends of bins, a document is cut where that pays: whole
capacities first, then the largest slot (capacity / k) that the rest fills, until the rest fits a slot with
at most 1/64 of itself to spare.

Bins that are not full when a worker's rows end are laid end to end and cut into full sequences; what then
remains is cut into lengths that are powers of two. So only the slack of full bins is ever padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm.batches import handed_back, small_batches
from cellarbook.llm.tokens import Vocabulary, encoded

CAPACITY = 2048
SLACK = 64
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ROWS = 1024  # pieces handed on at once: 8 MB of ids at most
_PART = 1 << 40  # sequences of one worker stay below this


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n ids."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        slot = capacity // (capacity // rest)
        own = rest if slot - rest <= rest // SLACK else capacity // (capacity // rest + 1)
        out.append(own)
        rest -= own
    return out


class Packer:
    """Bins of one worker. Pieces are (document, start, ids, document's ids)."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.next, self.capacity = first_sequence, capacity
        self.bins: dict[int, list[tuple]] = {}

    def _close(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        for length in cut_lengths(len(ids), self.capacity):
            k = self.capacity // length
            own = self.bins.setdefault(k, [])
            own.append((doc, start, ids[start : start + length].copy(), len(ids)))
            start += length
            if len(own) == k:
                yield from self._close(self.bins.pop(k))

    def finish(self) -> Iterator[tuple]:
        left = [p for k in sorted(self.bins) for p in self.bins[k]]
        self.bins = {}
        total = sum(len(p[2]) for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(total.bit_length(), -1, -1) if total % self.capacity >> b & 1]
        left.reverse()
        for size in sizes:
            own, room = [], size
            while room:
                doc, start, ids, n = left.pop()
                if len(ids) > room:
                    left.append((doc, start + room, ids[room:], n))
                    ids = ids[:room]
                own.append((doc, start, ids, n))
                room -= len(ids)
            yield from self._close(own)


def pack(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """Encode every whole text (null: empty, just the end id) and pack the ids: one row per piece.

    No shuffle: each scan partition is packed on its own, with at most one open bin per class in memory.
    `sequence_id` is the partition's number times 2**40 plus a counter. Rows that share a doc_id are packed as
    documents of their own; a null doc_id stays null; other columns are ignored.
    """

    def pieces(batches):
        packer = Packer(TaskContext.get().partitionId() * _PART, capacity)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, ids in encoded(batch.column(1), vocabulary):
                yield from packer.add(keys[row], ids.astype("<u4"))
        yield from packer.finish()

    def run(batches):
        rows = pieces(batches)
        while block := list(islice(rows, ROWS)):
            values = zip(*block, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    small_batches(docs.sparkSession)
    names = [c.split()[0] for c in PIECES.split(", ")]
    types = [pa.binary() if c.endswith("binary") else pa.int64() for c in PIECES.split(", ")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(lambda batches: handed_back(run(batches)), PIECES)
