"""Vectors as short codes: each of four parts is replaced by the nearest entry of its codebook.

Entries move in every round, and most vectors keep theirs. So each vector keeps, per part, a lower bound of its
distance to every group of entries, and the round at which the bound was found. As all earlier codebooks are at
hand, a bound goes down by how far an entry has come since that round (the norm of the summed steps), which is
never more than the sum of the steps. Only groups whose bound does not clear the distance to the own entry are
compared entry by entry, in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm.entries import scaled, usable
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

PARTS, ENTRIES, ROUNDS, GROUPS = 4, 256, 4, 8
SLACK = 1e-6  # relative room for the rounding of bounds
_FAR = np.iinfo(np.int64).max


def largest_entry(width: int) -> int:
    """Size up to which squared distances of `width` entries fit 64 bits; larger entries count as this."""
    return int((2**62 / (4 * max(width, 1))) ** 0.5)


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all entries."""
    top = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * float(top) ** 2 * x.shape[1] < 2**52:  # then all terms are whole numbers that doubles hold exactly
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(book)), np.int64)
    for i in range(0, len(x), 64):
        out[i : i + 64] = ((x[i : i + 64, None] - book) ** 2).sum(axis=2)
    return out


def grouped(book: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group of each entry: entries in the order of their leading direction, cut in equal runs."""
    middle = book - book.mean(axis=0)
    direction = np.linalg.svd(middle.astype(np.float64), full_matrices=False)[2][0]
    order = np.argsort(middle @ direction, kind="stable")
    out = np.empty(len(book), np.int64)
    out[order] = np.arange(len(book)) * min(groups, len(book)) // len(book)
    return out


@dataclass
class Part:
    """Codebooks of one part in the order of rounds, and the group of each entry."""

    books: list[np.ndarray]
    group: np.ndarray

    def moves(self) -> np.ndarray:
        """Largest net way of a group's entries from each earlier round until now."""
        ways = [np.sqrt(((self.books[-1] - b).astype(np.float64) ** 2).sum(axis=1)) for b in self.books]
        return np.array([[w[self.group == g].max() for g in range(self.group.max() + 1)] for w in ways]) * (1 + SLACK)

    def assign(self, x: np.ndarray, own: np.ndarray, low: np.ndarray, stamp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """(nearest entry, its squared distance, bounds, their rounds, distances computed beside the own one).

        Bounds are of all entries of a group but the vector's own. In the first round there are none.
        """
        now, book, groups = len(self.books) - 1, self.books[-1], self.group.max() + 1
        rows = np.arange(len(x))
        if now == 0:
            need, reach = np.ones((len(x), groups), bool), np.zeros((len(x), groups))
            best, entry = np.full(len(x), _FAR), np.full(len(x), len(book))
        else:
            reach = low - self.moves()[stamp, np.arange(groups)]
            best, entry = ((x - book[own]) ** 2).sum(axis=1), own.astype(np.int64)
            need = reach <= (np.sqrt(best.astype(np.float64)) * (1 + SLACK) + SLACK)[:, None]
        before, computed = best.copy(), 0
        first, second = np.full((len(x), groups), _FAR), np.full((len(x), groups), _FAR)
        for g in range(groups):
            members, at = np.flatnonzero(self.group == g), np.flatnonzero(need[:, g])
            if not len(at):
                continue
            found = squared(x[at], book[members])
            computed += found.size
            nearest = found.argmin(axis=1)  # members ascend, so the first of equals has the lowest index
            first[at, g] = found[np.arange(len(at)), nearest]
            found[np.arange(len(at)), nearest] = _FAR
            second[at, g] = found.min(axis=1)
            closer = (first[at, g] < best[at]) | ((first[at, g] == best[at]) & (members[nearest] < entry[at]))
            best[at] = np.where(closer, first[at, g], best[at])
            entry[at] = np.where(closer, members[nearest], entry[at])
        low, stamp = low.astype(np.float64), stamp.copy()
        home = self.group[entry]
        others = first.copy()
        others[rows, home] = second[rows, home]
        low[need] = np.sqrt(others[need].astype(np.float64)) * (1 - SLACK)
        stamp[need] = now
        if now:
            # The entry that a vector leaves is one of its group's others from now on.
            left = np.flatnonzero((entry != own) & ~need[rows, self.group[own]])
            g = self.group[own[left]]
            low[left, g] = np.minimum(reach[left, g], np.sqrt(before[left].astype(np.float64)) * (1 - SLACK))
            stamp[left, g] = now
        return entry, best, low, stamp, computed


@dataclass
class Books:
    """Codebooks of all parts."""

    parts: list[Part]

    def digest(self) -> str:
        """sha256 of all final entries' numbers, by part, entry and position."""
        flat = (str(v) for part in self.parts for v in part.books[-1].ravel().tolist())
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def _start(rows: DataFrame, length: int) -> Books:
    """The vectors of the smallest vec_ids (of equals the smaller vector first; without vec_id last), cut in parts."""
    ordered = rows.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).collect()
    x = scaled(pa.array([r["embedding"] for r in ordered], pa.list_(pa.float64())), length, largest_entry(length // PARTS))
    return Books([Part([p], grouped(p)) for p in np.split(x, PARTS, axis=1)])


_STATE = ["codes", "error", "low", "stamp", "computed"]


def _assigned(state: DataFrame, books: Books, width: int) -> DataFrame:
    """The state after one assignment to the newest codebooks."""
    names = [c for c in state.columns if c not in _STATE]
    fresh = len(books.parts[0].books) == 1
    groups = [int(p.group.max()) + 1 for p in books.parts]
    ends = np.cumsum([0, *groups])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int64).reshape(n, PARTS * width)
            if fresh:
                codes, low, stamp = np.zeros((n, PARTS), np.uint8), np.zeros((n, ends[-1])), np.zeros((n, ends[-1]), np.uint8)
            else:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, PARTS)
                low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.float32).reshape(n, -1)
                stamp = np.frombuffer(b"".join(batch.column("stamp").to_pylist()), np.uint8).reshape(n, -1)
            out_codes, error, computed = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64), 0
            out_low, out_stamp = np.empty((n, ends[-1]), np.float32), np.empty((n, ends[-1]), np.uint8)
            for i, part in enumerate(books.parts):
                own, cut = x[:, i * width : (i + 1) * width], slice(ends[i], ends[i + 1])
                entry, best, bound, when, work = part.assign(own, codes[:, i], low[:, cut], stamp[:, cut])
                out_codes[:, i], out_stamp[:, cut], error, computed = entry, when, error + best, computed + work
                # float32 keeps 24 bits; the next smaller number is never above the bound.
                out_low[:, cut] = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))
            work = np.zeros(n, np.int64)
            work[:1] = computed
            new = [pa.array([r.tobytes() for r in out_codes], pa.binary()), pa.array(error)]
            new += [pa.array([r.tobytes() for r in m], pa.binary()) for m in (out_low, out_stamp)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new, pa.array(work)], [*names, *_STATE])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields if f.name in names)
    return state.mapInArrow(run, f"{kept}, codes binary, error long, low binary, stamp binary, computed long")


def _moved(state: DataFrame, books: Books, width: int) -> None:
    """Append the next codebooks: whole means of the parts at each entry, rounded down; unused entries stay.

    Tasks add up their rows, so what is shuffled and sent to the driver is as large as the codebooks.
    """

    def run(batches):
        sums, counts = np.zeros((PARTS, ENTRIES, width), object), np.zeros((PARTS, ENTRIES), np.int64)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64).reshape(batch.num_rows, PARTS, width)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, PARTS)
            for i in range(PARTS):
                order = np.argsort(codes[:, i], kind="stable")
                used, at = np.unique(codes[order, i], return_index=True)
                if len(used):
                    # Runs of a batch fit 64 bits; their totals are Python integers.
                    sums[i, used] += np.add.reduceat(x[order, i], at, axis=0).astype(object)
                counts[i] += np.bincount(codes[:, i], minlength=ENTRIES)
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(-1, width), len(part))
        values = [Decimal(int(v)) for p, e in zip(part, entry) for v in (counts[p, e], *sums[p, e])]
        arrays = [pa.array(np.repeat(part, width + 1), pa.int32()), pa.array(np.repeat(entry, width + 1), pa.int32()), pa.array(place, pa.int32())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(values, pa.decimal128(38, 0))], ["part", "entry", "place", "v"])

    parts = state.select("x", "codes").mapInArrow(run, "part int, entry int, place int, v decimal(38,0)")
    totals = {tuple(r)[:3]: int(r["v"]) for r in parts.groupBy("part", "entry", "place").agg(F.sum("v").alias("v")).collect()}
    for i, part in enumerate(books.parts):
        book = part.books[-1].copy()
        for e in range(len(book)):
            if (i, e, -1) in totals:
                book[e] = [totals[i, e, d] // totals[i, e, -1] for d in range(width)]
        part.books.append(book)


def compress(vectors: DataFrame, carry: Sequence[str] = (), rounds: int = ROUNDS) -> tuple[DataFrame, Books | None]:
    """(vec_id, the columns of `carry`, code, error, computed; and the codebooks).

    `code` holds one byte per part, `error` the summed squared distance of the parts to their entries, and
    `computed` (one row of a batch has it) how many distances the last assignment computed beside the own ones.
    Rows without a usable vector (`entries.usable`; the length must divide by four) are left out, rows that
    share a vec_id are coded alone, a null vec_id stays null, other columns are ignored. Entries beyond
    `largest_entry` count as that. Each round's state is written to the shared folder. An empty table gives no
    rows and no codebooks.
    """
    spark = vectors.sparkSession
    rows, length = usable(vectors, PARTS)
    names = ["vec_id", *carry]
    if not length:
        return rows.where("false").select(*names, F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("computed")), None
    width = length // PARTS
    limit = largest_entry(width)

    def whole(batches):
        for batch in batches:
            x = scaled(batch.column(batch.num_columns - 1), length, limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([v.tobytes() for v in x], pa.binary())], [*own, "x"])

    own = [f"c{i}" for i in range(len(names))]  # so that no carried name clashes with the state's
    picked = rows.select(*[F.col(c).alias(o) for c, o in zip(names, own, strict=True)], "embedding")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    books = _start(rows, length)
    state = write_table(picked.mapInArrow(whole, f"{kept}, x binary"), scratch_path(spark, "entries"))
    for _ in range(rounds):
        state = write_table(_assigned(state, books, width), scratch_path(spark, "assigned"))
        _moved(state, books, width)
    state = write_table(_assigned(state, books, width), scratch_path(spark, "assigned"))
    back = [F.col(o).alias(c) for c, o in zip(names, own, strict=True)]
    return state.select(*back, F.col("codes").alias("code"), "error", "computed"), books


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """The coded rows with `decoded`, the entries that stand for each vector, in the vectors' own scale."""
    final = [p.books[-1] for p in books.parts]

    def run(batches):
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, PARTS)
            x = np.hstack([b[code[:, i]] for i, b in enumerate(final)]) / 1024
            flat = pa.array(x.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)
    return codes.mapInArrow(run, f"{kept}, decoded array<double>")
