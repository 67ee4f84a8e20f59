"""Elements of large JSON arrays, from documents that are split over tasks.

A document is read in pieces that end at a closing brace, which every scan task finds in its own part of the
file. Whether a piece begins inside a string follows from the number of quotes before it, how deep it begins from
the brackets before it; both are sums, taken over blocks first and then within them. An element ends where
the depth is that of the array again, and the pieces between two ends are put together.

A task has its blocks' pieces in order, so it puts elements together as it reads. Only sums of blocks, and elements that
reach over a block's end, are stored or shuffled; the text is not, it is read again instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellarbook.operators.joins import fits_broadcast
from cellarbook.session import scratch_path
from cellarbook.sources.records import BLOCK, FILE, LINE
from cellarbook.sources.sinks import write_table

_PLACE = f"{FILE} string, {BLOCK} long"
_SUMS = f"{_PLACE}, _quotes long, _step0 long, _step1 long"
_ELEMENT = f"value string, {_PLACE}, {LINE} long, _entering boolean"
#: A block's text up to its first element (NULL: none) and from its last one on, and whether that lies in the member.
_ENDS = f"{_PLACE}, _head string, _tail string, {LINE} long, _entering boolean, _wanted int"
_SPECIAL = np.isin(np.arange(256), list(b'"[{]'))


def _looked_at(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece the parity of its quotes, and its brackets' depth if it begins outside or inside a string.

    What a backslash escapes counts for nothing.
    """
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    at = np.flatnonzero(_SPECIAL[data])
    slashes = np.flatnonzero(data == ord("\\"))
    if len(slashes):
        piece = np.searchsorted(offsets, slashes, "right")
        new = np.r_[True, (np.diff(slashes) > 1) | (np.diff(piece) > 0)]
        first = np.flatnonzero(new)
        length = np.diff(np.r_[first, len(slashes)])
        after = slashes[first] + length
        after = after[(length % 2 == 1) & (after < offsets[piece[first]])]
        at = at[~np.isin(at, after)]
    kind = data[at]
    bounds = np.searchsorted(at, offsets)
    before = np.r_[0, np.cumsum(kind == ord('"'))]
    quotes = np.diff(before[bounds])
    inside = (before[:-1] - np.repeat(before[bounds[:-1]], np.diff(bounds))) % 2
    step = np.where(kind == ord("]"), -1, 1) * (kind != ord('"'))
    deep = [np.diff(np.r_[0, np.cumsum(step * (inside == state))][bounds]) for state in (0, 1)]
    return quotes % 2, deep[0], deep[1]


def _steps(looked: tuple[np.ndarray, ...], odd: int) -> tuple[np.ndarray, int]:
    """(Change of depth by each piece, parity of quotes after the last); the brace that ends a piece counts outside strings."""
    quotes, deep0, deep1 = looked
    ends = (odd + np.cumsum(quotes)) % 2
    begins = np.r_[odd, ends[:-1]]
    return np.where(begins == 0, deep0, deep1) - (ends == 0), int(ends[-1])


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that lie in one block each."""
    if not batch.num_rows:
        return
    file = batch.column(FILE).dictionary_encode().indices.to_numpy()
    block = batch.column(BLOCK).to_numpy()
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for start, stop in zip(np.r_[0, cuts].tolist(), np.r_[cuts, batch.num_rows].tolist(), strict=True):
        part = batch.slice(start, stop - start)
        yield (part.column(FILE)[0].as_py(), part.column(BLOCK)[0].as_py()), part


def _made(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the parity of its quotes, and its change of depth if it begins outside or inside a string."""
    schema = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), ("_quotes", pa.int64()), ("_step0", pa.int64()), ("_step1", pa.int64())])
    at, odd, step = None, 0, [0, 0]
    for batch in batches:
        for place, part in _blocks(batch):
            if place != at:
                if at:
                    yield _made([(*at, odd, *step)], schema)
                at, odd, step = place, 0, [0, 0]
            looked = _looked_at(part.column("value"))
            changes = [_steps(looked, (odd + state) % 2) for state in (0, 1)]
            step = [s + int(c.sum()) for s, (c, _) in zip(step, changes, strict=True)]
            odd = changes[0][1]
    if at:
        yield _made([(*at, odd, *step)], schema)


class _Pieces:
    """Puts the pieces of one block after another together."""

    def __init__(self, member: str | None):
        self.level = 1 if member is None else 2
        self.member = member
        if member is not None:
            self.name = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*\[\s*\{', re.ASCII)
            self.before = re.compile(rf'(?s)^.*?"{member}"\s*:\s*\[\s*(?=\{{)', re.ASCII)

    def begin(self, place: tuple[str, int], odd: int | None, depth: int | None, wanted: int | None) -> None:
        if odd is None or depth is None:
            raise RuntimeError(f"{place} is no part of its file as it was looked at first; read it again")
        self.place, self.odd, self.depth, self.wanted = place, odd, depth, wanted
        # Of the element that is not at its end: pieces, line (None: it began in an earlier block), entering, wanted.
        self.open: tuple[list[pa.Array], int | None, bool, int | None] = ([], None, False, wanted)

    def text(self, closed: bool) -> str:
        """Text of the open element."""
        pieces, _, entering, _ = self.open
        values = [v for p in pieces for v in p.to_pylist()]
        if entering:
            values[0] = self.before.sub("", values[0], count=1)
        return "}".join(values) + ("}" if closed else "")

    def add(self, part: pa.RecordBatch) -> tuple[tuple | None, pa.RecordBatch | None]:
        """(What was open and has ended with its text, the elements that lie in this part)."""
        values, lines = part.column("value"), part.column(LINE)
        steps, odd = _steps(_looked_at(values), self.odd)
        depth = self.depth + np.cumsum(steps) - steps
        self.odd, self.depth = odd, self.depth + int(steps.sum())
        starts = np.flatnonzero(depth <= self.level)
        if not len(starts):
            self.open[0].append(values)
            return None, None
        if starts[0]:
            self.open[0].append(values.slice(0, starts[0]))
        ended = (self.text(True), *self.open[1:]) if self.open[0] else None
        # An element begins with a piece that is not inside one; there also the member of the root may change.
        entering = np.zeros(len(starts), bool)
        wanted = np.full(len(starts), 1 if self.member is None else -1 if self.wanted is None else self.wanted)
        if self.member is not None:
            first = values.take(pa.array(starts))
            closes = pc.match_substring_regex(first, "^[ \\t\\n\\x0B\\f\\r]*\\]").to_numpy(zero_copy_only=False)
            entering = (depth[starts] < self.level) | closes
            for i in np.flatnonzero(entering):
                if found := self.name.search(first[i].as_py()):
                    wanted[i:] = int(found[1] == self.member)
            self.wanted = None if wanted[-1] < 0 else int(wanted[-1])
        begun = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values.slice(0, starts[-1]))
        texts = pc.binary_join_element_wise(pc.binary_join(begun, "}"), "", "}")
        kept = wanted[:-1] == 1
        if (entering[:-1] & kept).any():
            texts = texts.to_pylist()
            for i in np.flatnonzero(entering[:-1] & kept):
                piece = first[i].as_py()
                texts[i] = self.before.sub("", piece, count=1) + texts[i][len(piece) :]
            texts = pa.array(texts, pa.string())
        last = None if wanted[-1] < 0 else int(wanted[-1])
        self.open = ([values.slice(starts[-1])], lines[int(starts[-1])].as_py(), bool(entering[-1]), last)
        n = int(kept.sum())
        file, block = (pa.repeat(pa.scalar(x, t), n) for x, t in zip(self.place, (pa.string(), pa.int64()), strict=True))
        columns = [texts.filter(pa.array(kept)), file, block, lines.take(pa.array(starts[:-1][kept])), pa.array(entering[:-1][kept])]
        return ended, pa.RecordBatch.from_arrays(columns, ["value", FILE, BLOCK, LINE, "_entering"])


def _states(part: pa.RecordBatch) -> tuple:
    return tuple(part.column(c)[0].as_py() for c in ("_flip", "_base", "_before"))


def _within(member: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Elements that begin and end in their block; a file that is one block ends its last element."""

    def found(batches):
        schema = pa.schema([("value", pa.string()), (FILE, pa.string()), (BLOCK, pa.int64()), (LINE, pa.int64()), ("_entering", pa.bool_())])
        pieces, at, alone = _Pieces(member), None, False

        def left():
            # What follows the last brace of a file is closed by none.
            if at and alone and pieces.open[1] is not None and pieces.open[3] == 1:
                yield _made([(pieces.text(False), *at, *pieces.open[1:3])], schema)

        for batch in batches:
            for place, part in _blocks(batch):
                if place != at:
                    yield from left()
                    at, alone = place, part.column("_alone")[0].as_py()
                    pieces.begin(place, *_states(part))
                ended, whole = pieces.add(part)
                if ended and ended[1] is not None and ended[3] == 1:
                    yield _made([(ended[0], *at, *ended[1:3])], schema)
                if whole is not None and whole.num_rows:
                    yield whole
        yield from left()

    return found


def _at_ends(member: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a block has of elements that may reach over its ends."""

    def found(batches):
        schema = pa.schema([(FILE, pa.string()), (BLOCK, pa.int64()), ("_head", pa.string()), ("_tail", pa.string()), (LINE, pa.int64()), ("_entering", pa.bool_()), ("_wanted", pa.int32())])
        pieces, at, head = _Pieces(member), None, None

        def left():
            if at:
                text, (_, line, entering, wanted) = pieces.text(False), pieces.open
                ends = (text, None) if line is None else (head, text)
                yield _made([(*at, *ends, line, entering, wanted)], schema)

        for batch in batches:
            for place, part in _blocks(batch):
                if place != at:
                    yield from left()
                    at, head = place, None
                    pieces.begin(place, *_states(part))
                ended, _ = pieces.add(part)
                if ended and ended[1] is None:
                    head = ended[0][:-1]  # closed once it is put together
        yield from left()

    return found


def _before(column: str) -> Column:
    so_far = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(so_far), F.lit(0))


def _with_states(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pieces with what holds where their block begins, those of a block together and in order."""
    if fits_broadcast(blocks):
        return pieces.join(F.broadcast(blocks), [FILE, BLOCK], "left")
    return pieces.join(blocks, [FILE, BLOCK], "left").repartition(FILE, BLOCK).sortWithinPartitions(FILE, BLOCK, LINE)


def _over_ends(ends: DataFrame) -> DataFrame:
    """The elements that reach up to a block's end or over it."""
    head = F.struct(F.lit(0).alias("_n"), F.col("_head").alias("value"), F.lit(None).cast("long").alias(LINE), F.lit(None).cast("boolean").alias("_entering"))
    tail = F.struct(F.lit(1).alias("_n"), F.col("_tail").alias("value"), LINE, "_entering")
    parts = ends.select(FILE, BLOCK, "_wanted", F.explode(F.array(head, tail)).alias("_p")).where("_p.value IS NOT NULL").select(FILE, BLOCK, "_wanted", "_p.*")
    in_order = Window.partitionBy(FILE).orderBy(BLOCK, "_n")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = parts.select(
        FILE,
        F.last(F.when(F.col("_n") == 1, F.struct(BLOCK, LINE)), ignorenulls=True).over(so_far).alias("_at"),
        F.when(F.col("_n") == 1, F.last("_wanted", ignorenulls=True).over(so_far)).alias("_wanted"),
        "_entering",
        F.lead(BLOCK).over(in_order).isNull().alias("_cut"),
        F.struct(BLOCK, "_n", "value").alias("_piece"),
    )
    whole = owned.groupBy(FILE, "_at").agg(
        F.array_sort(F.collect_list("_piece")).alias("_pieces"), F.max("_cut").alias("_cut"), F.max("_wanted").alias("_wanted"), F.max("_entering").alias("_entering")
    )
    joined = F.array_join(F.transform("_pieces", lambda p: p["value"]), "}")
    value = F.concat(joined, F.when(F.col("_cut"), "").otherwise("}")).alias("value")
    return whole.where("_wanted = 1").select(value, FILE, "_at", "_entering")


def elements(spark: SparkSession, paths: str | Sequence[str], member: str | None = None) -> DataFrame:
    """value, the text of every object in the root array; or, with `member`, in that array of the root object.

    A file is one document. Text that is no JSON makes elements that do not parse, from where it stands to where
    the brackets agree again. Only an element that reaches over a block's end is put together across blocks; a
    bracket that is never closed takes in the rest of its file.
    """
    pieces = spark.read.option("lineSep", "}").text(paths).select(
        "value",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(LINE),
        ((F.col("_metadata.file_block_start") == 0) & (F.col("_metadata.file_block_length") == F.col("_metadata.file_size"))).alias("_alone"),
    )
    known = pieces.withColumns({"_flip": F.lit(0), "_base": F.lit(0).cast("long"), "_before": F.lit(None).cast("int")})
    sums = pieces.where("NOT _alone").select("value", FILE, BLOCK).mapInArrow(_sums, _SUMS).repartition(FILE)
    sums = write_table(sums, scratch_path(spark, "blocks"))
    over = None
    if sums.head(1):
        blocks = sums.withColumn("_flip", F.pmod(_before("_quotes"), F.lit(2)).cast("int"))
        blocks = blocks.withColumn("_step", F.when(F.col("_flip") == 0, F.col("_step0")).otherwise(F.col("_step1")))
        blocks = blocks.select(FILE, BLOCK, "_flip", _before("_step").alias("_base"), F.lit(None).cast("int").alias("_before"))
        split = _with_states(pieces.where("NOT _alone"), write_table(blocks, scratch_path(spark, "states")))
        ends = write_table(split.mapInArrow(_at_ends(member), _ENDS).repartition(FILE), scratch_path(spark, "ends"))
        so_far = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        wanted = ends.select(FILE, BLOCK, F.last("_wanted", ignorenulls=True).over(so_far).alias("_before"))
        blocks = write_table(blocks.drop("_before").join(wanted, [FILE, BLOCK]), scratch_path(spark, "states"))
        known = _with_states(pieces, blocks).withColumns({c: F.when(F.col("_alone"), F.lit(0)).otherwise(F.col(c)) for c in ("_flip", "_base")})
        over = _over_ends(ends)
    found = known.mapInArrow(_within(member), _ELEMENT).select("value", FILE, F.struct(BLOCK, LINE).alias("_at"), "_entering")
    if over is not None:
        found = found.unionByName(over)
    if member is None:
        value = F.regexp_replace("value", r"^﻿?[\s,\[\]]+", "")
    else:
        value = F.when(F.col("_entering"), F.col("value")).otherwise(F.regexp_replace("value", r"^[\s,]+", ""))
    found = found.select(value.alias("value"), FILE, "_at")
    return found.filter(F.regexp_like("value", F.lit(r"\{" if member else r"[^\s,\[\]\}]")))


def parsed(found: DataFrame, schema: str, corrupt: str) -> DataFrame:
    """Elements by their schema; one that does not parse has its text in the column `corrupt` and NULLs elsewhere."""
    full = T.StructType.fromDDL(schema).add(corrupt, T.StringType())
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    return found.select(F.from_json("value", full, options).alias("_r")).select("_r.*")
