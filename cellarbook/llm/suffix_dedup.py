"""Bytes of repeated passages, found by sorting suffixes in ranges of their leading bytes.

Suffixes that agree in their first `length` bytes share their leading part (`suffix_sort`), a string of half the
length. Documents are dealt into chunks, which are small against the corpus. Then

1. chunks send the hashes of their leading parts, each once; parts that only one document has are done with.
   The hash only leaves out; nothing is removed because of it;
2. chunks send the bytes around every other leading part to the range it falls into, by splitters from a sample.
   A range sorts the suffixes in them, and returns the smallest document that starts with the same bytes. As equal
   suffixes share the leading part, and a splitter falls between two parts, none are equal across a boundary;
3. chunks mark what is covered.

Equal bytes leave a chunk once, with their smallest document, so a passage that very many documents share is
sent once per chunk. Around a leading part of very many documents, whose borders differ, suffixes are dealt one
by one by all their bytes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm.suffix_sort import HASH_BITS, Stretches, least_owner, stretches
from cellarbook.llm.words import ragged
from cellarbook.llm.words import runs as runs_of

LENGTH = 50
CHUNK_BYTES = 1 << 22
SAMPLE = 16_384  # leading parts that splitters are chosen from
RANGES = 16  # ranges of leading parts that share a bucket; shared parts are not spread like all parts
HOT = 1024  # documents with one leading part, beyond which its suffixes are dealt one by one
LAST = 2**63 - 1  # place of a document without doc_id

_SENT = "bucket int, chunk long, hashes binary, counts binary"
_SHARED = "chunk long, hashes binary, hot binary"
_PIECES = "bucket int, chunk long, place binary, owner binary, size binary, bytes binary, hot binary"
_FOUND = "chunk long, place binary, size binary, runs binary, run binary, least binary, hot binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


def _short(hashes: np.ndarray) -> bytes:
    """Hashes as HASH_BITS bits each."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]).tobytes()


def _long(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, HASH_BITS // 8)
    return np.hstack([raw, np.zeros((len(raw), 8 - HASH_BITS // 8), np.uint8)]).view("<u8").ravel()


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


class Chunk:
    """Texts of a chunk laid end to end, in order of place and text."""

    def __init__(self, docs: pa.Table, length: int):
        docs = docs.sort_by([("place", "ascending"), ("text", "ascending")])
        self.ids, self.place = docs["doc_id"], docs["place"].to_numpy()
        texts = [t or b"" for t in docs["text"].to_pylist()]
        self.raw, self.length = b"".join(texts), length
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
        self.cuts: Stretches = stretches(np.frombuffer(self.raw, np.uint8), self.offsets, length)

    def leads(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes of leading parts, how many documents have each, up to 255)."""
        s = self.cuts
        place = self.place[s.text]
        order = np.lexsort((place, s.hash))
        h, p = s.hash[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        other = new.copy()
        other[1:] |= p[1:] != p[:-1]
        heads = np.flatnonzero(new)
        return h[heads], np.minimum(np.add.reduceat(other, heads, dtype=np.int64) if len(heads) else heads, 255).astype(np.uint8)

    def pieces(self, chosen: np.ndarray, hot: np.ndarray):
        """(start, end, document's place, leading part's start or -1) of chosen stretches; hot ones suffix by suffix."""
        s, at = self.cuts, np.flatnonzero(chosen)
        columns = s.first[at], s.last[at] + self.length, self.place[s.text[at]], np.where(hot[at], -1, s.lead[at])
        for a, b, place, lead in zip(*(c.tolist() for c in columns), strict=True):
            if lead >= 0:
                yield a, b, place, lead
            else:
                for first in range(a, b - self.length + 1):
                    yield first, first + self.length, place, lead


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted known ones, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _send_leads(chunk: int, docs: pa.Table, length: int, buckets: int) -> pa.Table:
    hashes, counts = Chunk(docs, length).leads()
    edges = np.searchsorted(hashes, [(i << HASH_BITS) // buckets for i in range(buckets)] + [1 << HASH_BITS])
    rows = [(b, chunk, _short(hashes[x:y]), counts[x:y].tobytes()) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
    return _table(_SENT, rows)


def _shared_leads(sent: pa.Table) -> pa.Table:
    """To each chunk, which of its leading parts other documents have as well, and which are hot."""
    parts = sent["hashes"].to_pylist()
    hashes, counts = _long(parts), _column(sent, "counts", np.uint8).astype(np.int64)
    distinct, at = np.unique(hashes, return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(distinct))[at]
    ends = np.cumsum([len(p) // (HASH_BITS // 8) for p in parts])
    rows = []
    for chunk, a, b in zip(sent["chunk"].to_pylist(), [0, *ends[:-1]], ends, strict=True):
        kept = total[a:b] >= 2
        if kept.any():
            rows.append((chunk, _short(hashes[a:b][kept]), (total[a:b][kept] > HOT).tobytes()))
    return _table(_SHARED, rows)


def _send_pieces(chunk: int, docs: pa.Table, shared: pa.Table, length: int, splitters: list[bytes], buckets: int) -> pa.Table:
    """The bytes around each chosen leading part, once, with their smallest document; and which parts are hot."""
    if not shared.num_rows:
        return _table(_PIECES, [])
    own = Chunk(docs, length)
    hashes, hot = _long(shared["hashes"].to_pylist()), _column(shared, "hot", bool)
    chosen, single = _among(own.cuts.hash, np.sort(hashes)) >= 0, _among(own.cuts.hash, np.sort(hashes[hot])) >= 0
    seen, out = set(), [([], [], [], []) for _ in range(buckets)]
    for a, b, place, lead in own.pieces(chosen, single):
        piece = own.raw[a:b]
        if piece not in seen:  # documents come in order, so the first one has the smallest place
            seen.add(piece)
            to = out[zlib.crc32(piece) % buckets if lead < 0 else bisect_right(splitters, own.raw[lead : lead + length // 2]) % buckets]
            to[0].append(a)
            to[1].append(place)
            to[2].append(b - a)
            to[3].append(piece)
    pack = zstandard.ZstdCompressor(level=1).compress
    rows = [
        (n, chunk, np.array(o[0], "<u4").tobytes(), np.array(o[1], "<i8").tobytes(), np.array(o[2], "<u2").tobytes(), pack(b"".join(o[3])), None)
        for n, o in enumerate(out)
        if o[0]
    ]
    if hot.any():
        rows.append((chunk % buckets, chunk, b"", b"", b"", pack(b""), _short(hashes[hot])))
    return _table(_PIECES, rows)


def _least_owners(sent: pa.Table, length: int) -> pa.Table:
    """Sort one range's suffixes, and tell each chunk of pieces that a smaller document has in part or whole."""
    owner, sizes = _column(sent, "owner", "<i8"), _column(sent, "size", "<u2").astype(np.int64)
    unpack = zstandard.ZstdDecompressor().decompress
    ends, blob = np.cumsum(sizes), b"".join(map(unpack, sent["bytes"].to_pylist()))
    number: dict[bytes, int] = {}
    spans = zip((ends - sizes).tolist(), ends.tolist(), strict=True)
    which = np.fromiter((number.setdefault(blob[a:b], len(number)) for a, b in spans), np.int64, len(sizes))
    least = np.full(len(number), LAST)
    np.minimum.at(least, which, owner)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in number], dtype=np.int64)]).astype(np.int64)
    found, first = least_owner(np.frombuffer(b"".join(number), np.uint8), offsets, least, length)
    # Runs of suffixes of a piece with the same owner.
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[first[:-1]] = True
    heads = np.flatnonzero(new)
    run_sizes, run_least, run_first = np.diff(np.concatenate([heads, [len(found)]])), found[heads], np.searchsorted(heads, first)
    smallest = np.minimum.reduceat(found, first[:-1]) if len(found) else found
    place, rows, begin = _column(sent, "place", "<u4"), [], 0
    for chunk, raw, hot in zip(*(sent[c].to_pylist() for c in ("chunk", "size", "hot")), strict=True):
        at = np.arange(begin, begin + len(raw) // 2)
        begin += len(at)
        at = at[smallest[which[at]] < owner[at]]
        if len(at) or hot:
            runs = run_first[which[at] + 1] - run_first[which[at]]
            own = ragged(run_first[which[at]], runs)
            parts = (place[at], sizes[at].astype("<u2"), runs.astype("<u2"), run_sizes[own].astype("<u2"), run_least[own].astype("<i8"))
            rows.append((chunk, *(p.tobytes() for p in parts), hot))
    return _table(_FOUND, rows)


def _covered(own: Chunk, found: pa.Table) -> np.ndarray:
    """Which bytes of a chunk are covered by a suffix's first bytes that a smaller document has as well."""
    place, size = _column(found, "place", "<u4").astype(np.int64), _column(found, "size", "<u2").astype(np.int64)
    runs, run, least = _column(found, "runs", "<u2").astype(np.int64), _column(found, "run", "<u2").tolist(), _column(found, "least", "<i8").tolist()
    ends = np.cumsum(runs)
    told = {
        own.raw[a : a + z]: [(run[k], least[k]) for k in range(e - r, e)]
        for a, z, e, r in zip(place.tolist(), size.tolist(), ends.tolist(), runs.tolist(), strict=True)
    }
    # Of pieces that nothing was said about, the chunk's own first document is the smallest.
    hashes, counts = own.leads()
    said = np.unique(own.cuts.hash[np.searchsorted(own.cuts.first, place, "right") - 1])
    chosen = np.union1d(hashes[counts > 1], said)
    hot = np.sort(_long([h for h in found["hot"].to_pylist() if h]))
    starts, ends, first = [], [], {}
    for a, b, mine, _ in own.pieces(_among(own.cuts.hash, chosen) >= 0, _among(own.cuts.hash, hot) >= 0):
        piece = own.raw[a:b]
        if (about := told.get(piece)) is None:
            if first.setdefault(piece, mine) < mine:
                starts.append(a)
                ends.append(b)
        else:
            for n, smallest in about:
                if smallest < mine:
                    starts.append(a)
                    ends.append(a + n - 1 + own.length)
                a += n
    edge = np.zeros(len(own.raw) + 1, np.int64)
    np.add.at(edge, np.array(starts, np.int64), 1)
    np.add.at(edge, np.array(ends, np.int64), -1)
    return np.cumsum(edge[:-1]) > 0


def _results(docs: pa.Table, found: pa.Table, length: int) -> pa.Table:
    own = Chunk(docs, length)
    gone = _covered(own, found)
    cuts = np.zeros(len(gone), bool)
    cuts[own.offsets[own.offsets < len(gone)]] = True
    starts, ends = runs_of(gone, cuts)
    begin = np.searchsorted(starts, own.offsets)
    base = np.repeat(own.offsets[:-1], np.diff(begin))
    spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], names=["start", "end"])
    left = np.frombuffer(own.raw, np.uint8)[~gone].tobytes()
    kept = np.concatenate([[0], np.cumsum(~gone)])[own.offsets]
    arrays = [
        own.ids.combine_chunks(),
        pa.array(np.diff(own.offsets), pa.int64()),
        pa.ListArray.from_arrays(pa.array(begin, pa.int32()), spans),
        pa.array([left[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary()),
    ]
    return pa.Table.from_arrays(arrays, schema=_OUT)


def _splitters(rows: DataFrame, count: int, length: int, ranges: int) -> list[bytes]:
    """Ends of ranges of leading parts with about equal shares.

    They are chosen from one place of about SAMPLE texts, or four a range; results do not depend on them.
    """
    most = max(SAMPLE, 4 * ranges)
    at = F.expr(f"1 + pmod(xxhash64(text, doc_id), greatest(octet_length(text) - {length // 2}, 1))")
    some = rows.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(max(1, count // most))) == 0)
    part = some.select(F.substring("text", at, F.lit(length // 2)).alias("part")).distinct().limit(2 * most)
    sample = sorted(bytes(r["part"]) for r in part.collect())
    return sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if sample else []


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans and kept: the text's bytes without those that repeat a smaller document.

    A byte goes if it is among `length` bytes that also start at some byte of a document with a smaller doc_id,
    all judged on the input. `spans` are the maximal removed runs (start, end exclusive), `kept` the other bytes,
    which may end inside a character. A null or empty text has none. Rows that share a doc_id are no smaller
    than each other and all compared with the others; a row without doc_id comes after all others. Other columns
    are ignored, an empty table gives no rows.

    One exchange deals the texts into chunks of about `chunk_bytes`, and is used three times.
    """
    spark = docs.sparkSession
    ids = F.col("doc_id").cast("long")
    rows = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(LAST)).alias("place"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * parts, -(-size // chunk_bytes))
    parts = max(parts, chunks // 2)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))).repartition(parts, "chunk")
    splitters = _splitters(rows, count, length, RANGES * parts)

    def send_leads(key, table):
        return _send_leads(key[0].as_py(), table, length, parts)

    def send_pieces(key, table, shared):
        return _send_pieces(key[0].as_py(), table, shared, length, splitters, parts)

    sent = dealt.groupBy("chunk").applyInArrow(send_leads, _SENT)
    shared = sent.groupBy("bucket").applyInArrow(lambda table: _shared_leads(table), _SHARED)
    pieces = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send_pieces, _PIECES)
    found = pieces.groupBy("bucket").applyInArrow(lambda table: _least_owners(table, length), _FOUND)
    out = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return dealt.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(lambda table, told: _results(table, told, length), out)
