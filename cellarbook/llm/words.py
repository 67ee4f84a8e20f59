"""Words of whole Arrow string columns, found and hashed with array arithmetic on the UTF-8 bytes.

White space is the six ASCII characters (space and U+0009 to U+000D), so words are the matches of
`[^\\x20\\x09-\\x0D]+`. A word's 64-bit hash depends on its bytes alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20_240_611))
_BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD1342543DE82EF95  # odd, so that its powers have inverses modulo 2**64
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSES
    if len(_POWERS) < length:
        size = max(1 << (length - 1).bit_length(), 1 << 20)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        back[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(steps), np.multiply.accumulate(back)
    return _POWERS, _INVERSES


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (shifts and odd multiples)."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0x9FB21C651E98DF25)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xA24BAED4963EE407)
    return values ^ (values >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offset of each text and of the end); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most_bytes: int = 1 << 21):
    """(first row, rows, bytes, offsets) of runs of texts of about `most_bytes`; a longer text is a run of its own."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(column)
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        yield row, end - row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in `inside`, cut before each True of `cuts` as well."""
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cuts))
    stop = np.zeros(len(inside) + 1, bool)
    stop[1:-1] = inside[:-1] & (~inside[1:] | cuts[1:])
    stop[-1] = len(inside) > 0 and inside[-1]
    return starts, np.flatnonzero(stop)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverses[starts])


#: Bits of a word's first n bytes.
KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def digest_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digest of each span of bytes, without the patterns that `hash_spans` takes for one another.

    Up to sixteen bytes are scrambled whole, as their first and last eight; longer spans go through blake2b.
    """
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on, without a copy
    kept = KEPT[np.minimum(lengths, 8)]
    head, tail = eight[starts] & kept, eight[np.maximum(ends - 8, starts)] & kept
    out = mix(mix(head + lengths.astype(np.uint64) * np.uint64(0x9E6C63D0876A9A35)) * np.uint64(0xB5026F5AA96619E9) + tail)
    long = np.flatnonzero(lengths > 16)
    if len(long):
        raw = data.tobytes()
        spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in spans]
    return out


def hash_windows(data: np.ndarray, width: int) -> np.ndarray:
    """`hash_spans` of every run of `width` bytes."""
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * powers[: len(data)], out=sums[1:])
    runs_of_width = sums[width:] - sums[: len(sums) - width]
    return mix(runs_of_width * inverses[: len(runs_of_width)])


@dataclass
class Words:
    """Words of a run of texts: byte spans, hashes, and the first word of each text (and the end)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, digests: bool = False) -> Words:
    """Words of texts laid end to end; none reaches over the end of a text. `lower`: A-Z hash as a-z.

    With `digests` the hashes are those of `digest_spans`.
    """
    cuts = np.zeros(len(data), bool)
    inner = offsets[offsets < len(data)]
    cuts[inner] = True
    starts, ends = runs(~SPACE[data], cuts)
    hashes = (digest_spans if digests else hash_spans)(LOWER[data] if lower else data, starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every span, one span after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
