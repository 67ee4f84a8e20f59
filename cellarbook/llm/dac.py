"""Directly addressable codes of unsigned integers (one blob per array).

A value is split into chunks of a few bits. Level 0 holds the lowest chunk of every value; a bitmap says which
values go on, and level 1 holds the next chunk of just those, and so on. A rank directory over each bitmap
(ones before every 512th bit) gives a value's place in the next level, so any value is read on its own.

Blob, little-endian: b"DAC1", u32 values, u8 levels, u8 width of each level; then for each level its chunks
(4, 8, 12 or 16 bits each) and, for all but the last, the bitmap and the u32 rank directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"
WIDTHS = (4, 8, 12, 16)
RANK_BITS = 512


def choose_widths(values: np.ndarray) -> list[int]:
    """The level widths that take the fewest bits for these values."""
    bits = np.zeros(len(values), np.int64)
    for shift in range(0, 32, 4):
        bits[values >> np.uint32(shift) > 0] = shift + 4
    longer = {b: int((bits > b).sum()) for b in range(0, 36, 4)}
    longer[0] = len(values)
    top = max(4, int(bits.max(initial=4)))
    best: dict[int, tuple[float, list[int]]] = {}
    for done in range(32, -1, -4):  # bits below `done` are coded already
        if done >= top:
            best[done] = (0, [])
            continue
        options = []
        for w in WIDTHS:
            after = min(done + w, 32)
            cost, rest = best[after]
            own = longer[done] * (w + (1 + 32 / RANK_BITS) * (after < top))
            options.append((own + cost, [w, *rest]))
        best[done] = min(options)
    return best[0][1]


def _pack(chunks: np.ndarray, width: int) -> bytes:
    if width == 8:
        return chunks.astype("u1").tobytes()
    if width == 16:
        return chunks.astype("<u2").tobytes()
    even = np.zeros(len(chunks) + len(chunks) % 2, np.uint32)
    even[: len(chunks)] = chunks
    pair = even[0::2] | (even[1::2] << np.uint32(width))
    if width == 4:
        return pair.astype("u1").tobytes()
    return pair.astype("<u4").view("u1").reshape(-1, 4)[:, :3].tobytes()


def _unpack(data: np.ndarray, width: int, count: int) -> np.ndarray:
    if width == 8:
        return data.astype(np.uint32)
    if width == 16:
        return data.view("<u2").astype(np.uint32)
    out = np.empty(2 * (-(-count // 2)), np.uint32)
    if width == 4:
        out[0::2], out[1::2] = data & 15, data >> 4
    else:
        three = data.reshape(-1, 3).astype(np.uint32)
        out[0::2] = three[:, 0] | ((three[:, 1] & 15) << 8)
        out[1::2] = (three[:, 1] >> 4) | (three[:, 2] << 4)
    return out[:count]


def _bytes_of(count: int, width: int) -> int:
    return count if width == 8 else 2 * count if width == 16 else (-(-count // 2)) * (1 if width == 4 else 3)


def encode(values: np.ndarray) -> bytes:
    values = values.astype(np.uint32)
    widths = choose_widths(values)
    parts = [MAGIC, struct.pack("<IB", len(values), len(widths)), bytes(widths)]
    for level, width in enumerate(widths):
        parts.append(_pack(values & np.uint32((1 << width) - 1), width))
        values = values >> np.uint32(width)
        if level < len(widths) - 1:
            on = values > 0
            ones = np.add.reduceat(on, np.arange(0, len(on), RANK_BITS)) if len(on) else np.zeros(0, int)
            parts += [np.packbits(on, bitorder="little").tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            values = values[on]
    return b"".join(parts)


class Codes:
    """A blob opened for reading."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a DAC1 blob")
        self.count, levels = struct.unpack_from("<IB", blob, 4)
        self.widths = list(blob[9 : 9 + levels])
        data, at, count = np.frombuffer(blob, "u1"), 9 + levels, self.count
        self.levels = []
        for level, width in enumerate(self.widths):
            size = _bytes_of(count, width)
            chunks, at = data[at : at + size], at + size
            bitmap = ranks = None
            if level < levels - 1:
                bitmap, at = data[at : at + -(-count // 8)], at + -(-count // 8)
                blocks = -(-count // RANK_BITS)
                ranks, at = np.frombuffer(blob, "<u4", blocks, at), at + 4 * blocks
            self.levels.append((chunks, bitmap, ranks, count))
            if bitmap is not None:
                count = int(np.unpackbits(bitmap, count=count, bitorder="little").sum())

    def all(self) -> np.ndarray:
        """Every value, level by level."""
        out, places, shift = np.zeros(self.count, np.uint32), slice(None), 0
        for (chunks, bitmap, _, count), width in zip(self.levels, self.widths, strict=True):
            out[places] |= _unpack(chunks, width, count) << np.uint32(shift)
            if bitmap is not None:
                on = np.flatnonzero(np.unpackbits(bitmap, count=count, bitorder="little"))
                places = on if isinstance(places, slice) else places[on]
            shift += width
        return out

    def at(self, i: int) -> int:
        """One value; reads a few bytes of each level and nothing else."""
        if not 0 <= i < self.count:
            raise IndexError(i)
        value = shift = 0
        for (chunks, bitmap, ranks, _), width in zip(self.levels, self.widths, strict=True):
            if width == 8:
                chunk = int(chunks[i])
            elif width == 16:
                chunk = int(chunks[2 * i]) | int(chunks[2 * i + 1]) << 8
            elif width == 4:
                chunk = int(chunks[i // 2]) >> (4 * (i % 2)) & 15
            else:
                three = chunks[3 * (i // 2) : 3 * (i // 2) + 3]
                chunk = int.from_bytes(three.tobytes(), "little") >> (12 * (i % 2)) & 4095
            value |= chunk << shift
            shift += width
            if bitmap is None or not int(bitmap[i // 8]) >> (i % 8) & 1:
                break
            block = i // RANK_BITS
            head = bitmap[block * RANK_BITS // 8 : i // 8 + 1].copy()
            head[-1] &= (1 << (i % 8)) - 1
            i = int(ranks[block]) + int(np.unpackbits(head).sum())
        return value
