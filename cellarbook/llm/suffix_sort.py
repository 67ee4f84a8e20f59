"""Suffixes that start at chosen bytes: which ones, and sorting them by their first bytes.

`stretches` cuts the suffixes of texts into runs whose first `length` bytes have the same leading part: the
window of `lead` bytes among them with the smallest hash (of equals the leftmost). Suffixes with equal first
bytes have equal leading parts, wherever they stand, so they can be brought together by that part alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cellarbook.llm.words import hash_windows, ragged

BLOCK = 1 << 20
HASH_BITS = 48


@dataclass
class Stretches:
    """Runs of suffixes: text, first and last start, start of the leading part, and its hash (of HASH_BITS bits)."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lead: np.ndarray
    hash: np.ndarray


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys."""
    span = 1
    while span * 2 <= width:
        keys, span = np.minimum(keys[:-span], keys[span:]), span * 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if width > span else keys


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> Stretches:
    """Stretches of all suffixes with `length` bytes or more of texts laid end to end, in order of place.

    Work is done in blocks of bytes, whatever the texts' lengths; a stretch over a block's end becomes two.
    """
    lead, n = length // 2, len(data)
    short = np.zeros(n + 1, np.int8)  # 1 where a text has less than `length` bytes left
    nonempty = np.diff(offsets) > 0
    ends, starts = offsets[1:][nonempty], offsets[:-1][nonempty]
    short[np.maximum(starts, ends - length + 1)] += 1
    short[ends] -= 1
    short = np.cumsum(short[:n], dtype=np.int8)
    low = np.uint64(0xFFFFFFFF)
    parts = []
    for a in range(0, n, BLOCK):
        piece = data[a : a + BLOCK + length - 1]
        if len(piece) < length:
            break
        hashes = hash_windows(piece, lead)
        least = _smallest((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - lead + 1)[:BLOCK]
        start = np.flatnonzero(short[a : a + len(least)] == 0)
        if not len(start):
            continue
        anchor = (least[start] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = start[np.concatenate([new[1:] - 1, [len(start) - 1]])]
        parts.append((start[new] + a, last + a, anchor[new] + a, hashes[anchor[new]] >> np.uint64(64 - HASH_BITS)))
    if not parts:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none, none.astype(np.uint64))
    first, last, anchor, hashes = (np.concatenate(p) for p in zip(*parts, strict=True))
    return Stretches(np.searchsorted(offsets, first, "right") - 1, first, last, anchor, hashes)


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as one number that orders like them."""
    return data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)


def sort_suffixes(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes by their first `length` bytes, whether each differs in them from the one before).

    Multikey quicksort with eight bytes as a letter: all are split by their first letter, and only runs that
    agree so far are split by the next one.
    """
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    new[:1] = True
    tied = np.arange(len(starts))
    for place in range(0, length, 8):
        place = max(0, min(place, length - 8))  # the last letter may overlap the one before, which is equal
        own = order[tied]
        letters = _words(data, starts[own] + place)
        if length < 8:
            letters >>= np.uint64(8 * (8 - length))
        run = np.cumsum(new)[tied]
        by = np.lexsort((letters, run)) if place else np.argsort(letters, kind="stable")
        order[tied] = own[by]
        letters = letters[by]
        new[tied[1:]] |= (letters[1:] != letters[:-1]) | (run[1:] != run[:-1])
        alone = new & np.concatenate([new[1:], [True]])
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
    return order, new


def least_owner(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(for each suffix of pieces laid end to end the smallest owner of an equal one, first suffix of each piece)."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    starts = ragged(offsets[:-1], counts)
    order, new = sort_suffixes(data, starts, length)
    out = np.empty(len(starts), np.int64)
    if len(starts):
        own = np.repeat(owner, counts)[order]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([heads, [len(starts)]]))
        out[order] = np.repeat(np.minimum.reduceat(own, heads), sizes)
    return out, np.concatenate([[0], np.cumsum(counts)])
