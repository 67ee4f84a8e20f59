"""Exact token ids of whole texts, with the ids of each distinct piece of text kept between texts.

The tokenizers used here decide ids word by word. So a text is cut where no token and no rule of the tokenizer
can reach across, each distinct piece is encoded once by the `tokenizers` library, and the ids of a text are
the pieces' ids one after the other. Where a cut may be made is part of the tokenizer's description
(`Vocabulary.cut`); without it every text goes to the library whole. So does a text that holds an added token of the
tokenizer file (as "<|endoftext|>"), which the library finds in the raw text.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np

from cellarbook.llm.words import KEPT, LOWER, SPACE, chunks, hash_spans, ragged, runs

#: Pieces kept per worker. A full table keeps the pieces met again; this bounds memory and changes no result.
TABLE_PIECES = 300_000
#: Bytes of text that a worker cuts and hashes at once; the arrays for that take many times as much.
AT_ONCE = 1 << 19
#: Pieces whose form no normalization or pre-tokenization step changes; the BPE model takes them as they are.
PLAIN = re.compile(" ?[a-z]+")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!#$%&*+,./:;?@|")] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[33:127] = True


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file, the id that ends a document, and where its texts may be cut.

    "drop_space": white space parts words and is no token, capitals count as small letters.
    "keep_space": white space belongs to the word behind it. In both, a letter and a mark (as , or &) behind
    it are never in one token. None: never cut.
    """

    path: str
    end_id: int
    cut: str | None = None


def _before(mask: np.ndarray, steps: int) -> np.ndarray:
    out = np.zeros(len(mask), bool)
    out[steps:] = mask[:-steps] if steps < len(mask) else False
    return out


def cut_pieces(data: np.ndarray, offsets: np.ndarray, cut: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pieces of texts laid end to end."""
    space = SPACE[data]
    latin = (data == 0xC3) & ~_before(np.ones(len(data), bool), len(data) or 1)
    second = _before(latin, 1) & (data != 0x97) & (data != 0xB7)  # second byte of À to ÿ, without × and ÷
    cuts = _before(_LETTER[data] | second, 1) & _MARK[data]
    if cut == "keep_space":
        # Only behind a character that is surely no white space of a rarer kind.
        two = _before((data >= 0xC3) & (data <= 0xDF), 1)
        three = _before((data >= 0xE4) & (data <= 0xED), 2)
        cuts |= _before(_PRINTED[data] | two | three, 1) & space
    cuts[offsets[offsets < len(data)]] = True
    return runs(np.ones(len(data), bool) if cut == "keep_space" else ~space, cuts)


@dataclass
class Pieces:
    """Byte spans in some texts, with what tells their bytes apart: length, first and last eight bytes.

    That is all of a piece of sixteen bytes or fewer; longer ones are compared byte by byte.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.lengths = self.ends - self.starts
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        # The eight bytes from each place on as one number, without a copy; a short piece keeps its own only.
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        kept = KEPT[np.minimum(self.lengths, 8)]
        self.head = eight[self.starts] & kept
        self.tail = eight[np.maximum(self.ends - 8, self.starts)] & kept

    def marks(self, at: np.ndarray) -> np.ndarray:
        return np.stack([self.lengths[at].astype(np.uint64), self.head[at], self.tail[at]], 1)

    def like(self, first: np.ndarray) -> np.ndarray:
        """Whether each piece has the bytes of the piece that `first` names for it."""
        same = (self.head == self.head[first]) & (self.lengths == self.lengths[first])
        more = np.flatnonzero(same & (self.lengths > 8))
        same[more] = self.tail[more] == self.tail[first[more]]
        long = more[self.lengths[more] > 16]
        long = long[same[long] & (first[long] != long)]
        if len(long):
            sizes = self.lengths[long]
            equal = self.data[ragged(self.starts[long], sizes)] == self.data[ragged(self.starts[first[long]], sizes)]
            same[long] = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
        return same


class Encoder:
    """Ids of whole texts, the end id last.

    The table of pieces is found by a hash, and every hit is compared with the bytes it stands for. A text with
    a piece whose hash another piece has goes to the library whole.
    """

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        self.cut, self.end_id = vocabulary.cut, vocabulary.end_id
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added) and self.tokenizer.normalizer is not None:
            self.cut = None  # Such a token may come up only in the normalized text.
        self.added = [t.content.encode() for t in added if t.content]
        self._clear()

    def _clear(self) -> None:
        # Hashes in ascending order with the slot of each; the other arrays go by slot.
        self.hashes, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.start, self.length, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.marks, self.long = np.zeros((0, 3), np.uint64), {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        flat, lengths = [], []
        for i in range(0, len(texts), 4096):
            for x in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False):
                ids = x.ids
                flat += ids
                lengths.append(len(ids))
        return np.array(flat, np.uint32), np.array(lengths, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.slot[at], np.int32(-1))

    def _trim(self) -> None:
        """Keep the pieces that were met again after they came in."""
        good = self.met[self.slot]
        hashes, kept = self.hashes[good], self.slot[good]
        lengths, marks, raw = self.length[kept], self.marks[kept], [self.long.get(i) for i in kept.tolist()]
        flat = self.ids[ragged(self.start[kept], lengths)]
        self._clear()
        if len(hashes) <= TABLE_PIECES // 2:
            self._store(hashes, flat, lengths, marks, raw)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], marks: np.ndarray) -> None:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        raw = [p if len(p) > 16 else None for p in pieces]
        plain = [PLAIN.fullmatch(t) is not None for t in texts]
        model, lead = self.tokenizer.model, "\u0120"  # the vocabulary's letter for a space
        easy = [[t.id for t in model.tokenize(x.replace(" ", lead))] for x, p in zip(texts, plain, strict=True) if p]
        own = np.array(plain, bool)
        if easy:
            self._store(
                hashes[own],
                np.array([i for x in easy for i in x], np.uint32),
                np.array([len(x) for x in easy], np.int64),
                marks[own],
                [r for r, p in zip(raw, plain, strict=True) if p],
            )
        if len(easy) < len(texts):
            rest = self._library([t for t, p in zip(texts, plain, strict=True) if not p])
            self._store(hashes[~own], *rest, marks[~own], [r for r, p in zip(raw, plain, strict=True) if not p])

    def _store(self, hashes: np.ndarray, flat: np.ndarray, lengths: np.ndarray, marks: np.ndarray, raw: list[bytes | None]) -> None:
        """Pieces that are not in the table yet, by ascending hash."""
        slots = np.arange(len(self.start), len(self.start) + len(hashes), dtype=np.int32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.long.update((i, r) for i, r in zip(slots.tolist(), raw, strict=True) if r is not None)
        self.marks = np.concatenate([self.marks, marks])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.slot = np.insert(self.hashes, at, hashes), np.insert(self.slot, at, slots)
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.met = np.concatenate([self.met, np.zeros(len(hashes), bool)])
        self.used += len(flat)

    def _with_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text holds an added token, in capitals or small letters as the pieces have them."""
        found = np.zeros(len(offsets) - 1, bool)
        lower = self.cut == "drop_space"
        raw = (LOWER[data] if lower else data).tobytes()
        for content in self.added:
            own = content.translate(LOWER.tobytes()) if lower else content
            at = raw.find(own)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                found[text] = True  # or it begins there and ends in the next text; then the library does no harm
                at = raw.find(own, max(at + 1, int(offsets[text + 1]) - len(own) + 1))
        return found

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        return self._library([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])

    def _in_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has, texts with a piece whose hash stands for other bytes)."""
        data = LOWER[data] if self.cut == "drop_space" else data
        starts, ends = cut_pieces(data, offsets, self.cut)
        pieces = Pieces(data, starts, ends)
        distinct, at, inverse = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        wrong = ~pieces.like(at[inverse])
        if len(self.start) > TABLE_PIECES:
            self._trim()
        slots = self._find(distinct)
        known = slots >= 0
        own = slots[known]
        self.met[own] = True
        raw = data.tobytes()
        if len(own):
            where = np.flatnonzero(known)
            hit = (self.marks[own] == pieces.marks(at[where])).all(axis=1)
            for i in np.flatnonzero(hit & (pieces.lengths[at[where]] > 16)).tolist():
                k = at[where[i]]
                hit[i] = self.long[int(own[i])] == raw[starts[k] : ends[k]]
            missed = np.zeros(len(distinct), bool)
            missed[where] = ~hit
            wrong |= missed[inverse]
        if not known.all():
            new = np.flatnonzero(~known)
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            self._learn(distinct[new], [raw[a:b] for a, b in spans], pieces.marks(at[new]))
            slots = self._find(distinct)
        slots = slots[inverse]
        piece_ids = self.length[slots]
        flat = self.ids[ragged(self.start[slots], piece_ids)]
        sums = np.concatenate([[0], np.cumsum(piece_ids)])
        first = np.searchsorted(starts, offsets)
        clashes = np.concatenate([[0], np.cumsum(wrong)])
        return flat, np.diff(sums[first]), np.diff(clashes[first]) > 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts laid end to end, first id of each text and the end)."""
        texts = len(offsets) - 1
        whole = np.ones(texts, bool) if self.cut is None else self._with_added(data, offsets)
        sizes = np.diff(offsets)

        def some(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return data[np.repeat(own, sizes)], np.concatenate([[0], np.cumsum(sizes[own])]).astype(np.int64)

        while True:
            cut = ~whole
            flat, counts, clash = self._in_pieces(*(some(cut) if whole.any() else (data, offsets))) if cut.any() else ([], [], np.zeros(0, bool))
            if not clash.any():
                break
            whole[np.flatnonzero(cut)[clash]] = True
        lengths = np.zeros(texts, np.int64)
        lengths[cut] = counts
        if whole.any():
            ids, lengths[whole] = self._whole(*some(whole))
            from_whole, pieces = np.repeat(whole, lengths), flat
            flat = np.empty(len(from_whole), np.uint32)
            flat[from_whole], flat[~from_whole] = ids, pieces
        # The end id behind each text.
        first = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
        out = np.full(first[-1], self.end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[first[1:] - 1] = False
        out[keep] = flat
        return out, first if texts else np.zeros(1, np.int64)


_ENCODERS: dict[Vocabulary, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """The worker's encoder of this vocabulary; a reused worker keeps its table of pieces."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def encoded(column, vocabulary: Vocabulary):
    """(row, its ids as an array) of each text of an Arrow string column."""
    own = encoder(vocabulary)
    for row, rows, data, offsets in chunks(column, AT_ONCE):
        ids, first = own.encode(data, offsets)
        for i in range(rows):
            yield row + i, ids[first[i] : first[i + 1]]
