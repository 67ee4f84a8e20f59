"""Personal data in texts: strict matches, and looser candidates chosen by boosted trees.

Strict matches (`base_spans`) are kept as they are. Generators propose anything that looks at all like an
address, number or name of a machine, overlapping or not; boosted trees judge each proposal by its format and
its surroundings, and a threshold per kind, calibrated on rows apart, selects those to add.

There are no hand-made labels, so the trees learn from the strict matches of all documents, rewritten in
their places in the ways people write them (no country code, dots, "at"), against what the generators find
elsewhere and against numbers of other kinds (dates, versions, amounts, long ids).
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarbook.llm import boosting
from cellarbook.llm.batches import handed_back, small_batches
from cellarbook.llm.words import chunks, text_bytes
from cellarbook.session import scratch_path
from cellarbook.sources.sinks import write_table

PRECISION = 0.995
KINDS = ("email", "ip", "card", "phone")
#: The strict forms. An address is found from its "@" (`_strict_emails`); a number in an ip is taken
#: whole and begins where digits begin, which finds the same and reads no run of digits twice.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
STRICT = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: High-recall forms of the same kinds.
LOOSE = {
    "email": re.compile(
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(]dot[\])]| dot ) ?[A-Za-z0-9-]+)+"
        r"|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]+(?:(?:\.|[\[(]dot[\])]| dot )[A-Za-z0-9-]+)+",
        re.IGNORECASE,
    ),
    "ip": re.compile(r"[0-9]{1,3}(?: ?(?:\.|[\[(]\.[\])]|[\[(]dot[\])]) ?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}"),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9]){12,18}"),
    "phone": re.compile(r"[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}"),
}
CUES = {
    "email": re.compile(r"\b(?:e-?mail|mailto|contact|write|kontakt|correo|courriel)\b", re.IGNORECASE),
    "ip": re.compile(r"\b(?:ip|host|server|address|adresse|dirección)\b", re.IGNORECASE),
    "card": re.compile(r"\b(?:card|visa|master|credit|karte|tarjeta|carte)\b", re.IGNORECASE),
    "phone": re.compile(r"\b(?:tel|phone|call|fax|mobile?|telefon|teléfono|téléphone|handy)\b", re.IGNORECASE),
}
ROUND = 48  # characters on either side that count as surroundings


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(_digits(found)) <= 19 and luhn(_digits(found))
    return kind == "email" or 9 <= len(_digits(found)) <= 15


def _strict_emails(text: str) -> list[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and not overlapping.

    A name holds no "@", so each character is looked at once, however long the runs between are.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (host := HOST.match(text, at + 1)):
            free = host.end()
            out.append((start, free))
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strict matches by kind and start, in code points; a match that fails its test is dropped."""
    rest = [(k, m.start(), m.end()) for k in KINDS[1:] for m in STRICT[k].finditer(text) if _holds(k, m[0])]
    return [("email", a, b) for a, b in _strict_emails(text)] + rest


class Taken:
    """Stretches of a text, joined where they overlap; asks take the logarithm of their number."""

    def __init__(self, spans=()):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        """A stretch that meets no other."""
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposals of all generators; they may overlap each other."""
    return [(k, m.start(), m.end()) for k in KINDS for m in LOOSE[k].finditer(text)]


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and surroundings of a proposal, as numbers."""
    own, before, behind = text[start:end], text[max(0, start - ROUND) : start], text[end : end + ROUND]
    digits = _digits(own)
    groups = [len(g) for g in re.findall("[0-9]+", own)]
    parts = [int(g) for g in re.findall("[0-9]+", own)] or [0]
    cue = CUES[kind].search(before)
    return [
        KINDS.index(kind), len(own), len(digits), len(groups), max(groups, default=0), min(groups, default=0),
        groups[-1] if groups else 0, groups[0] if groups else 0, float(luhn(digits)) if digits else 0.0, min(max(parts), 1e6),
        own.count(" "), own.count("-"), own.count("."), own.count("/"), float(own[:1] == "+"), float("(" in own and ")" in own),
        float("@" in own), float(bool(re.search(r"\W(?:at|dot)\W", own, re.IGNORECASE))), float(own.count(":")),
        len(re.findall("[A-Za-z]+$", own)[0]) if own[-1:].isalpha() and own.isascii() else 0,
        float(before[-1:].isalnum()), float(behind[:1].isalnum()), float(before[-1:] in ("=", ":", "#", "/", "\"", "'", "_", "-")),
        float(behind[:1] in ("%", "/", "-", "_", ".", ":") and behind[1:2].isalnum()),
        float(bool(cue)), len(before) - cue.end() if cue else ROUND + 1,
        sum(c.isdigit() for c in before + behind), float(sum(c.islower() for c in own)), len(set(digits)),
    ]


def _rewritten(kind: str, found: str, rng: random.Random) -> str:
    """The same datum written another way."""
    digits = _digits(found)
    if kind == "email":
        name, _, host = found.partition("@")
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", ".")])
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return rng.choice(["[.]", "(.)", "[dot]"]).join(found.split("."))
    if kind == "card":
        cut = rng.choice([".", "/", "  ", "_"])
        return cut.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    d = digits[-10:].rjust(10, "5")
    return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"0{d[:3]}/{d[3:]}"])


def _decoy(rng: random.Random) -> str:
    """A number of another kind."""
    n = rng.randrange
    return rng.choice(
        [
            f"{1900 + n(150)}-{1 + n(12):02d}-{1 + n(28):02d}", f"{1 + n(28)}.{1 + n(12)}.{1900 + n(150)}", f"{n(30)}.{n(30)}.{n(3000)}.{n(9)}",
            f"v{n(9)}.{n(30)}.{n(400)}.{300 + n(700)}", f"{n(10**9):,}".replace(",", "."), str(10**9 + n(10**15)), f"{n(10**7):07d}",
            f"{n(90)} {n(90)} {n(90)} {n(90)}", f"{n(24):02d}:{n(60):02d}:{n(60):02d}:{n(60):02d}", f"{n(10**12):012x}", f"{n(10**8)}/{n(10**6)}",
            f"{n(999)}-{n(99)}-{n(9999)}-{n(99)}", "meet at noon dot end",
        ]
    )


def _labelled(text: str):
    rng, base = random.Random(zlib.crc32(text.encode("utf-8", "replace"))), base_spans(text)
    strict = Taken((a, b) for _, a, b in base)
    for k, a, b in candidates(text):
        if not strict.meets(a, b):
            yield features(text, k, a, b), 0
    for kind, a, b in base:
        yield features(text, kind, a, b), 1
        new = _rewritten(kind, text[a:b], rng)
        words = {"email": "mail", "ip": "host", "card": "card", "phone": "call"}
        lead = rng.choice(["", f"{words[kind]} ", f"{words[kind]}: "])
        for put, label in ((lead + new, 1), (_decoy(rng), 0), (_decoy(rng), 0)):
            before = text[max(0, a - 3 * ROUND) : a]
            changed, own = before + put + text[b : b + 3 * ROUND], len(before)
            at, skipped = own + (len(lead) if label else 0), max(0, own - 2 * ROUND)
            for k, x, y in candidates(changed[skipped : own + len(put) + 2 * ROUND]):
                x, y = x + skipped, y + skipped
                if label and k == kind and x <= at + 1 and y >= at + len(new) - 1:
                    yield features(changed, k, x, y), 1
                elif not label and x < own + len(put) and own < y:
                    yield features(changed, k, x, y), 0


def training_rows(text: str) -> list[tuple[list[float], int]]:
    """Labelled proposals made from one text."""
    return list(_labelled(text))


@dataclass
class Model:
    trees: boosting.Boosted
    thresholds: dict[str, float]


def fit_rows(x: np.ndarray, y: np.ndarray) -> Model:
    """Trees from two thirds of the rows, a threshold for each kind from the others."""
    apart = np.arange(len(y)) % 3 == 2
    trees = boosting.fit(x[~apart], y[~apart])
    scores, levels = trees.probability(x), {}
    for i, kind in enumerate(KINDS):
        own = apart & (x[:, 0] == i)
        levels[kind] = max(0.5, boosting.threshold(scores[own], y[own], PRECISION)) if y[own].sum() >= 10 else 2.0
    return Model(trees, levels)


def proposals(docs: DataFrame) -> DataFrame:
    """(x, kind, apart, y): labelled proposals of all texts; a third, by a hash of text and place, stands apart."""

    def made(column):
        for row in np.flatnonzero(possible(column)).tolist():
            text = column[row].as_py()
            own = zlib.crc32(text.encode("utf-8", "replace"))
            for n, (x, y) in enumerate(_labelled(text)):
                yield x, int(x[0]), zlib.crc32(b"%d %d" % (own, n)) % 3 == 2, y

    def run(batches):
        kinds = (pa.list_(pa.float64()), pa.int32(), pa.bool_(), pa.int32())
        for batch in _slices(batches, 0):
            rows = made(batch.column(0))
            while block := list(islice(rows, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kinds)], ["x", "kind", "apart", "y"])

    small_batches(docs.sparkSession)
    texts = docs.select("text").where("text IS NOT NULL")
    return texts.mapInArrow(lambda batches: handed_back(run(batches)), "x array<double>, kind int, apart boolean, y int")


def fit(docs: DataFrame) -> Model:
    """Fit on all documents: the driver gets sums by node and bin, and counts by score (`boosting.fit_rows`).

    Where a kind has less than ten held-out matches its threshold is out of reach, and nothing of it is added to
    the strict matches.
    """
    store = lambda df: write_table(df, scratch_path(docs.sparkSession, "proposals"))
    trees, held = boosting.fit_rows(store(proposals(docs)), len(features("0", "card", 0, 1)), store)
    counts, levels = held.orderBy("kind", "step", "y").collect(), {}
    for i, kind in enumerate(KINDS):
        step, y, times = np.array([(r.step, r.y, r.times) for r in counts if r.kind == i], float).reshape(-1, 3).T
        enough = (y * times).sum() >= 10
        levels[kind] = max(0.5, boosting.threshold(boosting.score_of(step), y, PRECISION, times)) if enough else 2.0
    return Model(trees, levels)


def find(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, strict) by kind and start: all strict matches, and the best proposals that touch none."""
    spans = base_spans(text)
    taken = Taken((a, b) for _, a, b in spans)
    free = [c for c in candidates(text) if not taken.meets(c[1], c[2])]
    out = [(*s, True) for s in spans]
    if free:
        scores = model.trees.probability(np.array([features(text, *c) for c in free]))
        for s, c in sorted(zip(scores.tolist(), free, strict=True), key=lambda z: (-z[0], z[1])):
            if s >= model.thresholds[c[0]] and not taken.meets(c[1], c[2]):
                taken.add(c[1], c[2])
                out.append((*c, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def possible(column: pa.Array) -> np.ndarray:
    """Rows with a digit, an @, a bracketed or spelled-out dot, or a dot inside a word; others hold no proposal."""
    data, offsets = text_bytes(column)
    mark = ((data >= 48) & (data <= 57)) | (data == 64)
    if len(data) >= 5:
        low = data | 32
        spelled = (low[1:-3] == 100) & (low[2:-2] == 111) & (low[3:-1] == 116)
        open_, close = data[:-4], data[4:]
        spelled &= ((open_ == 32) | (open_ == 40) | (open_ == 91)) & ((close == 32) | (close == 41) | (close == 93))
        mark[:-4] |= spelled
        letter = (low >= 97) & (low <= 122)
        dot = np.zeros(len(data), bool)
        dot[1:-1] = (data[1:-1] == 46) & letter[:-2] & letter[2:]
        dot[offsets[offsets > 0] - 1] = False  # the end of a text is not inside a word
        mark |= dot
        mark[1:-1] |= ((data[:-2] == 40) | (data[:-2] == 91)) & (low[1:-1] == 97) & (low[2:] == 116)
    before = np.concatenate([[0], np.cumsum(mark)])
    return before[offsets[1:]] > before[offsets[:-1]]


def _spans(column: pa.Array, model: Model):
    """(row, text, spans) of the rows that have spans."""
    for row in np.flatnonzero(possible(column)).tolist():
        text = column[row].as_py()
        if spans := find(text, model):
            yield row, text, spans


def _slices(batches, at: int):
    """Parts of batches with about 2 MB of text each, or one longer text."""
    for batch in batches:
        for row, rows, _, _ in chunks(batch.column(at)):
            yield batch.slice(row, rows)


SPAN = "struct<kind: string, start: int, end: int, strict: boolean>"


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) of every row; null text counts as empty. Spans are in code points, end exclusive."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_())]))

    def run(batches):
        for batch in _slices(batches, 1):
            out: list = [[]] * batch.num_rows
            for row, _, spans in _spans(batch.column(1), shared.value):
                out[row] = [dict(zip(("kind", "start", "end", "strict"), s, strict=True)) for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; spans that touch become one."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """The same rows and columns with redacted texts; a column n_chars, where there is one, is counted again."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in _slices(batches, at):
            column = batch.column(at)
            new = {row: redacted(text, spans) for row, text, spans in _spans(column, shared.value)}
            if new:
                where = np.zeros(len(column), bool)
                where[list(new)] = True
                column = pa.compute.replace_with_mask(column, pa.array(where), pa.array(list(new.values()), column.type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], schema=batch.schema)

    out = docs.mapInArrow(lambda batches: handed_back(run(batches)), docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)).select(docs.columns)
    return out
