"""Licence notices in texts, by conditional compression.

Sentences with words of licences, and those between them, are candidate blocks. Each block is compressed alone
and with every template and short form ("under the MIT License") that it may hold as a raw dictionary. They are
tried from the largest saving on, and the first one counts whose exact wording holds: a run of the block's words
that differs from the template in few words and in none of those that tell licences apart (names, versions,
conditions); a short form holds word for word. What lies on either side of a notice is a block again.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Usual notices, headers and opening words of common licences. Short forms are made of NAMES.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, '
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Apache License Version 2.0, January 2004",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, version 3 of the License.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; version 2.1 of the License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-2.0": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written "
        "permission.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.",),
    "CC0-1.0": (
        "Licensed under CC0 1.0 Universal.",
        "have waived all copyright and related or neighboring rights to this work",
        "have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
}


def _gnu(name: str, short: str, number: str) -> tuple[str, ...]:
    full = f"GNU {name}"
    own = [f"{x}{v}{number}" for x in (full, name, f"{full} ({short})", f"GNU {short}", short) for v in (" version ", " v", " v. ", " ")]
    return (*own, f"{short}v{number}", f"version {number} of the {full}")


def _cc(code: str, words: str) -> tuple[str, ...]:
    full = f"Creative Commons {words} 4.0"
    return f"CC {code} 4.0", f"{full} International License", f"{full} International", f"{full} License", f"{full} Unported License", full


#: Names by which short notices call a licence.
NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License", "MIT/Expat License"),
    "Apache-2.0": tuple(f"{x}{v}2.0" for x in ("Apache License", "Apache Software License", "Apache") for v in (" Version ", " v", " v. ", " "))
    + ("Apache 2.0 License", "Apache v2.0 License", "Apache Version 2.0 License", "ALv2"),
    "GPL-3.0": _gnu("General Public License", "GPL", "3"),
    "GPL-2.0": _gnu("General Public License", "GPL", "2"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3"),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "LGPL-2.0": _gnu("Library General Public License", "LGPL", "2"),
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3"),
    "MPL-2.0": tuple(f"{x}{v}2.0" for x in ("Mozilla Public License", "MPL") for v in (" version ", " v", " v. ", " ")) + ("MPLv2.0",),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause", "New BSD License", "Modified BSD License", "three-clause BSD License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause", "Simplified BSD License", "FreeBSD License", "two-clause BSD License"),
    "ISC": ("ISC License", "ISC"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"),
    "Unlicense": ("Unlicense", "Unlicense License"),
}
FORMS = ("under the {}", "under {}", "under the terms of the {}", "under the terms and conditions of the {}", "under a {}", "under an {}")
#: Words before a short form that belong to the notice.
LEADS = frozenset("licensed licenced released distributed published available provided".split())
#: A BSD text is told by its clauses: the opening words, followed by the third one before they come again.
OPENING, THIRD = TEMPLATES["BSD-2-Clause"][1], TEMPLATES["BSD-3-Clause"][1:]
#: Words that tell licences apart.
TELLING = frozenset(
    "mit apache gnu gpl lgpl agpl lesser affero mozilla mpl bsd isc cc cc0 by sa nc nd clause general public unencumbered universal expat "
    "0 1 1.1 2 2.1 3 4 5 two three four new modified simplified freebsd unlicense attribution sharealike noncommercial noderivatives noderivs zero "
    "gplv2 gplv3 lgplv2 lgplv3 agplv3 mplv2 alv2 not no".split()
)
CUES = r"licen[cs]|copyright|permission|redistribut|free software|public domain|creative commons|\bcc0?[ -]|\b(?:[al]?gpl|mpl|alv2)|under\s+(?:the\s+|an?\s+)?(?:terms\s+)?(?:and\s+conditions\s+)?(?:of\s+the\s+)?(?:mit|isc|apache|bsd|gnu|cc0|mozilla)\b"
MOST_DIFFERENT = 0.15  # of a template's words
PIECE, STEP = 4000, 3000  # characters of a piece of a longer block, and from one to the next; templates fit into what they share

_CUE = re.compile(CUES, re.IGNORECASE)
#: No sentence ends before a digit or at a colon: "License, v. 2.0" and "License-Identifier: MIT" go on.
_SENTENCE = re.compile(r".*?(?:[.!?;](?=\s)(?!\s+\d)|\n\s*\n|\Z)", re.DOTALL)
_FURTHER = re.compile(r"-(?:0|nc|nd|sa)\b", re.IGNORECASE)
_WORD = re.compile(r"[0-9]+(?:\.[0-9]+)*|[^\W_]+")


def _word(word: str) -> str:
    """A word as it is compared: "v3.0" and "GPLv3.0" count as "3" and "gplv3"."""
    return re.sub(r"(?<=\d)\.0$", "", re.sub(r"^v(?=\d)", "", word.lower()))


def words_of(text: str, start: int = 0, end: int | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """Words as they are compared, and their spans."""
    found = list(_WORD.finditer(text, start, len(text) if end is None else end))
    return [_word(m[0]) for m in found], [m.span() for m in found]


@lru_cache(maxsize=1)
def _templates():
    """(licence, words, dictionary) of every template."""
    kind = zstandard.DICT_TYPE_RAWCONTENT
    return [
        (name, words_of(text)[0], zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=kind))
        for name, texts in TEMPLATES.items()
        for text in texts
    ]


@lru_cache(maxsize=1)
def _forms():
    """(licence of the words of every short form, lengths of the forms from the longest on)."""
    forms = {tuple(words_of(form.format(x))[0]): name for name, names in NAMES.items() for x in names for form in FORMS}
    forms |= {tuple(words_of(f"SPDX-License-Identifier: {name}")[0]): name for name in TEMPLATES}
    return forms, sorted({len(f) for f in forms}, reverse=True)


@lru_cache(maxsize=4096)
def _dictionary(words: tuple[str, ...]) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def short_forms(block: list[str]):
    """(licence, words of the form, place) of the short forms in the block, which hold word for word."""
    forms, lengths = _forms()
    for at, word in enumerate(block):
        if word in ("under", "spdx"):
            for n in lengths:
                own = tuple(block[at : at + n])
                if len(own) == n and (name := forms.get(own)):
                    yield name, own, (at - (at > 0 and block[at - 1] in LEADS), at + n, 0)
                    break


@lru_cache(maxsize=1)
def _grouped():
    """Templates by the words in them that tell licences apart, each with the counts of its words."""
    out: dict[frozenset[str], list] = {}
    for i, (_, words, _) in enumerate(_templates()):
        out.setdefault(TELLING.intersection(words), []).append((i, Counter(words)))
    return list(out.items())


def blocks_of(text: str) -> list[tuple[int, int]]:
    """Spans of candidate blocks: sentences with a cue, joined over at most one sentence between them."""
    out: list[list[int]] = []
    gap = 2
    for m in _SENTENCE.finditer(text):
        if m.end() == m.start():
            continue
        if _CUE.search(text, m.start(), m.end()):
            if gap <= 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            gap = 0
        else:
            gap += 1
    return [(x, min(x + PIECE, b)) for a, b in out for x in range(a, max(a + 1, b - (PIECE - STEP)), STEP)]


def saved(block: str, dictionaries: list) -> list[float]:
    """Share of its bytes that the compressed block loses with each of the dictionaries."""
    raw = block.lower().encode("utf-8", "replace")
    alone = len(zstandard.ZstdCompressor(level=3).compress(raw))
    return [1 - len(zstandard.ZstdCompressor(level=3, dict_data=d).compress(raw)) / alone for d in dictionaries]


def savings(block: str, among: list[int] | None = None) -> list[tuple[float, int]]:
    """(share of bytes saved, template) for every template, or those of `among`; the largest saving first."""
    among = list(range(len(_templates()))) if among is None else among
    shares = saved(block, [_templates()[i][2] for i in among])
    return sorted(zip(shares, among, strict=True), key=lambda x: (-x[0], x[1]))


def ranked(text: str, block: list[str]) -> list[tuple[str, int, list[str], tuple[int, int, int] | None]]:
    """(licence, template or -1, words, place if known) of what the block may hold, templates and short forms alike, the
    one that compresses it best first. Equal savings go by length, then by the order of the templates."""
    every = [(_templates()[i][0], i, _templates()[i][1], None) for i in likely(block)]
    dictionaries = [_templates()[i][2] for _, i, _, _ in every]
    for name, words, place in short_forms(block):
        every.append((name, -1, list(words), place))
        dictionaries.append(_dictionary(words))
    order = sorted(zip(saved(text, dictionaries), every, strict=True), key=lambda x: (-x[0], -len(x[1][2])))
    return [candidate for _, candidate in order]


def wording(block: list[str], template: list[str]) -> tuple[int, int, int] | None:
    """(first word, end, words that differ) where the block holds the template, or None.

    The longest run of equal words is where the template may lie; if its wording does not hold there, what lies on
    either side is searched in turn. With `most` words that differ, one of `most` + 1 runs is `least` words long.
    """
    most = int(MOST_DIFFERENT * len(template))
    least = -(-(len(template) - most) // (most + 1))
    match = SequenceMatcher(None, block, template, autojunk=False)
    todo = [(0, len(block))]
    while todo:
        low, high = todo.pop()
        run = match.find_longest_match(low, high, 0, len(template))
        if run.size < least:
            continue
        start = max(low, run.a - run.b - most)
        if place := _placed(block[start : min(high, run.a + len(template) - run.b + most)], template):
            return start + place[0], start + place[1], place[2]
        todo += [(run.a + run.size, high), (low, run.a)]
    return None


def _placed(block: list[str], template: list[str]) -> tuple[int, int, int] | None:
    """The same in words around one run."""
    same = [m for m in SequenceMatcher(None, block, template, autojunk=False).get_matching_blocks() if m.size]
    if not same or sum(m.size for m in same) < (1 - MOST_DIFFERENT) * len(template):
        return None
    first, end = same[0].a, same[-1].a + same[-1].size
    inside = block[first:end]
    changed, count = [], 0
    for kind, a, b, x, y in SequenceMatcher(None, inside, template, autojunk=False).get_opcodes():
        if kind != "equal":
            changed += inside[a:b] + template[x:y]
            count += max(b - a, y - x)
    # A condition may also follow at once: "CC BY" is another licence than "CC BY-NC".
    if count > MOST_DIFFERENT * len(template) or TELLING.intersection(changed):
        return None
    return first, end, count


def likely(block: list[str]) -> list[int]:
    """Templates that the block may hold: enough of their words are in it, and all that tell licences apart."""
    have = Counter(block)
    return [
        i
        for telling, own in _grouped()
        if telling <= have.keys()
        for i, counts in own
        if sum(min(n, have[w]) for w, n in counts.items()) >= (1 - MOST_DIFFERENT) * counts.total()
    ]


def find(text: str) -> list[tuple[str, int, int]]:
    """(licence, start, end) of every notice, in order; spans are code points."""
    out = {}
    for a, b in blocks_of(text):
        todo = [(a, b)]
        while todo:  # what lies on either side of a notice is a block again
            a, b = todo.pop()
            small, spans = words_of(text, a, b)
            if len(small) < 3 or not _CUE.search(text, a, b):
                continue
            # The first whose wording holds is the notice; one that does not hold leaves the block to the next.
            for name, i, words, place in ranked(text[a:b], small):
                if place := place or wording(small, words):
                    start, stop = spans[place[0]][0], spans[place[1] - 1][1]
                    # "MIT-0" is another licence than "MIT".
                    if not _FURTHER.match(text, stop):
                        out[name, start, stop] = i
                    todo += [(a, start), (stop, b)]
                    break
    return _clauses(sorted(out.items(), key=lambda x: (x[0][1], x[0][2])))


def _clauses(found: list[tuple[tuple[str, int, int], int]]) -> list[tuple[str, int, int]]:
    """One notice of the opening words of a BSD text and the third clause behind them."""
    templates = _templates()
    opening, third = words_of(OPENING)[0], [words_of(x)[0] for x in THIRD]
    out: list[tuple[str, int, int]] = []
    opened = None
    for k, (notice, i) in enumerate(found):
        # The pieces of a long block share words; a notice that one of them cuts is a part of the other's.
        if any(x != notice and x[1] <= notice[1] and notice[2] <= x[2] for x, _ in found[max(0, k - 2) : k + 3]):
            continue
        if i >= 0 and templates[i][1] == opening:
            opened = len(out)
        elif i >= 0 and templates[i][1] in third and opened is not None:
            out[opened] = ("BSD-3-Clause", out[opened][1], notice[2])
            opened = None
            continue
        out.append(notice)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, found) of every row: licence, start and end of each notice in the whole text.

    Null and empty texts have none; rows that repeat are done again; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            likely = pc.fill_null(pc.match_substring_regex(column, CUES, ignore_case=True), False).to_pylist()
            out: list = [[]] * batch.num_rows
            for row in (i for i, x in enumerate(likely) if x):
                out[row] = [dict(zip(("license", "start", "end"), f, strict=True)) for f in find(column[row].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, found array<struct<license: string, start: int, end: int>>")
