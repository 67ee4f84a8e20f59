import re

import pytest

from cellarbook.llm import license_scan as L
from cellarbook.llm.queries import op8_license_scan

FOLDER = "/root/testdata/sf0.01"
PLANTED = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def test_every_notice_of_the_given_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op8_license_scan(spark, FOLDER).collect()
    assert len(rows) == len(texts) and sum(r.n_notices for r in rows) > 20
    for r in rows:
        want = sorted((m.start(), m.end() - 1, n) for n, line in PLANTED.items() for m in re.finditer(re.escape(line), texts[r.doc_id]))
        got = sorted((int(b), int(c), a) for a, b, c in (s.rsplit(":", 2) for s in r.spans.split(",") if s))
        assert got == want, (r.doc_id, got, want)
        assert r.licenses == ",".join(sorted({n for _, _, n in want}))


@pytest.mark.parametrize(
    "text,names",
    [
        ("x. Licensed under CC BY 4.0. y", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-NC-SA 4.0.", []),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]), ("Licensed under the Apache License, Version 1.1.", []),
        ("released  under\nthe MIT license", ["MIT"]), ("Released under the MIT License. Licensed under CC BY-NC 4.0.", ["MIT", "CC-BY-NC-4.0"]),
        ("A driving license needs permission.", []), ("", []), ("license " * 3000, []), ("word. " * 5000 + "Released under the BSD 3-Clause License.", ["BSD-3-Clause"]),
        (" ".join(L.TEMPLATES["ISC"]), ["ISC"]), ("é — " + L.TEMPLATES["MIT"][1].replace("hereby ", "") + ", and so on.", ["MIT"]),
    ],
)
def test_wording_tells_licences_apart(text, names):
    assert [n for n, _, _ in L.find(text)] == names


def test_the_own_template_saves_most():
    for i, (_, words, _) in enumerate(L._templates()):
        if len(words) > 8:
            assert L.savings(" ".join(words))[0][1] == i


def test_odd_rows(spark):
    rows = [(1, None, "a"), (1, None, "a"), (None, "", "b"), (2, "É! Released under the MIT License.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted(((r.doc_id, [tuple(f) for f in r.found]) for r in L.scan(docs).collect()), key=str)
    assert got == sorted([(1, []), (1, []), (None, []), (2, [("MIT", 3, 33)])], key=str)
    assert L.scan(docs.limit(0)).collect() == []


def test_the_ranking_decides(monkeypatch):
    """The template and a short form both hold; the one that compresses the block better is the notice."""
    line = PLANTED["GPL-3.0"]
    assert [n for _, n, _, _ in L.ranked(line, L.words_of(line)[0])][-1] == -1
    assert L.find(line) == [("GPL-3.0", 0, len(line) - 1)]
    saved = L.saved
    monkeypatch.setattr(L, "saved", lambda block, dictionaries: [-x for x in saved(block, dictionaries)])
    assert L.find(line) == [("GPL-3.0", line.index("licensed"), len(line) - 1)]
