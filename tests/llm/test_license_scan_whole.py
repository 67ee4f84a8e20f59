"""Notices that are not in the planted data, and those that rank low."""

import pytest

from cellarbook.llm import license_scan as L

PREAMBLE = (
    "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and "
    "other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public "
    "License is intended to guarantee your freedom to share and change all versions of a program. We, the Free Software Foundation, use "
    "the GNU General Public License for most of our software. When we speak of free software, we are referring to freedom, not price. "
    "Our General Public Licenses are designed to make sure that you have the freedom to distribute copies of free software. "
)
CLAUSE = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
    "the documentation and/or other materials provided with the distribution. "
)


@pytest.mark.parametrize("between", ["", CLAUSE])
@pytest.mark.parametrize(
    "name,line", [("CC-BY-4.0", "Licensed under CC BY 4.0."), ("MIT", "Released under the MIT License."), ("CC0-1.0", "Licensed under CC0 1.0 Universal.")]
)
def test_the_right_template_may_rank_low(name, line, between):
    text = PREAMBLE + between + line
    assert L.find(text) == [(name, len(text) - len(line), len(text) - 1)]


def test_a_near_miss_does_not_hide_the_notice_behind_it():
    header = L.TEMPLATES["GPL-3.0"][1]
    miss = header.replace("version 3", "version 9")
    text = f"{miss} {header.replace('redistribute it', 'share it')}"
    assert [n for n, a, _ in L.find(text) if a > len(miss)] == ["GPL-3.0"]


TEXTS = [(name, text) for name, texts in L.TEMPLATES.items() for text in texts]
PLAIN = ("The weather was fine that day. ", " Then we all went home.")


@pytest.mark.parametrize("name,text", TEXTS)
def test_every_template_is_found(name, text):
    assert [n for n, _, _ in L.find(text)] == [name]
    (found,) = L.find(PLAIN[0] + text + PLAIN[1])
    words = [m for m in L._WORD.finditer(text)]
    assert found == (name, len(PLAIN[0]) + words[0].start(), len(PLAIN[0]) + words[-1].end())


def test_mpl_notice_before_its_usual_second_sentence():
    text = (
        "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed "
        "with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n"
    )
    assert L.find(text) == [("MPL-2.0", 3, text.index(". If"))]


GNU = (
    "{} is free software{} you can redistribute it and/or\n# modify it under the terms of the GNU {} License as published\n# by the Free Software "
    "Foundation{} either version {} of the License, or\n# (at your option) any later version.\n#\n# This program is distributed in the hope that it "
    "will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
)
BSD = (
    "Copyright (c) 2001, Jo Doe. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are "
    "permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n"
    "   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this "
    "list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
)
THIRD = (
    "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n"
    "   this software without specific prior written permission.\n\n"
)
AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS 'AS IS' AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."


@pytest.mark.parametrize(
    "text,name",
    [
        (GNU.format("This program", ";", "General Public", ";", "2"), "GPL-2.0"), (GNU.format("Gadget", ":", "General Public", ",", "3"), "GPL-3.0"),
        (GNU.format("This library", ";", "Lesser General Public", ";", "2.1"), "LGPL-2.1"), (GNU.format("This program", ":", "Lesser General Public", ",", "3"), "LGPL-3.0"),
        (GNU.format("This program", ":", "Affero General Public", ",", "3"), "AGPL-3.0"), (GNU.format("It", ";", "Library General Public", ";", "2"), "LGPL-2.0"),
        (BSD + AS_IS, "BSD-2-Clause"), (BSD + THIRD + AS_IS, "BSD-3-Clause"), (THIRD, "BSD-3-Clause"),
        ("Licensed under the MIT License.", "MIT"), ("The code is available under the MIT license", "MIT"), ("Licensed under MIT.", "MIT"),
        ("Distributed under the terms of the Apache License 2.0.", "Apache-2.0"), ("It is under the Apache-2.0 license.", "Apache-2.0"),
        ("Published under the GPLv3.", "GPL-3.0"), ("Distributed under the terms of the GNU GPL v2.0 or later.", "GPL-2.0"),
        ("released under the GNU LGPL, version 2.1", "LGPL-2.1"), ("under version 3 of the GNU General Public License", "GPL-3.0"),
        ("This Source is under the MPL 2.0.", "MPL-2.0"), ("Licensed under the ISC License.", "ISC"), ("Use is under the 3-clause BSD license.", "BSD-3-Clause"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Licensed under Creative Commons Attribution-NonCommercial 4.0.", "CC-BY-NC-4.0"), ("# SPDX-License-Identifier: BSD-2-Clause\nimport os", "BSD-2-Clause"),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("Released under the Unlicense.", "Unlicense"), ("Dedicated under CC0.", "CC0-1.0"),
    ],
)
def test_usual_notices_that_are_not_planted(text, name):
    for whole in (text, PLAIN[0] + text + PLAIN[1]):
        assert [n for n, _, _ in L.find(whole)] == [name]


def test_bsd_texts_one_behind_the_other():
    text = BSD + AS_IS + "\n\n" + BSD + THIRD + AS_IS
    first, second = L.find(text)
    assert (first[0], second[0]) == ("BSD-2-Clause", "BSD-3-Clause")
    assert text[second[1] :].startswith("Redistribution and use") and text[: second[2]].endswith("written permission")
    assert L.find("Licensed under the MIT License.") == [("MIT", 0, 30)]


@pytest.mark.parametrize(
    "text",
    [
        "SPDX-License-Identifier: MIT-0", "Licensed under the Apache License, Version 1.1.", "under the GNU General Public License",
        "Licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Creative Commons Attribution 3.0 Unported License.",
        "He works under the general public licensing board of version 3.", "Licensed under the Mozilla Public License 1.1.",
    ],
)
def test_other_licences_are_not_taken_for_these(text):
    assert L.find(text) == []
