"""Licence notices: held-out variants, odd rows, agreement with a plain scan."""

import re
import textwrap

import pytest

from wordweave.llm import licences, queries

NOTICES = {
    "Licensed under the Apache License, Version 2.0": "apache",
    "this file is licensed under the apache license version 2.0": "apache",
    "Distributed under the MIT License.": "mit",
    "SPDX-License-Identifier: MPL-2.0": "mpl",
    "This document is licensed under the GNU General Public License, version 2.": "gpl",
    "Licensed under the GNU Lesser General Public License, version 2.1.": "lgpl",
    "Licensed under CC BY-SA 3.0.": "cc-by-sa",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under CC BY 3.0.": "cc-by",
}
OTHERS = [
    "The license plate of the car was lost.", "Public opinion is free.", "He asked for permission to copy.",
    "A general rule with version and terms", "mit mit mit mit mit", "Software engineers work in Berlin.",
    "", "...", "Warranty, copyright, notice", "All rights reserved",
]


@pytest.fixture(scope="module")
def model():
    return licences.Classifier(["Some plain line of text.", "Und noch eine Zeile mit Text."])


def test_every_template_is_its_family(model):
    for family, texts in licences.TEMPLATES.items():
        for text in texts:
            found = model.judge(licences.words_of(text))
            assert found and found[0] == family and found[2] == 1.0


@pytest.mark.parametrize("text", NOTICES)
def test_notices(model, text):
    found = model.judge(licences.words_of(text))
    assert found and found[0] == NOTICES[text] and found[2] >= licences.CONFIRMED


@pytest.mark.parametrize("text", OTHERS)
def test_other_paragraphs(model, text):
    found = model.judge(licences.words_of(text))
    assert found is None or found[2] < licences.CONFIRMED


def test_sparse_row_by_hand(model):
    words = licences.words_of("released under the mit license")
    row = model.row(words)
    grams = {" ".join(words[i:j]) for i in range(5) for j in range(i + 1, min(i + 3, 5) + 1)}
    expected = {model.index[g] for g in grams if g in model.index}
    assert {i for i in range(len(model.index)) if row[i]} == expected
    assert sum(row[i] ** 2 for i in expected) == pytest.approx(1)


def test_whole_table(small):
    """The notices of the test tables are whole lines; a plain search finds
    the same ones."""
    plain = re.compile(r"^(Licensed under|Released under|This work is licensed under) .*(Licen[cs]e|CC BY).*$")
    theirs = set()
    for r in small["documents"].select("doc_id", "text").collect():
        theirs |= {(r.doc_id, n) for n, line in enumerate(r.text.split("\n")) if plain.match(line)}
    rows = licences.licences(small["documents"]).where("confirmed").collect()
    assert {(r.doc_id, r.paragraph) for r in rows} == theirs
    assert len(theirs) > 10


def test_odd_rows(odd, no_rows, spark):
    assert licences.licences(odd).where("confirmed").count() == 0
    assert licences.licences(no_rows).count() == 0
    long = "filler words " * 5000 + "Licensed under the Apache License, Version 2.0. " + "filler words " * 5000
    rows = [(1, "x\r\nReleased under the MIT License.\ry"), (1, "x\r\nReleased under the MIT License.\ry"), (None, long)]
    found = licences.licences(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed")
    assert sorted((r.doc_id or 0, r.paragraph, r.family) for r in found.collect()) == [
        (0, 0, "apache"), (1, 1, "mit"), (1, 1, "mit")
    ]


def test_reserved_lines_of_the_whole_table(spark, small):
    """The query also finds every line that only reserves all rights."""
    theirs = set()
    for r in small["documents"].select("doc_id", "text").collect():
        theirs |= {(r.doc_id, n) for n, line in enumerate(r.text.split("\n")) if line == "All rights reserved."}
    rows = queries.op5_licences(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.paragraph) for r in rows if r.family == "proprietary"} == theirs
    assert len(theirs) > 3


@pytest.mark.parametrize("text", [t for t in OTHERS if "reserved" not in t])
def test_other_paragraphs_beside_reservations(text):
    model = licences.Classifier(["Some plain line of text.", "Und noch eine Zeile mit Text."], reserved=True)
    found = model.judge(licences.words_of(text))
    assert found is None or found[2] < licences.CONFIRMED
    found = model.judge(licences.words_of("All rights reserved."))
    assert found and found[0] == "proprietary" and found[2] == 1.0


@pytest.mark.parametrize("mark", ["", "# ", " * ", "REM "])
@pytest.mark.parametrize("width", [80, 60, 40])
def test_wrapped_notices(width, mark):
    """Every template, wrapped, is one notice at its first line, however often."""
    model = licences.Classifier(["Some plain line of text.", "Und noch eine Zeile mit Text."], reserved=True)
    for family, texts in model.texts.items():
        for text in texts:
            lines = [mark + x for x in textwrap.wrap(text, width, break_on_hyphens=False)]
            for begin in ([], ["A heading", mark]):
                for times in (1, 2):
                    found = [f for f in model.scan("\n".join([*begin, *lines * times])) if f[3] >= licences.CONFIRMED]
                    starts = [len(begin) + i * len(lines) for i in range(times)]
                    assert [(f[0], f[1]) for f in found] == [(n, family) for n in starts], (text, found)


def test_lines_of_no_notice(model):
    text = "Permission is hereby\n\ngranted, free of charge, to any person\n\nobtaining a copy of this software"
    assert not [f for f in model.scan(text) if f[3] >= licences.CONFIRMED]
    assert not [f for f in model.scan("\n".join(OTHERS)) if f[3] >= licences.CONFIRMED]


SEVERAL = {
    "Licensed under the MIT License or the Apache License, Version 2.0.": {"mit", "apache"},
    "Licensed under the Apache License, Version 2.0, or released under the MIT License, at your option.": {"mit", "apache"},
    "Licensed under the GNU General Public License, version 3, or the GNU Lesser General Public License, version 3.": {"gpl", "lgpl"},
    licences.TEMPLATES["mit"][0] + " word" * 3000 + " " + licences.TEMPLATES["apache"][0]: {"mit", "apache"},
    " ".join(t[0] for t in licences.TEMPLATES.values()): set(licences.TEMPLATES),
    licences.TEMPLATES["agpl"][0]: {"agpl"},
    "Licensed under CC BY-SA 4.0.": {"cc-by-sa"},
}


@pytest.mark.parametrize("text", SEVERAL)
def test_several_families_in_one_line(model, text):
    found = [f for f in model.scan(text) if f[3] >= licences.CONFIRMED]
    assert sorted((f[0], f[1]) for f in found) == sorted((0, f) for f in SEVERAL[text])


@pytest.mark.parametrize(
    ("line", "family"),
    [
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc-sa"),
        ("Licensed under CC BY-NC-ND 4.0.", "cc-by-nc-nd"),
        ("Licensed under CC BY-ND 4.0.", "cc-by-nd"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "gpl"),
        ("// SPDX-License-Identifier: EPL-2.0", "epl"),
        ("// SPDX-License-Identifier: Zlib", "zlib"),
        ("Licensed under the Eclipse Public License, Version 2.0.", "epl"),
        ("Distributed under the Boost Software License, Version 1.0.", "bsl"),
        (
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "mit",
        ),
        (
            "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
            "be held liable for any damages arising from the use of this software.",
            "zlib",
        ),
    ],
)
def test_more_families(model, line, family):
    found = model.scan(f"some words before\n\n{line}\n\nand after")
    assert [(f[1], f[3] >= licences.CONFIRMED) for f in found if f[3] >= licences.CONFIRMED] == [(family, True)]


def test_background_is_the_same_from_any_layout(small, spark):
    docs = small["documents"].select("doc_id", "text")
    once = licences.background(docs, "doc_id", "text")
    assert once == licences.background(docs.repartition(9), "doc_id", "text")
    repeated = docs.unionByName(docs.where("doc_id < 30")).unionByName(docs.where("doc_id < 30"))
    assert once == licences.background(repeated, "doc_id", "text")
    firsts = {t for r in docs.collect() for t in r.text.split("\n")[:4]}
    assert any(line not in firsts for line in once)
