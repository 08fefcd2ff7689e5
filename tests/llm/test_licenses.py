import pytest

from pagemill.llm import licenses

T = licenses.TemplateSet(licenses.TEMPLATES)


def found(text):
    return sorted((x[0], x[5]) for x in licenses.licenses_of(text, T))


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_template_finds_itself(name):
    text = licenses.TEMPLATES[name]
    assert found(f"some prose before it\n{text.upper()}\nand after") == [(name, 0)]
    words = text.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    assert found("x\n\n" + wrapped) == [(name, 0)]


def test_changed_words_are_told():
    said = licenses.TEMPLATES["MIT-text"].replace("merge", "fold").replace("Software is", "Code is")
    (hit,) = licenses.licenses_of(f"a\n{said}", T)
    assert hit[0] == "MIT-text" and hit[6] == "-merge +fold -software +code"
    assert found(licenses.TEMPLATES["MIT-text"][:200]) == []


def test_close_licenses_are_kept_apart():
    assert found("Licensed under CC BY-SA 4.0.") == [("CC-BY-SA-4.0", 0)]
    assert found("This work is licensed under the GNU General Public License, version 2.") == [("GPL-2.0", 0)]
    assert found("Licensed under CC BY-NC-XX 4.0. The licence of this") == []


def test_several_and_none():
    text = "Released under the MIT License.\nAll rights reserved.\n" + "prose\n" * 9 + "Released under the MIT License."
    assert found(text) == [("MIT", 0), ("MIT", 0), ("all-rights-reserved", 0)]
    assert found("Released under the MIT License.\nReleased under the MIT License.") == [("MIT", 0)] * 2
    assert found("A fishing license and a permission slip are all you need.") == []


def test_whole_table_and_odd_rows(documents, odd, nothing):
    rows = licenses.scan_licenses(documents).collect()
    lines = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 80}
    want = sorted((r.doc_id, k) for r in documents.collect() for k, v in lines.items() for _ in range(r.text.count(v)))
    assert sorted((r.doc_id, r.license) for r in rows) == want
    assert licenses.scan_licenses(odd).count() == 0 and licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize(
    "line, name",
    [
        ("Licensed under the MIT License", "MIT"),
        ("This code is distributed under the terms of the MIT license.", "MIT"),
        ("Licensed under the Apache License 2.0", "Apache-2.0"),
        ("# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("GPL v3", "GPL-3.0"),
        ("Released under the GNU GPL version 2 or later.", "GPL-2.0"),
        ("It is licensed under the GNU Lesser General Public License v2.1", "LGPL-2.1"),
        ("Released under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Available under the 2-clause BSD license", "BSD-2-Clause"),
        ("The text is available under CC BY-NC-SA 3.0", "CC-BY-NC-SA-3.0"),
        ("Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
        ("Published under the Mozilla Public License 2.0", "MPL-2.0"),
    ],
)
def test_customary_short_wordings(line, name):
    for text in (line, f"some prose before it\n{line}\nand after"):
        assert [x[0] for x in licenses.licenses_of(text, T)] == [name]


def test_a_name_needs_its_version_and_its_words():
    for text in ("Licensed under the Apache License 1.1", "Licensed under CC BY-NC-XX 4.0", "License mit der Bahn", "released under the MITRE license"):
        assert found(text) == []
    assert [x[:4] for x in licenses.licenses_of("a b\nLicensed under the MIT License or under it", T)] == [("MIT", 0, 2, 5)]


def test_gnu_headers_and_third_clause_are_kept_apart():
    for name in ("GPL-3.0-header", "GPL-2.0-header", "AGPL-3.0-header", "LGPL-2.1-header", "LGPL-3.0-header", "BSD-2-Clause", "BSD-3-Clause"):
        assert found(licenses.TEMPLATES[name]) == [(name, 0)]
    numbered = licenses.TEMPLATES["BSD-3-Clause"].replace("met: R", "met: 1. R").replace("disclaimer. R", "disclaimer. 2. R").replace("Neither", "3. Neither")
    assert [x[0] for x in licenses.licenses_of(numbered, T)] == ["BSD-3-Clause"]
