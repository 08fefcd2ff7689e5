"""License scan by conditional compression.

A candidate block is a run of lines round words that licenses use. It is compressed alone and with each
template as a zstandard raw dictionary; templates rank by the bytes they save. Winners are confirmed by the
exact differences of wording between the template and the place of the block that it fits. Names, SPDX tags
and other customary short wordings, too short for a compressor, come from a table of license names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .common import whole_text_batches

#: Lines with a cue that are at most so many lines apart belong to one block,
MAX_GAP = 6
#: as do the lines next to it, as many, that are no longer than lines of wrapped text.
WRAPPED_WORDS = 20
#: Bytes a template must save to be looked at.
MIN_GAIN = 6
#: Differing words allowed, as a share of the template's words.
MAX_DIFFERENCE = 0.1
LEVEL = 6
#: Templates with fewer words are short wordings; a named license is compared with them.
SHORT_WORDS = 20

_CUE = re.compile(r"licen[cs]|copyright|\(c\)|©|rights reserved|permission|redistribut|warrant|public domain|spdx|\b[al]?gpl|\bcc[ -]?(?:by|0)\b|creative commons|"
    r"(?:released|distributed|available|published|provided|offered|issued|shared) under", re.I)
_WORD = re.compile(r"\w+(?:[.'-]\w+)*")

# --- fixed values: wordings of common licenses ---
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work and placed it in the public domain.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "all-rights-reserved": "All rights reserved.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright "
        "holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission."
    ),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
}
_LICENSE = "(?:public )?licen[cs]e"


def _version(n: str) -> str:
    return rf"[ -]?(?:version |v |v\.?)?{n.removesuffix('.0')}{r'(?:\.0)?' if n.endswith('.0') else ''}"


def _gnu(kind: str, letter: str, n: str) -> str:
    return rf"(?:gnu )?(?:{kind}general {_LICENSE}|{letter}gpl(?: licen[cs]e)?){_version(n)}(?:[ -](?:only|or[ -](?:any )?later(?: version)?))?"


#: Names of licenses, as lower-case words without punctuation: a name must be whole, with its version.
NAMES = {
    "MIT": "(?:mit|expat)(?: licen[cs]e)?",
    "Apache-2.0": rf"(?:apache(?: software)?|asl)(?: licen[cs]e)?{_version('2.0')}(?: licen[cs]e)?",
    **{f"GPL-{n}": _gnu("", "", n) for n in ("2.0", "3.0")},
    **{f"LGPL-{n}": _gnu("(?:lesser|library) ", "l", n) for n in ("2.0", "2.1", "3.0")},
    "AGPL-3.0": _gnu("affero ", "a", "3.0"),
    "MPL-2.0": rf"(?:mozilla {_LICENSE}|mpl){_version('2.0')}",
    **{f"EPL-{n}": rf"(?:eclipse {_LICENSE}|epl){_version(n)}" for n in ("1.0", "2.0")},
    "BSD-3-Clause": "(?:bsd[ -](?:3|three)[ -]clause|(?:3|three)[ -]clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?",
    "BSD-2-Clause": "(?:bsd[ -](?:2|two)[ -]clause|(?:2|two)[ -]clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?",
    "ISC": "isc(?: licen[cs]e)?",
    "Unlicense": "unlicense",
    "CC0-1.0": rf"(?:creative commons zero|(?:creative commons )?cc0)(?:{_version('1.0')})?(?: universal)?",
    **{
        f"CC-{short.upper()}-{n}": (
            rf"(?:cc[ -]{short.replace('-', '[ -]')}|creative commons {long.replace('-', '[ -]')})[ -](?:version |v)?{re.escape(n)}"
            "(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?"
        )
        for short, long in (
            ("by", "attribution"), ("by-sa", "attribution-share-?alike"), ("by-nc", "attribution-non-?commercial"),
            ("by-nd", "attribution-no-?deriv(?:ative)?s"), ("by-nc-sa", "attribution-non-?commercial-share-?alike"),
            ("by-nc-nd", "attribution-non-?commercial-no-?deriv(?:ative)?s"),
        )
        for n in ("1.0", "2.0", "2.5", "3.0", "4.0")
    },
}
#: Words before a name that put a work under it.
_BEFORE = (
    "spdx-license-identifier|(?:licen[cs]ed|released|distributed|available|published|provided|offered|issued|shared|is|are)"
    "(?: to you)? under|covered by|governed by|subject to|under the (?:terms|conditions)(?: and conditions)? of"
)
_BETWEEN = "(?: (?:the|a|an|terms|conditions|and|of|their|its))*"
#: A name of these needs no word before it: with its version, it stands for nothing else.
_BARE = ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
#: Words that tell licenses of nearly one wording apart: no template fits where one of them differs.
TELLING = frozenset("affero lesser library noncommercial sharealike noderivatives international".split())
# --- end of fixed values ---

_SHORT = [
    (name, re.compile(rf"(?<!\S)(?:(?:{_BEFORE}){_BETWEEN} {said}{rf'|(?=[al]?gpl){said}' if name in _BARE else ''})(?!\S)"))
    for name, said in NAMES.items()
]


def words_of(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def candidate_blocks(text: str) -> Iterator[tuple[int, str, str]]:
    """(first line, text, text from the first cue line to the last) of the runs of lines that hold cues."""
    if not _CUE.search(text):
        return
    lines = text.split("\n")
    cues = [i for i, line in enumerate(lines) if _CUE.search(line)]
    runs: list[list[int]] = []
    for i in cues:
        if runs and i - runs[-1][1] <= MAX_GAP:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    ended = 0
    for k, (first, last) in enumerate(runs):
        core = "\n".join(lines[first : last + 1])
        before = runs[k + 1][0] if k + 1 < len(runs) else len(lines)
        for _ in range(MAX_GAP):
            if first > ended and len(lines[first - 1].split()) <= WRAPPED_WORDS:
                first -= 1
            if last + 1 < before and len(lines[last + 1].split()) <= WRAPPED_WORDS:
                last += 1
        ended = last + 1
        yield first, "\n".join(lines[first:ended]), core


class TemplateSet:
    """Templates with their words and a compressor primed with each of them."""

    def __init__(self, templates: dict[str, str]):
        self.named = templates is TEMPLATES  # a caller's own templates are all that counts
        self.texts = {name: words_of(text) for name, text in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.templates = []
        for name, text in templates.items():
            raw = " ".join(words_of(text)).encode()
            primer = zstandard.ZstdCompressionDict(raw.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, words_of(text), zstandard.ZstdCompressor(level=LEVEL, dict_data=primer)))

    def ranked(self, *readings: list[str]) -> list[tuple[int, str, list[str]]]:
        """(bytes saved, name, words) of the templates that save enough, most first.

        A block is read with and without the lines around its cues, the greater saving counts: what a
        compressor saves on few words depends on the words beside them.
        """
        blocks = [" ".join(words).encode() for words in readings]
        alone = [len(self.plain.compress(b)) for b in blocks]
        gains = [
            (max(n - len(primed.compress(b)) for b, n in zip(blocks, alone)), name, said)
            for name, said, primed in self.templates
        ]
        return sorted((g for g in gains if g[0] >= MIN_GAIN), key=lambda g: (-g[0], g[1]))


def differences(template: list[str], words: list[str]) -> tuple[int, int, list[str]] | None:
    """(first word, end, changes) of the place in ``words`` that fits the template best; None if none fits at all.

    A change is ``-word`` for a word of the template that is missing and ``+word`` for one put in.
    """
    whole = SequenceMatcher(None, template, words, autojunk=False).find_longest_match(0, len(template), 0, len(words))
    if not whole.size:
        return None
    room = len(template) + len(template) // 4 + 1
    low, high = max(0, whole.b - whole.a - room), min(len(words), whole.b + room)
    near = SequenceMatcher(None, template, words[low:high], autojunk=False)
    matches = [m for m in near.get_matching_blocks() if m.size]
    # words far from the rest of the template are chance
    keep = [m for m in matches if abs((m.b + low - m.a) - (whole.b - whole.a)) <= max(2, len(template) // 4)]
    changes, a, b = [], 0, None
    for m in keep:
        changes += [f"-{w}" for w in template[a : m.a]]
        if b is not None:
            changes += [f"+{w}" for w in words[low + b : low + m.b]]
        a, b = m.a + m.size, m.b + m.size
    changes += [f"-{w}" for w in template[a:]]
    return low + keep[0].b, low + b, changes


def _told_apart(changes: list[str]) -> bool:
    """Whether a change touches the name of a license or takes its version; numbers put in may count clauses."""
    return any(c[1:] in TELLING or re.fullmatch(r"-[0-9]+(\.[0-9]+)*", c) for c in changes)


def named_licenses(words: list[str]) -> Iterator[tuple[str, int, int]]:
    """(name, first word, end) of the short wordings among the words; taken words are empty."""
    said = " ".join(words)
    if not said.strip():
        return
    hits = sorted((m.start(), -m.end(), name) for name, pattern in _SHORT for m in pattern.finditer(said))
    upto = -1
    for start, end, name in hits:
        if start > upto:
            upto = -end
            yield name, said.count(" ", 0, start), said.count(" ", 0, upto) + 1


def licenses_of(text: str, templates: TemplateSet) -> list[tuple]:
    """(name, line of the block, word of the block, words, bytes saved, differences, changes) of each license found."""
    found = []
    for line, block, core in candidate_blocks(text):
        left, more, lines = words_of(block), True, words_of(core)
        while more:
            more = False
            for gain, name, said in templates.ranked(left, lines):
                fit = differences(said, left)
                if fit is None or len(fit[2]) > MAX_DIFFERENCE * len(said) or _told_apart(fit[2]):
                    continue
                left[fit[0] : fit[1]] = [""] * (fit[1] - fit[0])  # taken
                lines = left
                found.append((name, line, fit[0], fit[1] - fit[0], gain, len(fit[2]), " ".join(fit[2])))
                more = True
        for name, start, end in named_licenses(left) if templates.named else ():
            short = templates.texts.get(name, [])
            fit = differences(short, left[start:end]) if len(short) < SHORT_WORDS else None
            changes = fit[2] if fit else []
            found.append((name, line, start, end - start, 0, len(changes), " ".join(changes)))
    return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per license found: doc_id, license, line, word, n_words, gain, n_changes, changes.

    Blocks cover the whole text. A license may occur more than once in a document; a word of a block belongs
    to one license, that with the greater gain. Short wordings by name have gain 0 and the changes against the
    short template of their license, if there is one. Null and empty texts have none; equal rows give equal rows;
    an empty table gives an empty result. Of the input only doc_id and text are read.
    """
    wordings = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = TemplateSet(wordings)
        names = ["doc_id", "license", "line", "word", "n_words", "gain", "n_changes", "changes"]
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch["doc_id"], batch["text"]) if t for x in licenses_of(t, held)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    whole_text_batches(docs)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(
        run, f"doc_id {kind}, license string, line long, word long, n_words long, gain long, n_changes long, changes string"
    )
