"""License scans by sentence rules: sentences become identifiers, identifier sequences become licences.

1. A text becomes its words (letters and digits, lower case) and the places where a sentence or a line
   starts. A known sentence is found where its words stand from one such place to the next, over any number
   of line ends and list or comment marks; of those that start at one place the longest counts. ``<name>``
   in a known sentence stands for up to NAME words.
2. Each known sentence has an identifier; copyright lines and SPDX tags have identifiers of their own.
3. Ordered rules match runs of identifiers, the first rule that fits wins and uses its sentences up. Inside
   a run at most ``GAP`` pieces of other text and any copyright lines may stand; whole licence bodies, of
   which some sentences are known, may have any text between them. A tag names its licence itself.

Texts that hold none of the words that every known sentence has are passed over at once. The work is a
map over whole texts: no shuffle, no state, any size of table.

Cases: null and empty texts have no licence; texts of any length are read whole; null ids and repeated rows
each get their row; other columns are not read, so they may have any names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.types import _parse_datatype_string as kind

#: Pieces of other text inside a run, and words that a name may have, at most.
GAP, NAME = 3, 64

# Known licence sentences, as they are written, and their identifiers.
SENTENCES = [
    ("MIT-ref", "Released under the MIT License."),
    ("MIT-ref", "Licensed under the MIT License."),
    ("MIT-ref", "This project is licensed under the MIT License."),
    ("MIT-ref", "The MIT License (MIT)"),
    ("MIT-ref", "MIT License"),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("AS-IS", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MIT-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-endorse", "Neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-ref", "Licensed under the Apache License, Version 2.0."),
    ("Apache-ref", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-ref", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL3-ref", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL3-ref", "Licensed under the GNU General Public License, version 3."),
    ("GPL2-ref", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL2-ref", "Licensed under the GNU General Public License, version 2."),
    ("GPL3+-grant", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL2+-grant", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL3-ref", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL3-ref", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL2-ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL2-ref", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-NC-ref", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-ref", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ref", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-ref", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-ref", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("Apache-copyright", "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."),
    ("Apache-redistribution", "You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions: (a) You must give any other recipients of the Work or Derivative Works a copy of this License; and"),
    ("Apache-warranty", "You are solely responsible for determining the appropriateness of using or redistributing the Work and assume any risks associated with Your exercise of permissions under this License."),
    ("GPL3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL3-preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL3-verbatim", "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice; keep intact all notices stating that this License and any non-permissive terms added in accord with section 7 apply to the code; keep intact all notices of the absence of any warranty; and give all recipients a copy of this License along with the Program."),
    ("GPL2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL2-applies", "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License."),
    ("GPL2-verbatim", "You may copy and distribute verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty; keep intact all the notices that refer to this License and to the absence of any warranty; and give any other recipients of the Program a copy of this License along with the Program."),
    ("LGPL3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL3-incorporates", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL3-exception", "You may convey a covered work under sections 3 and 4 of this License without being bound by section 3 of the GNU GPL."),
    ("LGPL2.1-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL2.1-applies", "This license, the Lesser General Public License, applies to some specially designated software packages--typically libraries--of the Free Software Foundation and other authors who decide to use it."),
    ("LGPL2.1-lesser", "The Lesser General Public License permits more lax criteria for linking other code with the library."),
    ("MPL2-title", "Mozilla Public License Version 2.0"),
    ("MPL2-scope", "The licenses granted in this Section 2 are the only rights granted under this License."),
    ("MPL2-marks", "This License does not grant any rights in the trademarks, service marks, or logos of any Contributor (except as may be necessary to comply with the notice requirements in Section 3.4)."),
    ("CC0-title", "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN \"AS-IS\" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER."),
    ("Unlicense-grant", "This is free and unencumbered software released into the public domain."),
]

# Rules in the order in which they are tried; the first ones are bodies, with any text between their sentences.
BODIES = [
    ("Apache-2.0", ("Apache-copyright", "Apache-redistribution", "Apache-warranty")),
    ("GPL-3.0", ("GPL3-title", "GPL3-preamble", "GPL3-verbatim")),
    ("GPL-2.0", ("GPL2-title", "GPL2-applies", "GPL2-verbatim")),
    ("LGPL-3.0", ("LGPL3-title", "LGPL3-incorporates", "LGPL3-exception")),
    ("LGPL-2.1", ("LGPL2.1-title", "LGPL2.1-applies", "LGPL2.1-lesser")),
    ("MPL-2.0", ("MPL2-title", "MPL2-scope", "MPL2-marks")),
    ("CC0-1.0", ("CC0-title",)),
]
RULES = [
    ("BSD-3-Clause", ("BSD-grant", "BSD-source", "BSD-binary", "BSD-endorse")),
    ("BSD-2-Clause", ("BSD-grant", "BSD-source", "BSD-binary")),
    ("MIT", ("MIT-grant", "MIT-notice", "AS-IS", "MIT-liability")),
    ("MIT", ("MIT-grant", "MIT-notice")),
    ("ISC", ("ISC-grant",)),
    ("Apache-2.0", ("Apache-ref", "Apache-copy")),
    ("Apache-2.0", ("Apache-ref",)),
    ("GPL-3.0-or-later", ("GPL3+-grant",)),
    ("GPL-2.0-or-later", ("GPL2+-grant",)),
    ("GPL-3.0", ("GPL3-ref",)),
    ("GPL-2.0", ("GPL2-ref",)),
    ("LGPL-3.0", ("LGPL3-ref",)),
    ("AGPL-3.0", ("AGPL3-ref",)),
    ("MPL-2.0", ("MPL2-ref",)),
    ("CC-BY-NC-4.0", ("CC-BY-NC-ref",)),
    ("CC-BY-SA-4.0", ("CC-BY-SA-ref",)),
    ("CC-BY-4.0", ("CC-BY-ref",)),
    ("Unlicense", ("Unlicense-grant",)),
    ("MIT", ("MIT-ref",)),
]

# Each known sentence holds one of these.
TRIGGERS = (b"licens", b"permi", b"redistribut", b"copyright", b"warrant", b"unencumbered")

_WORDS = re.compile(r"[a-z0-9]+")
_STARTS = re.compile(r"\n|[.!?:;)][\"'\u201d]*\s")
_COPYRIGHT = re.compile(r"copyright (c )?(19|20)\d\d\b|copyright c ")
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([a-z0-9.+-]+(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+)*)", re.IGNORECASE)
_ANY, _END = "<name>", ""


def normalise(sentence: str) -> str:
    return " ".join(_WORDS.findall(sentence.lower()))


@cache
def _known() -> dict:
    """Known sentences as a tree of words; a leaf _END holds the identifier."""
    tree: dict = {}
    for name, sentence in SENTENCES:
        at = tree
        for k, part in enumerate(sentence.split(_ANY)):
            for word in [_ANY] * (k > 0) + normalise(part).split():
                at = at.setdefault(word, {})
        at[_END] = name
    return tree


def _longest(words: list[str], i: int, first: list[bool], at: dict) -> tuple[int, str] | None:
    """End and identifier of the longest known sentence from word i on that ends where a piece does."""
    best = None
    while True:
        if _END in at and first[i]:
            best = i, at[_END]
        if _ANY in at:
            for k in range(i + 1, min(i + NAME, len(words) - 1) + 1):
                if words[k] in at[_ANY] and (found := _longest(words, k, first, at[_ANY])):
                    return found
        if i >= len(words) or words[i] not in at:
            return best
        i, at = i + 1, at[words[i]]


def identifiers(text: str) -> list[tuple[int, int, str]]:
    """(first piece, end, identifier) of known sentences, tags and copyright lines."""
    low = text.lower()
    found = list(_WORDS.finditer(low))
    words = [m.group() for m in found]
    at = [m.start() for m in found]
    first = [False] * len(words) + [True]
    for m in _STARTS.finditer(low):
        first[bisect_left(at, m.end())] = True
    if words:
        first[0] = True
    piece = [n - 1 for n in accumulate(first)]  # number of each word's piece; the last is that of the text's end
    tags = {bisect_left(at, m.start()): (bisect_left(at, m.end()), "SPDX:" + text[m.start(1) : m.end(1)]) for m in _TAG.finditer(text)} if len(low) == len(text) else {}
    known, out, i = _known(), [], 0
    while i < len(words):
        best = tags.get(i) or (_longest(words, i, first, known) if first[i] and words[i] in known else None)
        if best:
            end = piece[best[0] - 1] + 1
            out.append((piece[i], end, best[1]))
            i = max(best[0], i + 1)
            continue
        if first[i] and words[i] == "copyright":
            upto = next(k for k in range(i + 1, len(first)) if first[k])
            if _COPYRIGHT.match(" ".join(words[i:upto])) or words[i : i + 2] == ["copyright", "c"]:
                out.append((piece[i], piece[i] + 1, "Copyright"))
        i += 1
    return out


def licenses(found: list[tuple[int, int, str]]) -> list[str]:
    """Names of the licences whose rules match, in the order of the text."""
    own = [x for x in found if x[2] != "Copyright"]
    out, i = [], 0
    while i < len(own):
        used = 1
        if own[i][2].startswith("SPDX:"):
            out.append(own[i][2].removeprefix("SPDX:"))
        else:
            for k, (name, rule) in enumerate([*BODIES, *RULES]):
                part = own[i : i + len(rule)]
                near = k < len(BODIES) or all(b[0] - a[1] <= GAP for a, b in zip(part, part[1:], strict=False))
                if near and tuple(x[2] for x in part) == rule:
                    out.append(name)
                    used = len(rule)
                    break
        i += used
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, identifiers array<string>, licenses array<string>) for each row, both in the order of the text."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    out = StructType([rows.schema[id_col]]).add("identifiers", kind("array<string>")).add("licenses", kind("array<string>"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = [], []
            for text in batch.column("_text").to_pylist():
                low = (text or "").lower().encode("utf-8", "surrogatepass")
                found = identifiers(text) if any(t in low for t in TRIGGERS) else []
                ids.append([x[2] for x in found])
                names.append(licenses(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.string())), pa.array(names, pa.list_(pa.string()))], [id_col, "identifiers", "licenses"])

    return rows.mapInArrow(run, out)
