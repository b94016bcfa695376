"""License scans by conditional compression.

What is around license cues, as far as the longest notice reaches, are candidate blocks. A
block is compressed once alone and once with the notices of each license that it has a run
of words of as a raw zstandard dictionary; the licenses are ranked by how much smaller it
gets. Going down that rank, a license is confirmed only by comparing wordings: a notice has
to be in the block word for word, or with few differences of which none is a name, number or
other word that tells licenses apart. Marks of comments and line breaks are no words.

Licenses that share paragraphs are told apart by texts that go on past them; where only the
shared paragraph is there, the name is the family's (BSD) or the commonest (MIT).

Texts are scanned whole, in the tasks that read them; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm._text import string_column

# License names, header forms and texts, as their stewards publish them.
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("MIT License",),
    "MIT-0": ("MIT No Attribution License",),
    "X11": ("X11 License",),
    "JSON": ("JSON License",),
    "Apache-1.1": ("Apache Software License, Version 1.1",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "Revised BSD License"),
    "0BSD": ("BSD Zero Clause License",),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("WTFPL",),
    "MPL-1.1": ("Mozilla Public License, version 1.1", "Mozilla Public License 1.1"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-1.0": ("Eclipse Public License, version 1.0", "Eclipse Public License 1.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0"),
    "CDDL-1.0": ("Common Development and Distribution License 1.0",),
    "EUPL-1.2": ("European Union Public License 1.2", "EUPL 1.2"),
    "Artistic-1.0": ("Artistic License 1.0",),
    "Artistic-2.0": ("Artistic License 2.0",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"),
    "MS-PL": ("Microsoft Public License",),
    "PostgreSQL": ("PostgreSQL License",),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "AFL-3.0": ("Academic Free License version 3.0",),
    "PSF-2.0": ("Python Software Foundation License Version 2",),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
}
FORMS = (
    "Licensed under the {}.",
    "Licensed under {}.",
    "Released under the {}.",
    "Released under {}.",
    "This project is licensed under the terms of the {}.",
    "This work is licensed under the {}.",
    "This work is licensed under a {}.",
    "Distributed under the {}.",
)
IDENTIFIER_FORMS = ("SPDX-License-Identifier: {}", "License: {}")
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so"
)
_CONDITIONS = ", subject to the following conditions:"
_NOTICE = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:"
)
_BSD_CLAUSES = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
_BSD_AS_IS = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
TEXTS: dict[str, tuple[str, ...]] = {
    "MIT": (_GRANT + _CONDITIONS + _NOTICE + _AS_IS, _GRANT + _CONDITIONS),
    "MIT-0": (_GRANT + "." + _AS_IS,),
    "JSON": (_GRANT + _CONDITIONS + _NOTICE + " The Software shall be used for Good, not Evil." + _AS_IS,),
    "X11": (
        _GRANT + _CONDITIONS + _NOTICE + _AS_IS.replace("SHALL THE", "SHALL THE X CONSORTIUM BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
        "Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote "
        "the sale, use or other dealings in this Software without prior written authorization from the X Consortium.",
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-2-Clause": (_BSD + _BSD_CLAUSES + _BSD_AS_IS,),
    "BSD-3-Clause": (_BSD + _BSD_CLAUSES + _BSD_NAMES + _BSD_AS_IS, _BSD_NAMES[4:]),
    # its first paragraph alone doesn't say which
    "BSD": (_BSD, _BSD + _BSD_CLAUSES),
    "ISC": (_ISC + ", provided that the above copyright notice and this permission notice appear in all copies.",),
    "0BSD": (_ISC + '. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',),
    "Zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:",
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        'documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the '
        "Software, and to prepare derivative works of the Software",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ),
    "OFL-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    "PostgreSQL": (
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without "
        "a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two "
        "paragraphs appear in all copies.",
    ),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.",),
}
#: (identifier, name, version) of licenses whose later versions may be allowed.
_LATER = (
    ("GPL-2.0", "GNU General Public License", "2"),
    ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"),
    ("AGPL-3.0", "GNU Affero General Public License", "3"),
)


def _notices() -> dict[str, tuple[str, ...]]:
    """All notices by identifier, texts last."""
    out: dict[str, list[str]] = {}
    for name, titles in NAMES.items():
        out[name] = [f.format(t) for t in titles for f in FORMS] + [f.format(name) for f in IDENTIFIER_FORMS]
    for name, title, version in _LATER:
        start = "This {} is free software: you can redistribute it and/or modify it under the terms of the {}"
        later = start + " as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
        only = start + " version {} as published by the Free Software Foundation."
        for suffix, text in (("-or-later", later), ("-only", only)):
            forms = [f.format(name + suffix) for f in IDENTIFIER_FORMS]
            out[name + suffix] = forms + [text.format(what, title, version) for what in ("program", "library")]
    for name, texts in TEXTS.items():
        out.setdefault(name, []).extend(texts)
    return {name: tuple(notices) for name, notices in out.items()}


NOTICES = _notices()
CUES = (b"licen", b"spdx", b"redistribut", b"copyright", b"permission", b"public domain", b"cc by", b"cc-by", b"cc0", b"gpl", b"eupl", b"wtfpl", b"this notice")
#: Words that no difference may touch, beside those with a digit.
TELLING = frozenset(
    "mit apache gnu gpl lgpl agpl lesser affero library bsd clause mozilla mpl isc cc cc0 by by-nc by-sa by-nd by-nc-sa by-nc-nd "
    "attribution attribution-noncommercial attribution-sharealike attribution-noderivatives noncommercial sharealike not no without "
    "public domain only later consortium evil".split()
)
#: Bytes around a cue that a block takes in; bytes of a block, longer ones are cut with an overlap.
AROUND = 2 * max(len(x) for notices in NOTICES.values() for x in notices)
BLOCK_BYTES, OVERLAP = 16_384, 8_192
#: Least share of a notice's words that are there; words of a notice that allows no difference.
LEAST_ALIKE, EXACT_BELOW = 0.85, 8
#: Words in a row by which notices are looked up; a shorter notice by all its words.
GRAM = 4
_LEVEL = 6

_CUE = re.compile(b"|".join(re.escape(x) for x in CUES), re.IGNORECASE)
_WORD = re.compile(r"(?!-+(?:\s|$))[^\s]+")
_EDGES = "\"'()[]{}<>.,;:*#$%&!?|_`~/\\=+"

FOUND_SCHEMA = "doc_id long, license string, start long, end long, reduction double, differences string"


def candidate_blocks(text: bytes) -> Iterator[tuple[int, int]]:
    """Byte ranges of what is around cues, far enough for any notice that has one."""
    start = end = None
    for cue in _CUE.finditer(text):
        a, b = max(0, cue.start() - AROUND), min(len(text), cue.end() + AROUND)
        if end is not None and a > end:
            yield start, end
            start = None
        start, end = a if start is None else start, b
    if end is not None:
        yield start, end


def _windows(start: int, end: int) -> Iterator[tuple[int, int]]:
    while end - start > BLOCK_BYTES:
        yield start, start + BLOCK_BYTES
        start += BLOCK_BYTES - OVERLAP
    yield start, end


@cache
def _compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    plain = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    params = zstandard.ZstdCompressionParameters.from_level(_LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, **plain)
    by = {}
    for name, notices in NOTICES.items():
        data = zstandard.ZstdCompressionDict("\n".join(notices).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        by[name] = zstandard.ZstdCompressor(compression_params=params, dict_data=data)
    return zstandard.ZstdCompressor(compression_params=params), by


def ranked(block: bytes, names: set[str]) -> list[tuple[float, str]]:
    """The licenses by falling size reduction of the block."""
    if not names:
        return []
    alone, by = _compressors()
    size = len(alone.compress(block))
    return sorted(((1 - len(by[x].compress(block)) / size, x) for x in names), key=lambda x: (-x[0], x[1]))


def _words(text: str) -> list[str]:
    return [bare for w in _WORD.findall(text) if (bare := w.strip(_EDGES).lower())]


@cache
def _notice_words(name: str) -> tuple[tuple[str, ...], ...]:
    return tuple(sorted((tuple(_words(x)) for x in NOTICES[name]), key=len, reverse=True))


@cache
def _lookup() -> dict[tuple[str, ...], frozenset[str]]:
    """Licenses by the runs of GRAM words in their notices, and by whole shorter notices."""
    out: dict[tuple[str, ...], set[str]] = {}
    for name in NOTICES:
        for words in _notice_words(name):
            size = min(GRAM, len(words))
            for at in range(len(words) - size + 1):
                out.setdefault(words[at : at + size], set()).add(name)
    return {k: frozenset(v) for k, v in out.items()}


def possible(words: list[str]) -> set[str]:
    """Licenses with a notice of which some run of words is there; no other has its wording there."""
    known = _lookup()
    runs = {tuple(words[at : at + size]) for size in range(1, GRAM + 1) for at in range(len(words) - size + 1)}
    return set().union(*(known[x] for x in runs & known.keys()))


def differences(notice: tuple[str, ...], words: list[str]) -> tuple[int, int, list[str]] | None:
    """(first word, one past the last, differing words with - or +) of the place where ``words`` are most
    like the notice; None if the wording isn't the notice's."""
    matcher = SequenceMatcher(None, notice, words, autojunk=False)
    a, b, n = matcher.find_longest_match()
    if n == 0 or n < min(4, len(notice)):
        return None
    slack = 3 + len(notice) // 10
    lo, hi = max(0, b - a - slack), min(len(words), b - a + len(notice) + slack)
    same = [x for x in SequenceMatcher(None, notice, words[lo:hi], autojunk=False).get_matching_blocks() if x.size]
    first, last = lo + same[0].b, lo + same[-1].b + same[-1].size
    there = sum(x.size for x in same)
    gone = [w for i, w in enumerate(notice) if not any(x.a <= i < x.a + x.size for x in same)]
    come = [w for i, w in enumerate(words[first:last], first - lo) if not any(x.b <= i < x.b + x.size for x in same)]
    telling = any(w in TELLING or any(c.isdigit() for c in w) for w in gone + come)
    if telling or there < LEAST_ALIKE * len(notice) or len(come) > (1 - LEAST_ALIKE) * len(notice):
        return None
    if (gone or come) and len(notice) < EXACT_BELOW:
        return None
    return first, last, [f"-{w}" for w in gone] + [f"+{w}" for w in come]


def _notices_in(name: str, words: list[str], base: int = 0) -> Iterator[tuple[int, int, list[str]]]:
    """All places of a license's notices, the longest notice first."""
    for notice in _notice_words(name):
        found = differences(notice, words)
        if found:
            first, last, diff = found
            yield from _notices_in(name, words[:first], base)
            yield base + first, base + last, diff
            yield from _notices_in(name, words[last:], base + last)
            return


def _apart(found: list[tuple[str, int, int, float, str]]) -> list[tuple[str, int, int, float, str]]:
    """Of places that overlap, as windows do, the one with the fewest differences, then the longest."""
    out: list[tuple[str, int, int, float, str]] = []
    for x in sorted(found, key=lambda x: (len(x[4].split()) / (x[2] - x[1]), x[1] - x[2], x)):
        if all(x[2] <= y[1] or y[2] <= x[1] for y in out):
            out.append(x)
    return sorted(out, key=lambda x: x[1:3])


def find_in(text: bytes) -> list[tuple[str, int, int, float, str]]:
    """(license, start, end, reduction, differences) of each confirmed notice, in code points."""
    found: dict[tuple[int, int], tuple[str, int, int, float, str]] = {}
    byte = before = 0
    for block in candidate_blocks(text):
        for a, b in _windows(*block):
            while 0 < a < len(text) and text[a] & 0xC0 == 0x80:  # not inside a character
                a -= 1
            piece = text[a:b].decode(errors="ignore")
            spans, words, taken = [], [], []
            for m in _WORD.finditer(piece):
                if bare := m[0].strip(_EDGES).lower():
                    spans.append(m.span())
                    words.append(bare)
            before += len(text[byte:a].decode(errors="ignore"))  # windows start one after the other
            byte = a
            for reduction, name in ranked(text[a:b], possible(words)):
                for first, last, diff in _notices_in(name, words):
                    if any(first < y and x < last for x, y in taken):
                        continue
                    taken.append((first, last))
                    at = before + spans[first][0], before + spans[last - 1][1]
                    found.setdefault(at, (name, *at, reduction, " ".join(diff)))
    return _apart(list(found.values()))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FOUND_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
    for batch in batches:
        texts = string_column(batch, "text")
        rows = [(i, *x) for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for x in find_in(t.as_buffer().to_pybytes())]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def find(docs: DataFrame) -> DataFrame:
    """One row per license notice in a text; see FOUND_SCHEMA.

    start and end are code points, end exclusive, of the notice's words; differences lists
    words of the notice that are missing (-) and words that came between (+), empty for the
    exact wording. Null and empty texts have none; repeated rows give their rows again; a
    null doc_id is kept. Other columns are not read. No documents: no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, FOUND_SCHEMA)
