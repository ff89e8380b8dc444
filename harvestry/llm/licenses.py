"""License scans by conditional compression.

Lines with a cue word give candidate blocks. A block is compressed alone and with each license template as a raw
zstandard dictionary; templates are ranked by the share of their own size that they save. They are confirmed by exact
wording differences: a template is found if its words stand in the block in order, with few missing or added, and with
all its telling words (names, numbers, clause letters). Those that save enough come first; what a block repeats or how its
other words are coded can hide an exact notice's share, so the others follow where none of those fits. All places of a
template in a block are confirmed together: a short one's around its telling words, a long one's part by part. A list of
templates is a parameter; notices in other words than those given are not found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, each_batch, read_table, texts_of

#: Notices and license texts as they are commonly published, by SPDX-like name; a caller may pass others.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Released under the ISC License.",
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "GPL-3.0-short": "Licensed under GPLv3.",
    "GPL-2.0-short": "Licensed under GPLv2.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EUPL-1.2": "Licensed under the EUPL, Version 1.2.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC0-1.0": "This work is released under CC0 1.0 into the public domain.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Identifiers that a tag may name, each a template of its own.
TAGGED = "Apache-2.0 MIT ISC BSD-2-Clause BSD-3-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 Unlicense Zlib BSL-1.0"
TEMPLATES |= {f"{name}-tag": f"SPDX-License-Identifier: {name}" for name in TAGGED.split()}
CUES = re.compile(rb"licen[cs]|copyright|permission|public domain|redistribution|warrant", re.I)
WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+(?:[.-][A-Za-z0-9]+)*")
#: Words that may differ between wordings of one notice; every other word of a short notice is telling. Of a long one numbers
#: are, and the words that tell kinds of a license apart.
LOOSE = frozenset(b"a an and any are by distributed following free in into is it of or released licensed licence license software source the this to under use version work v".split())
KINDS = frozenset((b"affero", b"lesser"))
#: What joins the names of a tag.
JOINED = re.compile(rb"\s+(?:OR|AND|WITH)\s+\(?([A-Za-z0-9.+-]+)\)?")
#: Words up to which a notice is short.
SHORT = 16
#: Saved share of a template's own size from which on it comes first and, if rejected, splits the block; share of a
#: template's words that must be found, and words that may come between.
SAVED, FOUND, BETWEEN = 0.4, 0.85, 6
#: Bytes of a block before and after a cue, as multiples of the longest template.
REACH = 2


def words(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


@lru_cache(4)
def prepared(templates: tuple[tuple[str, str], ...]) -> list[tuple]:
    """Per template: name, compressor with it as a raw dictionary, its own compressed size, its words, its telling words."""
    out = []
    for name, text in templates:
        data = text.encode()
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        listed = words(data)[0]
        telling = [w for w in listed if w not in LOOSE and (len(listed) <= SHORT or w in KINDS or any(48 <= b < 58 for b in w))]
        out.append((name, zstandard.ZstdCompressor(level=19, dict_data=raw, write_content_size=False), len(alone(data)), listed, telling))
    return out


def alone(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=19, write_content_size=False).compress(data)


def blocks(text: bytes, reach: int) -> list[tuple[int, int]]:
    """Byte ranges around cues: from the start of the cue's line to the end of the line, at most `reach` either way and on
    into following lines up to the first blank one; ranges that meet, or follow each other as paragraphs, are one."""
    out: list[list[int]] = []
    for m in CUES.finditer(text):
        low, high = max(0, m.start() - reach), min(len(text), m.end() + reach)
        start = max(text.rfind(b"\n", low, m.start()) + 1, low)
        end = text.find(b"\n\n", m.end(), high)
        end = high if end < 0 else end
        if out and start <= out[-1][1] + 2:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def weight(found: list[bytes], template: list[bytes]) -> float:
    """How much of a template the words are: in a short one, words that may differ count a quarter."""
    return sum(0.25 if w in LOOSE else 1 for w in found) if len(template) <= SHORT else len(found)


def may_hold(block: list[bytes], template: list[bytes], telling: list[bytes]) -> bool:
    """Whether the block has the telling words and enough of the others, in any order."""
    known = set(block)
    return known.issuperset(telling) and weight([w for w in template if w in known], template) >= FOUND * weight(template, template)


def confirm(block: list[bytes], template: list[bytes], telling: list[bytes]) -> tuple[int, int, int, int] | None:
    """First and last word of the template's place in the block, missing and added words; None if the wordings differ too much."""
    if not may_hold(block, template, telling):
        return None
    enough = FOUND * weight(template, template)
    matcher = SequenceMatcher(None, block, template, autojunk=False)
    runs = [m for m in matcher.get_matching_blocks() if m.size]
    if not runs:
        return None
    # The longest run is the core; runs that are near it belong to the same place.
    core = max(range(len(runs)), key=lambda i: runs[i].size)
    low = high = core
    while low and runs[low].a - runs[low - 1].a - runs[low - 1].size <= BETWEEN:
        low -= 1
    while high + 1 < len(runs) and runs[high + 1].a - runs[high].a - runs[high].size <= BETWEEN:
        high += 1
    place = runs[low : high + 1]
    found = [w for m in place for w in template[m.b : m.b + m.size]]
    if weight(found, template) < enough or any(w not in found for w in telling):
        return None
    first, last = place[0].a, place[-1].a + place[-1].size
    if not KINDS.intersection(block[first:last]).issubset(template):
        return None
    return first, last, len(template) - len(found), last - first - len(found)


#: First and last word of a place, missing and added words.
Place = tuple[int, int, int, int]


def around_telling(block: list[bytes], template: list[bytes], telling: list[bytes]) -> Iterator[Place]:
    """The places of a short template: each holds its telling words, so each stands around the one that the block has least often."""
    once = [w for w in telling if template.count(w) == 1] or telling
    least = min(once, key=block.count)
    at = [i for i, w in enumerate(block) if w == least]
    reach = len(template) * (BETWEEN + 1)
    for before, i, after in zip([-1, *at], at, [*at[1:], len(block)], strict=False):
        low, high = max(before + 1, i - reach), min(after, i + reach)
        if place := confirm(block[low:high], template, telling):
            yield low + place[0], low + place[1], *place[2:]


def in_parts(block: list[bytes], template: list[bytes], telling: list[bytes]) -> Iterator[Place]:
    """The places of a long template: the best one, then those in what is left on both sides. A stretch that shares words with
    the template but is no place of it is a border too."""
    rest = [(0, len(block))]
    while rest:
        a, b = rest.pop()
        part = block[a:b]
        if not may_hold(part, template, telling):
            continue
        place = confirm(part, template, telling)
        if place:
            first, last = place[:2]
            yield a + first, a + last, *place[2:]
        else:
            run = SequenceMatcher(None, part, template, autojunk=False).find_longest_match()
            first, last = run.a, run.a + run.size
        if first < last:
            rest += [(a, a + first), (a + last, b)]


Find = tuple[str, int, int, float, int, int]


@lru_cache(2048)
def inside(window: bytes, templates: tuple[tuple[str, str], ...]) -> list[Find]:
    """Confirmed licenses of a window: name, byte range, saved share, missing and added words; the best of each place. Remembered.

    The window is compressed once with each template. All places of all templates are confirmed; of those that overlap, the
    ones whose template saves enough come first, then those with fewer differences, then longer ones.
    """
    size = len(alone(window))
    listed, spans = words(window)
    known, places = set(listed), []
    for name, press, own, template, telling in prepared(templates):
        if not known.issuperset(telling):
            continue
        saved = (size - len(press.compress(window))) / own
        short = telling and len(template) <= SHORT
        for place in (around_telling if short else in_parts)(listed, template, telling):
            places.append((saved < SAVED, place[2] + place[3], -len(template), place[0], -saved, name, place))
    out, free = [], bytearray(len(listed))
    for *_, saved, name, (first, last, missing, added) in sorted(places):
        if not any(free[first:last]):
            free[first:last] = b"\x01" * (last - first)
            out.append((name, spans[first][0], spans[last - 1][1], -saved, missing, added))
    return sorted(out + [x for found in out for x in alternatives(window, found, templates)], key=lambda x: x[1])


def alternatives(window: bytes, found: Find, templates: tuple[tuple[str, str], ...]) -> Iterator[Find]:
    """The other names of a tag: what follows it after OR, AND or WITH, where a template's tag has that name."""
    name, _, at, saved, *_ = found
    tags = {n for n, _ in templates if n.endswith("-tag")}
    while name.endswith("-tag") and (more := JOINED.match(window, at)):
        at = more.end()
        if f"{more[1].decode()}-tag" in tags:
            yield f"{more[1].decode()}-tag", more.start(1), more.end(1), saved, 0, 0


def find(text: bytes, templates: tuple[tuple[str, str], ...]) -> list[Find]:
    """Confirmed licenses of one text, in windows of bounded size, so that the work grows with the text and no faster.

    A notice is shorter than the reach. Of a window that others follow, those that begin in its first half are taken, which
    stand in it whole; the next one begins behind them.
    """
    reach = REACH * max((len(t.encode()) for _, t in templates), default=0)
    out = []
    for a, b in blocks(text, reach):
        while a < b:
            stop = b if a + 2 * reach >= b else a + 2 * reach
            found = [x for x in inside(text[a:stop], templates) if stop == b or x[1] < reach]
            out += [(name, a + start, a + end, *more) for name, start, end, *more in found]
            a = b if stop == b else a + max([reach, *(x[2] for x in found)])
    return out


FINDS = "doc_id long, license string, start long, length long, saved double, n_missing int, n_added int, notice string"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per license notice found in `docs` (doc_id, text): its name, byte range, saved share, wording differences and
    the notice's words. Null, empty and clean texts give none; equal texts give equal finds. Other columns are not read."""
    bounded_batches(docs.sparkSession)
    fixed = tuple(templates.items())

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
            if CUES.search(text):
                rows += [(i, n, a, b - a, s, m, p, text[a:b].decode("utf-8", "replace")) for n, a, b, s, m, p in find(text, fixed)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in FINDS.split(", ")])

    return each_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, FINDS)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
