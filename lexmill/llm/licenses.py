"""License scans: winnowed fingerprints, an inverted index and banded alignment.

Templates are cut into runs of three words; of the hashes of a template the smallest in each
window of two is kept (all of a template of at most eight words) and entered in an
inverted index. A document's runs are looked up in it; hits on one template whose places differ by
about the same amount make a candidate. Unless fewer of the template's words than are asked for occur within a band around that difference, its
words and the template's are aligned within the band, and the matched share of the template, and the span of the text, are reported
if the share is at least ``SHARE`` (all of it for templates of at most ``WHOLE`` words, which may differ in
one name only). Overlapping reports of one template are merged to the best;
a report that lies inside one of a longer template is left out.

The catalogue of templates is a parameter and bounded (``CATALOGUE`` words); documents are scanned
where they are, whole, so there is no shuffle and no group. Words are compared in lower case
without punctuation. Null and empty texts have no matches; null ids and repeated rows are
reported like any other; other columns are ignored; empty tables give empty ones.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, table
from .words import Vocabulary, window_hashes

RUN = 3
WINNOW = 2
WHOLE = 8
SHARE = 0.8
BAND = 8
FEW = 64  # candidates whose words are compared one by one
CATALOGUE = 1_000_000

#: Wordings of licenses and of notices that refer to them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
    "THE SOFTWARE.",
    "MIT-0-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. "
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE.",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "0BSD-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-licensed": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
    "redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the "
    "original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered "
    "source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from "
    "any source distribution.",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "BSL-1.0-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the '
    "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GNU-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GFDL-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later "
    "version published by the Free Software Foundation",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
    "https://www.eclipse.org/legal/epl-2.0/",
    "CC-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL-text": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is "
    "changed.",
    "OFL-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at",
    "public-domain": "This work has been released into the public domain by its author.",
    "reserved": "All rights reserved. No part of this publication may be reproduced without permission.",
    "reserved-text": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, "
    "recording, or other electronic or mechanical methods, without the prior written permission of the publisher",
}
#: Families of like wordings.
GNU = {"GPL": ("", ("2", "3")), "LGPL": ("Lesser ", ("2.1", "3")), "AGPL": ("Affero ", ("3",))}
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives"}
CC |= {"BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause ISC Zlib BSL-1.0 MPL-2.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later CC0-1.0 Unlicense".split()
for _name, (_kind, _versions) in GNU.items():
    for _v in _versions:
        _full = f"{_name}-{_v}" if "." in _v else f"{_name}-{_v}.0"
        TEMPLATES[_full] = f"This work is licensed under the GNU {_kind}General Public License, version {_v}."
for _name, _long in CC.items():
    for _v in ("3.0", "4.0"):
        TEMPLATES[f"CC-{_name}-{_v}"] = f"Licensed under CC {_name} {_v}."
    TEMPLATES[f"CC-{_name}-4.0-sentence"] = f"This work is licensed under a Creative Commons {_long} 4.0 International License."
del TEMPLATES["CC-BY-4.0-sentence"]  # CC-notice
for _name in SPDX:
    TEMPLATES[f"{_name}-tag"] = f"SPDX-License-Identifier: {_name}"


def winnowed(hashes: np.ndarray, words: int, window: int = WINNOW) -> list[int]:
    """Places of the smallest hash of each window, the last of equal ones; all places of a short text."""
    if words <= WHOLE or len(hashes) <= window:
        return list(range(len(hashes)))
    out = []
    for at in range(len(hashes) - window + 1):
        part = hashes[at : at + window]
        place = at + window - 1 - int(np.argmin(part[::-1]))
        if not out or out[-1] != place:
            out.append(place)
    return out


class Index:
    """Fingerprints of templates with the template and place of each."""

    def __init__(self, templates: dict[str, str]):
        self.vocabulary = Vocabulary()
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        entries: dict[int, list[tuple[int, int]]] = {}
        for t, name in enumerate(self.names):
            hashes, _ = hashed(self.vocabulary, templates[name].split())
            self.words.append(hashes)
            runs = window_hashes(hashes, min(RUN, len(hashes)) or 1)
            for place in winnowed(runs, len(hashes)):
                entries.setdefault(int(runs[place]), []).append((t, place))
        if sum(map(len, self.words)) > CATALOGUE:
            raise ValueError("the catalogue is too large to be sent to every task")
        self.entries = entries
        self.runs = sorted({min(RUN, len(w)) for w in self.words if len(w)})
        self.keys = np.array(sorted(entries), dtype=np.uint64)
        self.bits = np.zeros(1 << 16, dtype=bool)
        self.bits[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in it, place in the document), by template and difference."""
        out = []
        for n in self.runs:
            runs = window_hashes(hashes, n)
            maybe = np.nonzero(self.bits[(runs & np.uint64(0xFFFF)).astype(np.int64)])[0]
            if len(maybe) and len(self.keys):
                found = runs[maybe]
                k = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
                for p in maybe[self.keys[k] == found].tolist():
                    out += [(t, place, p) for t, place in self.entries[int(runs[p])] if min(RUN, len(self.words[t])) == n]
        return sorted(out, key=lambda x: (x[0], x[2] - x[1], x[2]))


def hashed(vocabulary: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words that have letters or digits, and their places in the list."""
    codes = vocabulary.codes(words)
    kept = np.nonzero(vocabulary.kind[codes] >= 0)[0] if len(codes) else np.zeros(0, dtype=np.int64)
    return vocabulary.hash[codes[kept]] if len(kept) else np.zeros(0, dtype=np.uint64), kept


def aligned(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND, start: int = 0) -> tuple[int, int, int]:
    """(matched, first, past): most template words matched in order within a band around ``shift``, fewest text words between.

    A longest common subsequence of template and text, template word i against text words
    i + shift - band to i + shift + band, none before ``start``; among the longest that which spans the fewest words, the earliest of equal ones.
    """
    low = -band
    width = 2 * band + 1
    best: dict[int, tuple[int, int]] = {}  # by last text word: (matched, first), the latest first of the most matched
    for i in range(len(template)):
        new = dict(best)
        carried, order = (0, 0), sorted(best)
        at = 0
        for j in range(max(start, i + shift + low), min(len(text), i + shift + low + width)):
            while at < len(order) and order[at] < j:
                carried = max(carried, best[order[at]])
                at += 1
            if template[i] == text[j]:
                new[j] = max(new.get(j, (0, 0)), (carried[0] + 1, carried[1] if carried[0] else j))
        best = new
    if not best:
        return 0, 0, 0
    matched = max(m for m, _ in best.values())
    _, first, past = min((j + 1 - f, f, j + 1) for j, (m, f) in best.items() if m == matched)
    return matched, first, past


def reachable(template: np.ndarray, text: np.ndarray, shifts: np.ndarray, band: int = BAND) -> np.ndarray:
    """For each of the rising shifts, how many template words have an equal text word within the band around it: no alignment matches more."""
    if len(shifts) <= FEW:
        places = shifts[:, None, None] + np.arange(len(template))[:, None] + np.arange(-band, band + 1)
        equal = (text[np.clip(places, 0, len(text) - 1)] == template[:, None]) & (places >= 0) & (places < len(text))
        return equal.any(axis=2).sum(axis=1)
    # all shifts from the first to the last at once: a word's occurrences before the end of its band less those before the beginning
    out, low = np.zeros(len(shifts), dtype=np.int64), int(shifts[0]) - band
    size = int(shifts[-1]) - int(shifts[0]) + len(template) + 2 * band
    part = text[max(0, low) : max(0, low + size)]
    before = np.zeros(size + 1, dtype=np.int32)
    for i, word in enumerate(template):
        here = max(0, -low) + np.flatnonzero(part == word)
        if len(here):
            before[:] = 0
            before[here + 1] = 1
            np.cumsum(before, out=before)
            begin = shifts - band - low + i
            out += before[begin + 2 * band + 1] > before[begin]
    return out


class Spans:
    """Disjoint spans, by place."""

    def __init__(self):
        self.first: list[int] = []
        self.past: list[int] = []

    def add(self, first: int, past: int) -> bool:
        """Adds a span, if it overlaps none."""
        at = bisect.bisect_left(self.first, past)  # the spans before it begin before this one's end
        if at and self.past[at - 1] > first:
            return False
        self.first.insert(at, first)
        self.past.insert(at, past)
        return True


def scan(index: Index, vocabulary: Vocabulary, text: str, share: float = SHARE, band: int = BAND) -> list[tuple[str, int, int, float, int, int]]:
    """(license, matched words, template words, coverage, start, end) of the templates in a text, by place; characters start to end."""
    words = text.split()
    hashes, kept = hashed(vocabulary, words)
    if not len(hashes):
        return []
    hits = index.hits(hashes)
    if not hits:
        return []
    found, group = [], []

    def close():
        t = group[0][0]
        template = index.words[t]
        start = 0  # a short template may be in one band twice: what a report has is no other's
        need = share * len(template) if len(template) > WHOLE else len(template)
        shifts = sorted({p - place for _, place, p in group})
        for shift, most in zip(shifts, reachable(template, hashes, np.array(shifts), band)):
            if most < need:
                continue
            matched, first, past = aligned(template, hashes, shift, band, start)
            if matched >= need:
                found.append((t, matched, first, past))
                if len(template) <= band:
                    start = past

    for hit in hits:
        if group and (hit[0] != group[-1][0] or (hit[2] - hit[1]) - (group[-1][2] - group[-1][1]) > band):
            close()
            group = []
        group.append(hit)
    close()
    # of overlapping reports of a template the best, then none inside a longer template's
    kept_reports, taken = [], {}
    for r in sorted(set(found), key=lambda r: (-r[1] / len(index.words[r[0]]), r[3] - r[2], r[2], r[0])):
        if taken.setdefault(r[0], Spans()).add(r[2], r[3]):
            kept_reports.append(r)
    best, spans = [], Spans()
    for r in sorted(kept_reports, key=lambda r: (-r[1], -r[1] / len(index.words[r[0]]), r[0], r[2])):
        if spans.add(r[2], r[3]):
            best.append(r)
    places = [m.span() for m in re.finditer(r"\S+", text)]
    return [(index.names[t], m, len(index.words[t]), m / len(index.words[t]), places[kept[a]][0], places[kept[b - 1]][1]) for t, m, a, b in sorted(best, key=lambda r: (r[2], r[3]))]


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """One row per match in documents (doc_id, text): doc_id, license, matched, words, coverage, start, end (characters)."""
    templates = TEMPLATES if templates is None else templates
    Index(templates)  # fails here, not in a task, if the catalogue is too large

    def run(batches):
        index = Index(templates)
        vocabulary = Vocabulary()
        for b in batches:
            rows = [(doc, *m) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in scan(index, vocabulary, text or "", share)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "license", "matched", "words", "coverage", "start", "end"])

    return bounded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).mapInArrow(
        run, "doc_id long, license string, matched long, words long, coverage double, start long, end long"
    )


def op4_license_scans(spark, sf_dir):
    return licenses(table(spark, sf_dir, "documents"))
