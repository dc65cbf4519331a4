"""License scans by conditional compression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Wordings of common licenses and notices. A name may have several wordings.
TEMPLATES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work is published under CC0 1.0 Universal."),
    ("All-Rights-Reserved", "All rights reserved."),
]
#: A text without any of these (lower-cased) has no candidate block.
CUES = ("licen", "permission", "redistribut", "all rights reserved", "public domain", "free software", "waived all copyright")
CUE = re.compile("|".join(c.replace(" ", r"[\W_]+") for c in CUES))
#: A word of each cue, the rarest: a text without any of them needs no search.
RARE = tuple(max(c.split(), key=len) for c in CUES)
WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: The share of differing words that still confirms.
TOLERANCE = 0.12


def _words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


class Scanner:
    """Finds, ranks and confirms. Each template is a raw zstandard dictionary, made once."""

    def __init__(self, templates=TEMPLATES, level: int = 3):
        self.names = [n for n, _ in templates]
        self.words = [_words(t) for _, t in templates]
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.with_dict = []
        for words in self.words:
            # a raw dictionary has 8 bytes at least; the compressor reads it from the end
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode().rjust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.with_dict.append(zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_dict_id=False))
        self.counts = [Counter(w) for w in self.words]
        self.number = {w: i for i, w in enumerate(sorted({w for x in self.words for w in x}))}
        self.most = [int(TOLERANCE * len(w)) for w in self.words]
        #: Words on either side of a cue that a match can reach.
        self.reach = max((len(w) + m for w, m in zip(self.words, self.most)), default=0)

    def ranked(self, words: list[str], among: list[int]) -> list[tuple[float, int]]:
        """Templates by the share of the words' compressed bytes that they save, the best first, ties in their order."""
        data = " ".join(words).encode()
        base = len(self.plain.compress(data))
        return sorted(((1 - len(self.with_dict[i].compress(data)) / base, i) for i in among), key=lambda x: (-x[0], x[1]))

    def confirm(self, words: list[str], i: int) -> list[tuple[int, int, int, int]]:
        """(from, to, equal words, differing words) of the stretches of `words` that template i matches within the
        tolerance: for each end the alignment of fewest differing words, and of those with one start the best."""
        t, most = self.words[i], self.most[i]
        have = set(words)
        if sum(n for w, n in self.counts[i].items() if w not in have) > most:
            return []
        block = np.array([self.number.get(w, -1) for w in words], np.int64)
        n = len(block)
        # one number holds the differing words, then the equal ones (more are better), then the start
        same = 1 << n.bit_length()
        differs = same * (len(t) + 1)
        step = np.arange(n + 1) * differs
        cost = np.arange(n + 1)
        for w in t:
            after = cost + differs
            np.minimum(after[1:], cost[:-1] + np.where(block == self.number[w], -same, differs), out=after[1:])
            cost = np.minimum.accumulate(after - step) + step
        start = cost % same
        diff = (cost // same + len(t)) // (len(t) + 1)
        equal = diff * (len(t) + 1) - cost // same
        best: dict[int, tuple] = {}
        for e in np.flatnonzero((diff <= most) & (equal > 0)):
            x = (int(diff[e]), -int(equal[e]), int(e))
            a = int(start[e])
            if a not in best or x < best[a]:
                best[a] = x
        return [(a, e, -q, d) for a, (d, q, e) in best.items()]

    def found(self, words: list[str]) -> list[tuple]:
        """(from, to, license, reduction, equal words, differing words) of the notices in the words, none overlapping.

        The longest match goes first; of it and those that overlap it, the template wins that saves most of what they
        cover. What the matches leave is searched again."""
        cand = [(a, e, i, q, d) for i in range(len(self.words)) for a, e, q, d in self.confirm(words, i)]
        cand.sort(key=lambda x: (x[4] - x[3], x[4], x[0], x[2]))
        used, out = np.zeros(len(words), bool), []
        by_start = sorted(cand)
        starts = np.array([x[0] for x in by_start], np.int64)
        for a, e, *_ in cand:
            if used[a:e].any():
                continue
            low, high = np.searchsorted(starts, (a - self.reach, e))
            near = [x for x in by_start[low:high] if x[1] > a and not used[x[0] : x[1]].any()]
            lead = {}
            for x in near:  # each template's best match here
                if x[2] not in lead or (x[4] - x[3], x[4], x[0]) < (lead[x[2]][4] - lead[x[2]][3], lead[x[2]][4], lead[x[2]][0]):
                    lead[x[2]] = x
            order = self.ranked(words[min(x[0] for x in lead.values()) : max(x[1] for x in lead.values())], list(lead))
            gain, i = order[0]
            used[lead[i][0] : lead[i][1]] = True
            if gain > 0:
                out.append((lead[i][0], lead[i][1], self.names[i], gain, lead[i][3], lead[i][4]))
        if out:
            edge = np.flatnonzero(np.diff(np.concatenate([[1], used, [1]]).astype(np.int8)))
            for a, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                out += [(a + x[0], a + x[1], *x[2:]) for x in self.found(words[a:e])]
        return sorted(out)

    def scan(self, text: str | None) -> list[tuple]:
        """(start, end, license, reduction, matched words, differing words) of the text's notices, confirmed ones only.

        Blocks are the words within reach of a cue on both sides, across line breaks and blank lines; those that meet are one."""
        text = text or ""
        low = text.lower()
        if not any(c in low for c in RARE):
            return []
        if len(low) != len(text):  # a letter whose lower case is longer: keep places by lowering letter by letter
            low = "".join(c.lower()[0] for c in text)
        cues = [m.start() for m in CUE.finditer(low)]
        if not cues:
            return []
        places = [(m.start(), m.end(), m[0]) for m in WORDS.finditer(low)]
        at = np.searchsorted([p[0] for p in places], cues, side="right") - 1
        out, a, b = [], 0, 0
        for c in [*at.tolist(), None]:
            if c is None or c - self.reach > b:
                out += [(places[a + x[0]][0], places[a + x[1] - 1][1], *x[2:]) for x in (self.found([p[2] for p in places[a:b]]) if b else [])]
                a = max(0, c - self.reach) if c is not None else 0
            b = min(len(places), c + self.reach + 1) if c is not None else b
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per license notice: id_col, start, end (characters of the text), license, reduction, n_same, n_diff.

    Whole texts are read where they are; nothing is shuffled. A null or empty text has no notice; repeated rows give
    their notices again; other columns of docs play no part."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(templates)
        for frame in frames:
            rows = [(d, *x) for d, t in zip(frame.id, frame.text) for x in s.scan(t)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "license", "reduction", "n_same", "n_diff"]).astype({"id": frame.id.dtype, "start": "int64", "end": "int64", "reduction": "float64", "n_same": "int32", "n_diff": "int32"})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, run, "id {id}, start long, end long, license string, reduction double, n_same int, n_diff int").withColumnRenamed("id", id_col)
