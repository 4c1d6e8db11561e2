"""License scans by conditional compression.

A stretch of text that holds a license compresses far better once the compressor knows the license:
each candidate stretch is compressed with every template as a zstandard raw-content dictionary, and
the templates are ranked by how much smaller it gets. In that order the exact wording differences
confirm or reject them, down to the last template whose words can stand in the stretch, so that no
statement is lost where compression ranks it low.
"""

from __future__ import annotations

import bisect
import difflib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.shipping import ship_package

#: Wordings by which texts state their license. Several wordings may name one license.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: A stretch is a candidate if it has one of these near it, in any case.
CUES = ("licen", "copyright", "permission", "redistribut", "warrant", "spdx", "public domain", "creative commons", "cc by", "cc0")
_CUE = re.compile("|".join(CUES), re.IGNORECASE)
_WORD = re.compile(r"[\w.+-]*\w")
#: The bounds of a confirmed match: share of the template's words found in order, and words that may
#: differ, by share.
LEAST_FOUND, MOST_DIFFERENT = 0.8, 0.25
LEVEL = 3
#: Bytes, and share of the most saved, by which gains may differ and still leave the choice to the wording differences.
EVEN, EVEN_SHARE = 12, 0.25


class _Compressors:
    """Compressors of a worker: one without a dictionary, one for each template."""

    shared: _Compressors | None = None

    def __init__(self) -> None:
        import zstandard

        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(compression_params=settings)
        self.given = []
        for name, text in TEMPLATES:
            known = zstandard.ZstdCompressionDict(_flat(text).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.given.append((name, _words(text), zstandard.ZstdCompressor(dict_data=known, compression_params=settings)))
        #: numbers of the templates' words, 0 for any other, and which of them each template has
        self.code = {w: n for n, w in enumerate(sorted({w for _, wording, _ in self.given for w in wording}), 1)}
        self.member = np.zeros((len(self.given), len(self.code) + 1), dtype=np.int64)
        for k, (_, wording, _) in enumerate(self.given):
            self.member[k, [self.code[w] for w in wording]] = 1

    def gains(self, part: str) -> list[int]:
        """Bytes that each template saves in compressing a part."""
        raw = _flat(part).encode()
        alone = len(self.plain.compress(raw))
        return [alone - len(c.compress(raw)) for _, _, c in self.given]

    @classmethod
    def get(cls) -> _Compressors:
        if cls.shared is None:
            cls.shared = cls()
        return cls.shared


def _flat(text: str) -> str:
    return " ".join(text.lower().split())


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _widest() -> int:
    """Words that the longest template may take, with what is added."""
    return max(_width(len(wording)) for _, wording, _ in _Compressors.get().given)


def _width(length: int) -> int:
    return int((1 + MOST_DIFFERENT) * length) + 1


def blocks(text: str) -> list[tuple[int, int]]:
    """Candidate blocks of a text as code point spans: as many words around each cue as a template may take.

    Paragraphs, line ends and comment marks don't matter; blocks that overlap are one.
    """
    cues = [m.start() for m in _CUE.finditer(text)]
    if not cues:
        return []
    words, reach = [(m.start(), m.end()) for m in _WORD.finditer(text)], _widest()
    starts = [w[0] for w in words]
    out: list[tuple[int, int]] = []
    for cue in cues:
        at = bisect.bisect_right(starts, cue) - 1
        low, high = max(0, at - reach), min(len(words), at + reach + 1)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return [(words[low][0], words[high - 1][1]) for low, high in out if high > low]


def _stretches(codes: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """Bounded stretches of words, as (first, end), in one of which each place of template ``k`` lies whole.

    A confirmed wording has its share of the template's words inside as many words as the template
    may have with what is added, so a window with fewer of them can't hold one. The windows left
    are taken together by half the template's length, so stretches overlap.
    """
    tools = _Compressors.get()
    length = len(tools.given[k][1])
    width, need = _width(length), length - int((1 - LEAST_FOUND) * length)
    upto = np.concatenate(([0], np.cumsum(tools.member[k][codes])))
    first = np.arange(len(codes))
    held = np.flatnonzero(upto[np.minimum(first + width, len(codes))] - upto[:-1] >= need)
    step, at = max(1, length // 2), 0
    while at < len(held):
        last = int(np.searchsorted(held, held[at] + step, side="right")) - 1
        yield int(held[at]), min(int(held[last]) + width, len(codes))
        at = last + 1


def _best_window(block: str, wording: list[str]) -> tuple[int, int, list[str], list[str]]:
    """Where in a block a wording stands: (start, end, words missing, words added), code points."""
    found = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
    words = [w for w, _, _ in found]
    matches = [m for m in difflib.SequenceMatcher(None, wording, words, autojunk=False).get_matching_blocks() if m.size]
    if not matches:
        return 0, 0, list(wording), []
    # the stretch around the longest match that the wording can cover
    core = max(matches, key=lambda m: (m.size, -m.b))
    best = None
    for slack in (2, 2 + int(MOST_DIFFERENT * len(wording))):  # what is added may push its ends farther off
        low, high = max(0, core.b - core.a - slack), min(len(words), core.b + len(wording) - core.a + slack)
        window = words[low:high]
        codes = difflib.SequenceMatcher(None, wording, window, autojunk=False).get_opcodes()
        while codes and codes[0][0] == "insert":
            codes.pop(0)
        while codes and codes[-1][0] == "insert":
            codes.pop()
        missing = [w for tag, a, b, _, _ in codes if tag in ("delete", "replace") for w in wording[a:b]]
        added = [w for tag, _, _, a, b in codes if tag in ("insert", "replace") for w in window[a:b]]
        equal = [(c, d) for tag, _, _, c, d in codes if tag == "equal"]
        if equal and (best is None or len(missing) + len(added) < len(best[2]) + len(best[3])):
            best = (found[low + equal[0][0]][1], found[low + equal[-1][1] - 1][2], missing, added)
        if not missing and not added:
            break
    return best or (0, 0, list(wording), [])


def _clusters(spans: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Stretches (first, end, template) that overlap, together."""
    out: list[list[tuple[int, int, int]]] = []
    stop = -1
    for span in sorted(spans):
        if span[0] >= stop:
            out.append([])
        out[-1].append(span)
        stop = max(stop, span[1])
    return out


def scan_block(block: str) -> list[tuple[str, int, int, int, int, str, str]]:
    """Licenses confirmed in a block: (license, start, end, bytes saved, rank, missing, added).

    Where a template's words can stand, the stretch around is compressed with all templates. In the
    order of what they save, those that can stand there are compared word by word; the confirmed
    wording that saves most wins, and of wordings that save nearly as much (EVEN) the one with the
    fewest differences. What lies between found wordings is scanned again, so that a block may state
    several licenses.
    """
    tools, out = _Compressors.get(), []
    words = [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(block)]
    codes = np.fromiter((tools.code.get(w, 0) for w, _, _ in words), dtype=np.int64, count=len(words))
    starts = [w[1] for w in words]
    queue = [(0, len(words))]
    while queue:
        low, high = queue.pop()
        spans = [(low + first, low + end, k) for k in range(len(tools.given)) for first, end in _stretches(codes[low:high], k)]
        taken: list[tuple[int, int]] = []
        for cluster in _clusters(spans):
            confirmed = _confirmed(block, words, cluster)
            while confirmed:
                most = max(c[0] for c in confirmed)
                best = min((c for c in confirmed if c[0] >= most - max(EVEN, EVEN_SHARE * most)), key=lambda c: c[1])
                gain, _, name, start, stop, rank, missing, added = best
                taken.append((start, stop))
                out.append((name, start, stop, gain, rank, " ".join(missing), " ".join(added)))
                confirmed = [c for c in confirmed if c[4] <= start or stop <= c[3]]
        at = low
        for start, stop in sorted(taken):
            queue.append((at, bisect.bisect_left(starts, start)))
            at = bisect.bisect_left(starts, stop)
        if taken:
            queue.append((at, high))
    return sorted(out, key=lambda x: (x[1], x[0]))


def _confirmed(block: str, words: list[tuple[str, int, int]], cluster: list[tuple[int, int, int]]) -> list[tuple]:
    """(gain, order, license, start, end, rank, missing, added) of the wordings of a cluster that hold.

    What templates save in their stretches ranks them; of a wording that holds, the gain is that of
    its very place, without what stands around. ``order`` puts fewer differences, longer wordings,
    better ranks and earlier places first.
    """
    tools = _Compressors.get()
    found: list[tuple] = []
    gains: dict[tuple[int, int], list[int]] = {}
    for first, end, k in cluster:
        offset, to = words[first][1], words[end - 1][2]
        if (first, end) not in gains:
            gains[first, end] = tools.gains(block[offset:to])
        gain = gains[first, end]
        found.append((-gain[k], k, offset, to, sorted(range(len(gain)), key=lambda j: (-gain[j], j)).index(k)))
    out = []
    for _, k, offset, to, rank in sorted(found):
        name, wording, _ = tools.given[k]
        start, stop, missing, added = _best_window(block[offset:to], wording)
        different = len(missing) + len(added)
        if len(missing) <= (1 - LEAST_FOUND) * len(wording) and different <= MOST_DIFFERENT * len(wording):
            gain = tools.gains(block[offset + start : offset + stop])[k]
            out.append((gain, (different / len(wording), -len(wording), rank, offset + start), name, offset + start, offset + stop, rank, missing, added))
    return out


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses stated in each whole text.

    Returns a row for each finding: (id, start, end, license, saved_bytes, compression_rank,
    missing_words, added_words, exact); spans in code points. Texts without a finding, null ones
    among them, give no row; repeated rows give repeated findings, an empty table none. Texts are read
    whole, however long. Of wordings that tie the longer one counts, then the earlier. Further columns
    are ignored.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                for low, high in blocks(text or ""):
                    rows += [(key, low + s, low + e, name, saved, rank, missing, added, not missing and not added) for name, s, e, saved, rank, missing, added in scan_block(text[low:high])]
            yield pd.DataFrame(rows, columns=names)

    kind = df.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, start long, end long, license string, saved_bytes long, compression_rank int, missing_words string, added_words string, exact boolean"
    names = [f.split()[0].strip("`") for f in fields.split(", ")]
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.lower("text").rlike("|".join(CUES)))
    return source.mapInPandas(run, fields)


def document_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each id with the sorted distinct licenses its texts state, empty for none: (id, licenses, n_findings).

    One row per id, null being one; findings of repeated ids are counted together. An empty table
    gives no rows; further columns are ignored.
    """
    key = F.struct(F.col(id_col).alias("id"))  # equal to another one where both ids are null
    found = find_licenses(df, id_col, text_col).groupBy(key.alias("key")).agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"), F.count("*").alias("n_findings")
    )
    keys = df.select(key.alias("key")).distinct()
    return keys.join(found, "key", "left").select(F.col("key.id").alias(id_col), F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_findings", F.lit(0)).alias("n_findings"))
