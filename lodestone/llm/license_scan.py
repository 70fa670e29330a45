"""License scans by conditional compression.

A template of n words can only be confirmed where all but a fifth of its words stand, so any n - ceil(0.8 n) + 1 of them
hold one that does; the longest serve as anchors. Around each anchor in a whole document a candidate block is taken, as
long as the template and a quarter more, if it holds enough of the template's words in any order. Each block is compressed by zstandard alone and with every template as raw
dictionary; the templates are ranked by the bytes they save, and compared word by word in that order. A block is confirmed
for the first that saves bytes and whose wording differs in at most a fifth of its words and in none that tell templates apart
(numbers, words that only a short template has, those that a longer one's siblings lack, and half of those that a sibling
has beyond it, where they are added). Case does not count. An opening that stands inside a confirmed whole notice is not
named beside it.
"""

from __future__ import annotations

from bisect import bisect
from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate
from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import map_texts
from lodestone.llm.words import words

#: Share of a template's words that must stand in a block.
SHARE = 0.8
#: Words up to which every word that only one template has tells it apart, and likeness from which a longer template's words that another lacks do.
SHORT, SIBLING = 12, 0.6

#: Notices by which licenses are recognised.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "reserved": "All rights reserved.",
}

_NO_WARRANTY = "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_AUTHOR_DISCLAIMS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_SOURCE_AND_BINARY = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_HOLDERS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY"


def _free_software(work: str, license: str, version: str) -> str:
    """The notice that the GNU licenses ask for at the head of a file."""
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {license} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
        f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license} for more details."
    )


#: Whole license texts and file notices, without the lines that name a work or its owner.
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT-permission"] + ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": f"{_SOURCE_AND_BINARY} {_HOLDERS} {_NO_WARRANTY}",
    "BSD-3-Clause": f"{_SOURCE_AND_BINARY} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_HOLDERS} {_NO_WARRANTY}",
    "ISC": f"{TEMPLATES['ISC-permission']}, provided that the above copyright notice and this permission notice appear in all copies. {_AUTHOR_DISCLAIMS}",
    "0BSD": f"{TEMPLATES['ISC-permission']}. {_AUTHOR_DISCLAIMS}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": TEMPLATES["Apache-2.0-header"] + " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MPL-2.0-notice": TEMPLATES["MPL-2.0"] + " If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense-text": TEMPLATES["Unlicense"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "GPL-2.0-or-later": _free_software("program", "General Public License", "2"),
    "GPL-3.0-or-later": _free_software("program", "General Public License", "3"),
    "LGPL-2.1-or-later": _free_software("library", "Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later": _free_software("library", "Lesser General Public License", "3"),
    "AGPL-3.0-or-later": _free_software("program", "Affero General Public License", "3"),
}

#: Templates that are only the opening of a license, which others may share or go on from differently: equal words don't make the license exact.
OPENINGS = ("Apache-2.0-header", "MIT-permission", "GPL-header", "BSD", "MPL-2.0", "CC0", "Unlicense", "ISC-permission")


@dataclass
class Scanner:
    names: list[str]
    wordings: list[list[bytes]]
    telling: list[set[bytes]]
    foreign: list[list[set[bytes]]]  # for each sibling of a template, the words that it has and the template lacks
    anchors: np.ndarray  # hashes, sorted; template and place of each
    template: np.ndarray
    place: np.ndarray
    alone: object  # a compressor without dictionary, and one for each template
    with_template: list
    bags: list[Counter]
    vocabulary: np.ndarray  # hashes of all templates' words, sorted, and which of them a template has; the last column is for other words
    has: np.ndarray

    def holds_enough(self, t: int, here: list[bytes]) -> bool:
        """Whether the words of template t that stand in the block, in any order, could confirm it."""
        have = Counter(here)
        return sum(min(n, have[x]) for x, n in self.bags[t].items()) >= SHARE * len(self.wordings[t])

    def candidates(self, w) -> list[tuple[int, int, int]]:
        """Text, first word and end of each block that holds enough of its template, once each."""
        at = np.searchsorted(self.anchors, w.hash)
        near = np.flatnonzero(self.anchors[np.minimum(at, len(self.anchors) - 1)] == w.hash)
        if not len(near):
            return []
        known = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        known[self.vocabulary[known] != w.hash] = len(self.vocabulary)
        out, seen = set(), set()
        for i in near.tolist():
            text = int(np.searchsorted(w.first, i, "right")) - 1
            k = int(at[i])
            while k < len(self.anchors) and self.anchors[k] == w.hash[i]:
                n = len(self.wordings[self.template[k]])
                slack = n // 4
                begin = i - int(self.place[k]) - slack
                block = (int(self.template[k]), max(begin, int(w.first[text])), min(begin + n + 2 * slack, int(w.first[text + 1])))
                if block not in seen:
                    seen.add(block)
                    if self.has[block[0], known[block[1] : block[2]]].sum() >= SHARE * n and self.holds_enough(block[0], w.bytes_of(block[1], block[2] - block[1])):
                        out.add((text, *block[1:]))
                k += 1
        return sorted(out)

    def savings(self, block: bytes) -> list[tuple[int, int]]:
        """Bytes saved by each template as dictionary, most first, with the template's number."""
        alone = len(self.alone.compress(block))
        return sorted(((alone - len(c.compress(block)), -t) for t, c in enumerate(self.with_template)), reverse=True)

    def differences(self, found: list[bytes], t: int) -> tuple[list[bytes], list[bytes], int, int] | None:
        """Words of the template that the block lacks and words that stand between its own, with the block's first and last matched word; None if too many or telling ones differ."""
        own = self.wordings[t]
        pairs = [p for p in SequenceMatcher(None, own, found, autojunk=False).get_matching_blocks() if p.size]
        if not pairs:
            return None
        same = sum(p.size for p in pairs)
        first, last = pairs[0].b, pairs[-1].b + pairs[-1].size
        lacking = [x for i, x in enumerate(own) if not any(p.a <= i < p.a + p.size for p in pairs)]
        added = [x for i, x in enumerate(found[first:last], first) if not any(p.b <= i < p.b + p.size for p in pairs)]
        fits = same >= SHARE * len(own) and len(added) <= (1 - SHARE) * len(own)
        told = any(x.isdigit() or x in self.telling[t] for x in lacking) or any(x.isdigit() for x in added) or any(2 * len(of.intersection(added)) >= len(of) for of in self.foreign[t])
        return (lacking, added, first, last - 1) if fits and not told else None


@lru_cache(4)
def scanner(templates: tuple[tuple[str, str], ...]) -> Scanner:
    import zstandard

    w = words(pa.array([t.encode() for _, t in templates], pa.large_binary()))
    wordings = [w.bytes_of(a, b - a) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    telling, foreign = [], []
    for own in wordings:
        siblings = [o for o in wordings if o is not own and SequenceMatcher(None, own, o, autojunk=False).ratio() >= SIBLING]
        telling.append({x for x in own if sum(x in o for o in wordings) == 1} if len(own) <= SHORT else {x for x in own if any(x not in o for o in siblings)})
        foreign.append([beyond for o in siblings if (beyond := set(o) - set(own))])
    rows = []
    for t, own in enumerate(wordings):
        needed = len(own) - ceil(SHARE * len(own)) + 1
        chosen = sorted(range(len(own)), key=lambda i, own=own: (-len(own[i]), i))[:needed]
        rows += [(int(w.hash[w.first[t] + i]), t, i) for i in chosen]
    rows.sort()
    raw = [zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, text in templates]
    alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
    with_template = [zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False) for d in raw]
    vocabulary = np.unique(w.hash)
    has = np.zeros((len(wordings), len(vocabulary) + 1), bool)
    for t in range(len(wordings)):
        has[t, np.searchsorted(vocabulary, w.hash[w.first[t] : w.first[t + 1]])] = True
    return Scanner([n for n, _ in templates], wordings, telling, foreign, np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), alone, with_template, [Counter(x) for x in wordings], vocabulary, has)


def license_scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, keep_text: bool = True, openings: tuple[str, ...] = OPENINGS) -> DataFrame:
    """docs with licenses (name, first and last matched word, bytes saved, lacking and added words; in text order), n_blocks (candidates) and license, the first of them with least differences.

    Null and wordless texts have none; a template is compared whole, wherever it stands and however long the text is;
    of overlapping matches of one template the one of least differences stays, of equal ones the first; one of openings goes
    where a match of another template covers it;
    templates must have words; repeated rows are scanned each; an empty table gives no rows.
    """
    fixed = tuple(templates.items())

    def scan(texts: pa.Array, _: pa.RecordBatch) -> list:
        s, w = scanner(fixed), words(texts)
        found: list[list[dict]] = [[] for _ in range(len(texts))]
        blocks = np.zeros(len(texts), np.int64)
        for text, a, b in s.candidates(w):
            blocks[text] += 1
            block = w.data[w.start[a] : w.end[b - 1]].tobytes()
            here = w.bytes_of(a, b - a)
            for saved, t in s.savings(block):
                if saved > 0 and (d := s.differences(here, -t)) is not None:
                    lacking, added = (" ".join(x.decode("utf-8", "replace") for x in side) for side in d[:2])
                    found[text].append({"name": s.names[-t], "first": a + d[2] - int(w.first[text]), "last": a + d[3] - int(w.first[text]), "saved": saved, "lacking": lacking, "added": added, "n": len(d[0]) + len(d[1])})
                    break
        best = []
        for rows in found:
            rows.sort(key=lambda r: (r["n"], r["first"], r["last"], r["name"]))
            kept: list[dict] = []
            taken: dict[str, list[tuple[int, int]]] = {}  # disjoint spans of each template, in order
            for r in rows:
                spans = taken.setdefault(r["name"], [])
                at = bisect(spans, (r["last"], r["last"]))
                if not (at and spans[at - 1][1] >= r["first"]):
                    spans.insert(at, (r["first"], r["last"]))
                    kept.append(r)
            whole = sorted((r["first"], r["last"]) for r in kept if r["name"] not in openings)
            ends = list(accumulate((b for _, b in whole), max))  # the furthest end of those that begin no later
            kept = [r for r in kept if r["name"] not in openings or not (at := bisect(whole, (r["first"], inf))) or ends[at - 1] < r["last"]]
            best.append(kept[0]["name"] if kept else None)
            rows[:] = sorted(({k: v for k, v in r.items() if k != "n"} for r in kept), key=lambda r: (r["first"], r["last"], r["name"]))
        return [found, blocks, best]

    return map_texts(docs, scan, "licenses array<struct<name:string,first:long,last:long,saved:long,lacking:string,added:string>>, n_blocks long, license string", keep_text=keep_text)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """exact: a notice stands word for word that is given whole in TEMPLATES; openings only name the license or one that shares them."""
    from lodestone.llm.common import table

    found = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    names = F.array_join(F.array_distinct(F.transform("licenses", lambda x: x["name"])), ",")
    exact = F.exists("licenses", lambda x: (x["lacking"] == "") & (x["added"] == "") & ~x["name"].isin(*OPENINGS))
    return found.select("doc_id", "license", F.size("licenses").cast("long").alias("n_licenses"), names.alias("names"), "n_blocks", exact.alias("exact"))
