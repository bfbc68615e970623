"""License scans by template markup.

A template is license wording with markup: ``<<o>> ... <</o>>`` is optional,
``<<any:n>>`` stands for one to n replaceable words.  It compiles into an
automaton over word tokens; a text is accepted where its words pass through all
mandatory wording exactly.  Automata start only at words that can begin them.

Whole licenses and notices are accepted with all their mandatory wording only;
references name a license, and its version, in a few words.  The General Public
License, its lesser and its Affero form are three licenses.

Edge cases: null and empty texts have no words, no places and score 0; places
may overlap and repeat, each counts; repeated rows are scanned each; only the
two named columns are read, so others can't clash.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, steps

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# The licenses of the GNU project, by label: name and version.
GNU = {
    "gpl-2.0": ("general public license", "2"), "gpl-3.0": ("general public license", "3"), "lgpl-2.1": ("lesser general public license", "2 1"), "lgpl-3.0": ("lesser general public license", "3"),
    "agpl-3.0": ("affero general public license", "3"),
}
# References to licenses and their labels.
REFERENCES = {
    "mit": ["released under <<o>>the terms of<</o>> the mit license", "licensed under <<o>>the terms of<</o>> the mit license"],
    "apache-2.0": ["apache license version 2 0", "apache license 2 0"],
    **{label: [f"gnu {name} <<o>>as published by the free software foundation<</o>> <<o>>either<</o>> version {version}"] for label, (name, version) in GNU.items()},
    "mpl-2.0": ["mozilla public license <<o>>version<</o>> <<o>>v<</o>> 2 0"],
    "cc-by-sa-4.0": ["cc by sa 4 0", *(f"creative commons attribution {alike} 4 0 <<o>>international<</o>> <<o>>public<</o>> license" for alike in ("sharealike", "share alike"))],
    "cc-by-nc-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 <<o>>international<</o>> <<o>>public<</o>> license"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution 4 0 <<o>>international<</o>> <<o>>public<</o>> license"],
    "copyright": ["copyright <<o>>c<</o>> <<any:6>> all rights reserved"],
}
# The wording of whole licenses and notices, as published.
MIT_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
<<o>>OR COPYRIGHT HOLDERS<</o>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT = """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<o>>(including the next paragraph)<</o>> shall be included in all
copies or substantial portions of the Software."""
ISC = """
Permission to use, copy, modify, and<<o>>/or<</o>> distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND <<any:6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<any:6>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD_START = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
<<o>>1.<</o>> Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer.
<<o>>2.<</o>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_NAMES = """
<<o>>3.<</o>> Neither the name of <<any:10>> nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY <<any:8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any:8>>
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions:
<<o>>1.<</o>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required.
<<o>>2.<</o>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.
<<o>>3.<</o>> This notice may not be removed or altered from any source distribution."""
UNLICENSE = """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
APACHE_NOTICE = """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at <<o>>http<</o>> <<o>>https<</o>>://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
GNU_NOTICE = """
This {noun} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {noun}
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."""
MPL_NOTICE = """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at <<o>>http<</o>> <<o>>https<</o>>://mozilla.org/MPL/2.0/"""
CC_BY_SA_NOTICE = """
This work is licensed under <<o>>a<</o>> <<o>>the<</o>> Creative Commons Attribution-ShareAlike 4.0 International License.
To view a copy of this license, visit <<o>>http<</o>> <<o>>https<</o>>://creativecommons.org/licenses/by-sa/4.0/"""
WHOLE = {
    "mit": MIT + MIT_WARRANTY,
    "isc": ISC,
    "bsd-2-clause": BSD_START + BSD_WARRANTY,
    "bsd-3-clause": BSD_START + BSD_NAMES + BSD_WARRANTY,
    "zlib": ZLIB,
    "unlicense": UNLICENSE + MIT_WARRANTY,
    "apache-2.0-notice": APACHE_NOTICE,
    **{f"{label}-or-later-notice": GNU_NOTICE.format(noun="library" if label == "lgpl-2.1" else "program", name=name, version=version) for label, (name, version) in GNU.items()},
    "mpl-2.0-notice": MPL_NOTICE,
    "cc-by-sa-4.0-notice": CC_BY_SA_NOTICE,
}
MARKUP = re.compile(r"<<o>>|<</o>>|<<any:\d+>>|[a-z0-9]+")


class Automaton:
    """States are positions in a template's parts; ``match`` gives the longest accepted end, or 0."""

    def __init__(self, template: str):
        parts = MARKUP.findall(template.lower())
        self.parts, self.skip, opened = parts, {}, []
        for k, p in enumerate(parts):
            if p == "<<o>>":
                opened.append(k)
            elif p == "<</o>>":
                self.skip[opened.pop()] = k + 1
        self.start = {parts[s] for s, _ in self._closed({(0, 0)}) if s < len(parts)}
        #: The words that can be second; none if any can, or if one word is enough.
        then = self._closed({(s + 1, 0) for s, _ in self._closed({(0, 0)}) if s < len(parts)})
        some = {parts[s] if s < len(parts) else "<<" for s, _ in then}
        self.second = None if any(w.startswith("<<") for w in some) else {w.encode() for w in some}

    def _closed(self, states: set[tuple[int, int]]) -> set[tuple[int, int]]:
        """With what is reached without a word; a state is a part and the replaceable words it has had."""
        todo, out = list(states), set()
        while todo:
            s, used = todo.pop()
            if (s, used) in out:
                continue
            part = self.parts[s] if s < len(self.parts) else ""
            if part == "<<o>>":
                todo += [(s + 1, 0), (self.skip[s], 0)]
            elif part == "<</o>>":
                todo.append((s + 1, 0))
            else:
                out.add((s, used))
                if part.startswith("<<any") and used:
                    todo.append((s + 1, 0))
        return out

    def match(self, words: list[str], at: int) -> int:
        states, best, k = self._closed({(0, 0)}), 0, at
        while states and k < len(words):
            word, after = words[k], set()
            for s, used in states:
                if s == len(self.parts):
                    continue
                part = self.parts[s]
                if part.startswith("<<any"):
                    if used < int(part[6:-2]):
                        after.add((s, used + 1))
                elif part == word:
                    after.add((s + 1, 0))
            states = self._closed(after)
            k += 1
            if any(s == len(self.parts) for s, _ in states):
                best = k
        return best


@cache
def compiled() -> dict[bytes, list[tuple[Automaton, str, bool]]]:
    """Automata by first word; the flag marks base phrases."""
    out: dict[bytes, list[tuple[Automaton, str, bool]]] = {}
    made = [(p, label, True) for p, label in BASE.items()]
    made += [(t, label, False) for label, ts in REFERENCES.items() for t in ts]
    made += [(t, label, False) for label, t in WHOLE.items()]
    for text, label, base in made:
        found = Automaton(text)
        for word in found.start:
            out.setdefault(word.encode(), []).append((found, label, base))
    return out


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score): score is the share of words inside a place."""
    raw = WORD.findall(text.translate(LOWER))
    starts = compiled()
    at = [k for k, w in enumerate(raw) if w in starts]
    if not at:
        return len(raw), 0, None, None, "", "", 0.0
    words = [w.decode(errors="replace") for w in raw]
    base, labels, inside, places = set(), set(), set(), []
    for k in at:
        after = raw[k + 1] if k + 1 < len(raw) else b""
        for automaton, label, is_base in starts[raw[k]]:
            if automaton.second is not None and after not in automaton.second:
                continue
            if end := automaton.match(words, k):
                labels.add(label)
                inside.update(range(k, end))
                if is_base:
                    base.add(label)
                    places.append(k)
    return len(raw), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), len(inside) / len(raw)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row."""
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]

    def run(batches):
        for b in steps(batches):
            cols = zip(*(scan((x or "").encode()) for x in b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
