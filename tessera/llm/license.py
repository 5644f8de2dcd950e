"""License scans by template-markup matching.

A template is wording with two kinds of markup:

    <<beginOptional>> ... <<endOptional>>      may be left out; may be nested
    <<var;name="who";match="a|b c">>           one of the wordings named
    <<var;name="who";words="0-12">>            so many words of any kind

It is compiled into an automaton over words. A document has the template's label if some stretch of its words is
accepted, that is if all mandatory wording stands there exactly. Templates are tried only where all words that no
accepted text lacks are present. Words: A-Z lowered, runs of letters, digits and characters beyond ASCII, so
punctuation, case and line breaks play no part.

Beside that, base phrases are counted at all their places. The score is 1 if a template accepts, 0.5 if only a base
phrase stands there, else 0. Null and empty texts have no words, no labels and score 0; repeated rows are scanned each;
other columns are not read. One pass, no exchange; memory holds one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tune, utf8
from tessera.llm.words import alnum, alnum_text

#: The phrases that the contract names and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_GRANT = '<<var;name="grant";match="licensed|released|distributed|available|published|provided">> under'
#: Notices and wordings of public licences, with markup.
TEMPLATES = {
    "apache-2.0": f"{_GRANT} <<beginOptional>>the terms of<<endOptional>> the Apache License <<beginOptional>>Version<<endOptional>> 2.0",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name=\"place\";words=\"0-12\">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-notice": f'{_GRANT} <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>the<<endOptional>> <<beginOptional>><<var;name="clauses";match="2 clause|3 clause|two clause|three clause|new|simplified|modified">><<endOptional>> BSD <<var;name="noun";match="license|licence">>',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <<var;name="holder";words="0-12">> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";words="0-12">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="owner";words="0-12">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var;name="holder";words="0-12">> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";words="0-12">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc-by": f'{_GRANT} <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> CC BY <<beginOptional>><<var;name="terms";match="nc|sa|nd|nc sa|nc nd">><<endOptional>> <<var;name="version";match="1.0|2.0|2.5|3.0|4.0">>',
    "cc0": f"{_GRANT} <<beginOptional>>the<<endOptional>> <<var;name=\"name\";match=\"cc0|cc0 1.0|creative commons zero\">>",
    "gpl-notice": f'{_GRANT} <<beginOptional>>the terms of<<endOptional>> the GNU <<beginOptional>><<var;name="kind";match="lesser|affero|library">><<endOptional>> General Public License <<var;name="version";match="version 1|version 2|version 2.1|version 3|v2|v3">>',
    "gpl-header": 'is free software<<beginOptional>>;<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU <<beginOptional>><<var;name="kind";match="lesser|affero|library">><<endOptional>> General Public License as published by the Free Software Foundation<<beginOptional>>;<<endOptional>> either version <<var;name="version";match="1|2|2.1|3">> of the License, or (at your option) any later version. <<var;name="work";words="0-6">> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<beginOptional>><<var;name="kind";match="lesser|affero|library">><<endOptional>> General Public License for more details.',
    "zlib": 'This software is provided as is, without any express or implied warranty. In no event <<var;name="verb";match="will|shall">> the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution.',
    "isc": 'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND <<var;name="holder";words="0-12">> <<var;name="verb";match="disclaims|disclaim">> ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name="holder";words="0-12">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-notice": f"{_GRANT} <<beginOptional>>the terms of<<endOptional>> the MIT License",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";words="0-12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var((?:;\w+=\"[^\"]*\")*))>>")


@dataclass
class Automaton:
    """Word edges, edges for any word and edges for no word, by state; state 0 begins, `accept` ends."""

    words: list[dict[bytes, set[int]]] = field(default_factory=list)
    any: list[set[int]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    accept: int = 0
    required: frozenset[bytes] = frozenset()

    def state(self) -> int:
        self.words.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.words) - 1

    def follow(self, at: int, words: list[bytes]) -> int:
        for w in words:
            after = self.state()
            self.words[at].setdefault(w, set()).add(after)
            at = after
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = [*states], set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return seen

    def match(self, words: list[bytes], at: int = 0) -> int | None:
        """The end of the longest accepted stretch that begins at a position, if there is one."""
        now, best = self.closure({0}), None
        for i in range(at, len(words) + 1):
            if self.accept in now:
                best = i
            if not now or i == len(words):
                break
            now = self.closure({t for s in now for t in self.words[s].get(words[i], ())} | {t for s in now for t in self.any[s]})
        return best

    def find(self, words: list[bytes]) -> tuple[int, int] | None:
        """The first accepted stretch that isn't empty."""
        begin = self.closure({0})
        first = {w for s in begin for w in self.words[s]}
        free = any(self.any[s] for s in begin)
        for i, w in enumerate(words):
            if (free or w in first) and (end := self.match(words, i)) is not None and end > i:
                return i, end
        return None


def compile_template(text: str) -> Automaton:
    """ValueError if the markup isn't well formed."""
    out = Automaton()
    at, open_, required, last = out.state(), [], set(), 0

    def wording(part: str) -> None:
        nonlocal at
        words = alnum(part.encode())
        at = out.follow(at, words)
        if not open_:
            required.update(words)

    for m in _MARK.finditer(text):
        wording(text[last : m.start()])
        last = m.end()
        if m[1] == "beginOptional":
            open_.append(at)
        elif m[1] == "endOptional":
            if not open_:
                raise ValueError("an optional region ends that did not begin")
            after = out.state()
            out.free[at].add(after)
            out.free[open_.pop()].add(after)
            at = after
        else:
            given = dict(re.findall(r';(\w+)="([^"]*)"', m[2]))
            after = out.state()
            if "words" in given:
                least, most = map(int, given["words"].split("-"))
                for i in range(most):
                    if i >= least:
                        out.free[at].add(after)
                    step = out.state()
                    out.any[at].add(step)
                    at = step
                out.free[at].add(after)
            elif "match" in given:
                for wordings in given["match"].split("|"):
                    out.free[out.follow(at, alnum(wordings.encode()))].add(after)
            else:
                raise ValueError("a replaceable region needs words or match")
            at = after
    wording(text[last:])
    if open_:
        raise ValueError("an optional region has no end")
    if "<<" in _MARK.sub("", text):
        raise ValueError("unknown markup")
    out.accept, out.required = at, frozenset(required)
    return out


def base_places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> list[tuple[int, str]]:
    """Start and label of each place where a phrase's words stand consecutively."""
    out = []
    for phrase, label in phrases.items():
        n, at = len(phrase), -1
        try:
            while True:
                at = words.index(phrase[-1], at + 1)
                if at + 1 >= n and tuple(words[at + 1 - n : at + 1]) == phrase:
                    out.append((at + 1 - n, label))
        except ValueError:
            pass
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    and places, the stretch (label, from, to) that each template accepts first."""
    tune(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    for t in templates.values():
        compile_template(t)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,begin:int,end:int>>"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        base = {tuple(alnum(p.encode())): label for p, label in phrases.items()}
        base = {p: label for p, label in base.items() if p}
        automata = {name: compile_template(t) for name, t in templates.items()}
        probes = {name: max(a.required, key=len, default=b"") for name, a in automata.items()}
        kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))]
        for b in batches:
            out = []
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = alnum_text(t.as_py())
                words = text.split()
                places = base_places(words, base)
                own = []
                if likely := [name for name, probe in probes.items() if probe in text]:
                    there = set(words)
                    own = [(name, *hit) for name in likely if automata[name].required <= there and (hit := automata[name].find(words))]
                labels = {x for _, x in places}
                starts = [i for i, _ in places]
                score = 1.0 if own else 0.5 if places else 0.0
                out.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels.union(x[0] for x in own))), score, [dict(zip(("label", "begin", "end"), x, strict=True)) for x in own]))
            columns = [*zip(*out, strict=True)] if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text")).mapInArrow(run, schema)
