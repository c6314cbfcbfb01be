"""License scans: template markup compiled into token automata.

A template is the licence's wording with SPDX markup: <<beginOptional>> ...
<<endOptional>> encloses words that may be missing, <<var;match="REGEX";
max=N>> stands for up to N tokens that each match REGEX. All else is
mandatory and must match token for token; case, punctuation and white space
don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal

TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:;[a-z]+=(?:\"[^\"]*\"|\d+))*)>>")

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=".+";max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_BODY = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=".+";max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=".+";max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """<<beginOptional>>3.<<endOptional>> Neither the name of <<var;match=".+";max=8>> nor the names of <<beginOptional>>its <<endOptional>>contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var;match=".+";max=8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;match=".+";max=8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_TERMS = "under <<beginOptional>>the <<endOptional>><<beginOptional>>terms <<beginOptional>>and conditions <<endOptional>>of the <<endOptional>>"
_VERSION = '<<var;match="[0-9.]+";max=1>>'
_CC = {"CC-BY": "Attribution", "CC-BY-SA": "Attribution-ShareAlike", "CC-BY-NC": "Attribution-NonCommercial", "CC-BY-ND": "Attribution-NoDerivatives", "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}

#: Notices, standard headers and short licences; each is also one regular expression of the SQL check.
TEMPLATES: Mapping[str, str] = {
    "MIT-notice": f"{_TERMS}MIT License",
    "MIT": _MIT_BODY,
    "ISC": _ISC_BODY,
    "ISC-notice": f"{_TERMS}ISC License",
    "BSD-2-Clause": f"{_BSD_HEAD} {_BSD_TAIL}",
    "BSD-3-Clause": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_TAIL}",
    "BSD-notice": 'under <<var;match="(?:the|a)";max=1>> <<beginOptional>><<var;match="(?:[0-9]-clause|new|simplified|modified|revised)";max=1>> <<endOptional>><<var;match="(?:bsd|bsd-style|bsd-[0-9]-clause)";max=1>> <<beginOptional>><<var;match="(?:[0-9]-clause|style)";max=1>> <<endOptional>>License',
    "Apache-2.0-notice": f"{_TERMS}Apache License <<beginOptional>>Version <<endOptional>>2.0",
    "GPL-notice": f"{_TERMS}GNU General Public License",
    "LGPL-notice": f'{_TERMS}GNU <<var;match="(?:lesser|library)";max=1>> General Public License',
    "AGPL-notice": f"{_TERMS}GNU Affero General Public License",
    "MPL-notice": "the Mozilla Public License",
    **{f"{k}-notice": f"{k.replace('CC-', 'CC ')} {_VERSION}" for k in _CC},
    **{f"{k}-name": f"Creative Commons {v} {_VERSION}" for k, v in _CC.items()},
    "all-rights-reserved": "All rights reserved",
}

#: Files of licenses/: the words that the terms begin with, and those that stand behind the terms.
_LONG = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", "END OF TERMS AND CONDITIONS"),
    "GPL-2": ("TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "GPL-3": ("TERMS AND CONDITIONS", "END OF TERMS AND CONDITIONS"),
    "LGPL-2.1": ("TERMS AND CONDITIONS FOR COPYING", "END OF TERMS AND CONDITIONS"),
    "LGPL-3": ("This version of the GNU Lesser", None),
    "MPL-2.0": ("1. Definitions", "Exhibit A - Source"),
    "CC0-1.0": ("Statement of Purpose", None),
    "CC-BY-SA-4.0": ("By exercising the Licensed Rights", "=====\n\nCreative Commons is not a party"),
}
_BULLET = re.compile(r"^(\s*)((?:\d+\.)+\d*|\([a-z0-9]+\)|[a-z][.)])(?=\s)", re.MULTILINE)


def _long(name: str) -> str:
    """Template of a licence's terms, from the first to the last; numbers of their clauses may be missing."""
    text = Path(__file__).with_name("licenses").joinpath(f"{name}.txt").read_text()
    first, behind = _LONG[name]
    a = text.index(first)
    return _BULLET.sub(r"\1<<beginOptional>>\2<<endOptional>>", text[a : text.index(behind, a) if behind else len(text)])


#: Whole terms of long licences, which are beyond the size of a regular expression of the SQL check.
LONG_TEMPLATES: Mapping[str, str] = {name: _long(name) for name in _LONG}
ALL_TEMPLATES: Mapping[str, str] = {**TEMPLATES, **LONG_TEMPLATES}


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


@dataclass(frozen=True)
class Automaton:
    """Token NFA without empty moves; state ``final`` accepts.

    words: state -> word -> next states; kinds: state -> [(token regex, next states)].
    """

    start: tuple[int, ...]
    words: dict[int, dict[str, tuple[int, ...]]]
    kinds: dict[int, list[tuple[re.Pattern, tuple[int, ...]]]]
    final: int

    def longest(self, toks: list[str], at: int) -> int:
        """End of the longest match that starts at a token, or -1."""
        states, end = set(self.start), -1
        while True:
            if self.final in states:
                end = at
            if at >= len(toks) or not states:
                return end
            after: set[int] = set()
            for s in states:
                after.update(self.words.get(s, {}).get(toks[at], ()))
                for pattern, to in self.kinds.get(s, ()):
                    if pattern.fullmatch(toks[at]):
                        after.update(to)
            states, at = after, at + 1


def _parse(template: str) -> list:
    """Nested list of words, ("opt", [...]) and ("var", regex, max)."""
    stack: list[list] = [[]]
    at = 0
    for m in MARK.finditer(template):
        stack[-1] += tokens(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            inner = stack.pop()
            stack[-1].append(("opt", inner))
        else:
            options = dict(re.findall(r";([a-z]+)=\"?([^\";]*)\"?", m[2]))
            stack[-1].append(("var", options.get("match", ".+"), int(options.get("max", 1))))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    stack[-1] += tokens(template[at:])
    return stack[0]


def compile_template(template: str) -> Automaton:
    """A var stands for one to max tokens; an optional region of any content may be missing."""
    eps: dict[int, set[int]] = {}
    words: dict[int, dict[str, set[int]]] = {}
    kinds: dict[int, list[tuple[str, int]]] = {}
    count = 1

    def build(items: list, state: int) -> int:
        nonlocal count
        for item in items:
            if isinstance(item, str):
                words.setdefault(state, {}).setdefault(item, set()).add(count)
                state, count = count, count + 1
            elif item[0] == "opt":
                end = build(item[1], state)
                out, count = count, count + 1
                eps.setdefault(end, set()).add(out)
                eps.setdefault(state, set()).add(out)
                state = out
            else:
                first = state
                for _ in range(item[2]):
                    kinds.setdefault(state, []).append((item[1], count))
                    state, count = count, count + 1
                out, count = count, count + 1
                for s in range(out - item[2], out):
                    eps.setdefault(s, set()).add(out)
                state = out if item[2] else first
        return state

    items = _parse(template)
    if not any(isinstance(i, str) for i in items):
        raise ValueError("a template needs mandatory words")
    final = build(items, 0)

    def closure(states: set[int]) -> tuple[int, ...]:
        seen, todo = set(states), list(states)
        while todo:
            for s in eps.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return tuple(sorted(seen))

    return Automaton(
        closure({0}),
        {s: {w: closure(to) for w, to in by.items()} for s, by in words.items()},
        {s: [(re.compile(p), closure({to})) for p, to in by] for s, by in kinds.items()},
        final,
    )


def anchor(template: str) -> str:
    """The longest mandatory word: a text without it can't match."""
    return max((i for i in _parse(template) if isinstance(i, str)), key=lambda w: (len(w), w))


def to_regex(template: str) -> str:
    """The same language as one regular expression over lower-cased text, for the SQL check."""
    gap = r"(?:[^\pL\pN]+)"

    def render(items: list, more: bool) -> str:
        out = ""
        for k, item in enumerate(items):
            sep = gap if more or k < len(items) - 1 else ""
            if isinstance(item, str):
                out += re.escape(item) + sep
            elif item[0] == "opt":
                # The separator of an optional tail stands before it.
                out += f"(?:{render(item[1], True)})?" if sep else ""
            else:
                one = item[1].replace(r"[^\W_]+", r"[\pL\pN]+").replace(".+", r"[\pL\pN.\-]+")
                out += f"{one}(?:{gap}{one}){{0,{item[2] - 1}}}" + sep
        return out

    items = _parse(template)
    while items and not isinstance(items[-1], str) and items[-1][0] == "opt":
        items = items[:-1]  # a match without it is a match
    while items and not isinstance(items[0], str) and items[0][0] == "opt":
        items = items[1:]
    return rf"(?:^|[^\pL\pN]){render(items, False)}(?:$|[^\pL\pN.\-]|[.\-](?:$|[^\pL\pN]))"


def find(toks: list[str], compiled: Mapping[str, Automaton]) -> Iterator[tuple[str, int, int]]:
    """(template, first token, token after the last): leftmost, longest, not overlapping."""
    for name, a in compiled.items():
        firsts = set().union(*(a.words.get(s, {}) for s in a.start))
        wild = any(a.kinds.get(s) for s in a.start)
        at = 0
        while at < len(toks):
            end = a.longest(toks, at) if wild or toks[at] in firsts else -1
            if end > at:
                yield name, at, end
                at = end
            else:
                at += 1


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict[str, Automaton] = {}
        anchors = {name: anchor(t) for name, t in templates.items()}
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = text.lower()
                near = [name for name in templates if anchors[name] in low]
                compiled |= {name: compile_template(templates[name]) for name in near if name not in compiled}
                here = {name: compiled[name] for name in near}
                out += [(i, *m) for m in find(tokens(text), here)] if here else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["doc_id", "license", "first_token", "end_token"])

    return run


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = ALL_TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, first_token, end_token): every place, anywhere in a text, that a template accepts.

    Matches of one template are leftmost, longest and don't overlap; those of
    different templates may. Null and empty texts have none; a null id stays
    null; a repeated row gives its matches again; other columns are ignored.
    Texts without any template's longest mandatory word are passed over
    before they leave the JVM.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    low = F.lower("text")
    hit = F.lit(False)
    for word in sorted({anchor(t) for t in templates.values()}):
        hit = hit | low.contains(word)
    return rows.where(hit).mapInArrow(frugal(_scan(dict(templates))), "doc_id long, license string, first_token int, end_token int")
