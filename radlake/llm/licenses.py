"""License scans: phrases, and an exact set-similarity join of text blocks with templates.

A block is a run of consecutive words of the whole text, line ends or not, a
quarter longer than the template (RUN), as the set of its words. It matches if it
holds THRESHOLD of the template's words. Tokens are ordered by how often the
corpus holds them, rarest first. A block must then hold one of the first
m - need + 1 tokens of a template of m tokens (prefix filter), at least ``need``
template tokens in all (length filter), and at the first common token enough
must be left on both sides (positional filter); what passes is compared in full. The filters are applied to
stretches around the rare words of a text first, then every run in those that
pass is counted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, texts

#: Phrases and labels of the base (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Templates and their labels: notices in common use, single sentences, and texts without their titles and copyright lines (fixed values); scan() takes others.
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache-text", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("gpl-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit-license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
     "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
     "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
     "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
     "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
     "DEALINGS IN THE SOFTWARE."),
    ("bsd-license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above "
     "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
     "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
     "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
     "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
     "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
     "SUCH DAMAGE."),
    ("apache-long-notice", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-long-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
     "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
     "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("isc-license", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in "
     "all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
     "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
     "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
     "License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
     "PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("boost-text", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
     "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"),
    ("bsl-text", "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work."),
    ("unlicense-text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
     "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]
#: Share of a template's words that a block must hold.
THRESHOLD = 0.8
#: Words of a block, for each word of its template.
RUN = 1.25
#: Words that all templates together may have, as every task holds them.
MOST = 500_000
Templates = list[tuple[str, str]]
#: Bytes that aren't in [^\x00-\x2F\x3A-\x60\x7B-\x7F] become spaces; A-Z become lower case before.
_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def templates(of: Templates = TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words_of(text.encode()))) for label, text in of]


def template_rows(table: DataFrame) -> Templates:
    """Templates of a table (label, text), of MOST words at the most; rows without a label or a word are none."""
    size = table.agg(F.sum(F.size(F.split("text", r"[^\p{Alnum}]+")))).head()[0] or 0
    if size > MOST:
        raise ValueError(f"templates of {size} words, more than {MOST}: scan for some of them at a time")
    return sorted((r.label, r.text) for r in table.select("label", "text").distinct().collect() if r.label is not None and words_of((r.text or "").encode()))


def frequencies(docs: DataFrame, of: Templates = TEMPLATES) -> dict[bytes, int]:
    """How often the corpus holds each template token: one row per such token."""
    wanted = frozenset().union(*(t for _, t in templates(of)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                words = words_of(text)
                if not wanted.isdisjoint(words):
                    counts.update(filter(wanted.__contains__, words))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}


class Matcher:
    """Templates whose threshold a block meets."""

    def __init__(self, frequency: dict[bytes, int], threshold: float = THRESHOLD, of: Templates = TEMPLATES):
        found = templates(of)
        tokens = sorted(frozenset().union(*(t for _, t in found)), key=lambda t: (frequency.get(t, 0), t))
        self.order = {t: k for k, t in enumerate(tokens)}
        self.sets = [(label, frozenset(self.order[t] for t in s), math.ceil(threshold * len(s) - 1e-9)) for label, s in found]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (_, s, need) in enumerate(self.sets):
            for place, token in enumerate(sorted(s)[: len(s) - need + 1]):
                self.prefix.setdefault(token, []).append((k, place))
        self.rare = frozenset(tokens[t] for t in self.prefix)
        self.length = [math.ceil(RUN * len(words_of(text.encode()))) for _, text in of]

    def match(self, words: list[bytes]) -> list[tuple[str, float]]:
        block = sorted({self.order[w] for w in words if w in self.order})
        seen: set[int] = set()
        out = []
        for at, token in enumerate(block):
            for k, place in self.prefix.get(token, ()):
                label, own, need = self.sets[k]
                if k in seen or len(block) < need:
                    continue
                seen.add(k)  # the first common token: none before it is common
                if 1 + min(len(block) - at - 1, len(own) - place - 1) < need:
                    continue
                common = len(own.intersection(block))
                if common >= need:
                    out.append((label, common / len(own)))
        return out

    def runs(self, words: list[bytes]) -> list[tuple[int, str, float]]:
        """(place, label, containment) of the best of each group of overlapping runs that match."""
        out = []
        reach = max(self.length, default=0)
        near = [at for at, w in enumerate(words) if w in self.rare]
        first = 0
        for k, at in enumerate(near):
            if k + 1 < len(near) and near[k + 1] - at < 2 * reach:
                continue
            start, stretch = max(0, near[first] - reach + 1), words[max(0, near[first] - reach + 1) : at + reach]
            first = k + 1
            passed = {label for label, _ in self.match(stretch)}
            for (label, own, need), length in zip(self.sets, self.length):
                if label in passed:
                    places = [(start + n, t) for n, w in enumerate(stretch) if (t := self.order.get(w)) in own]
                    out += [(place, label, most / len(own)) for place, most in best_runs(places, length, need)]
        return sorted(out)


def best_runs(places: list[tuple[int, int]], length: int, need: int) -> Iterator[tuple[int, int]]:
    """(place, distinct tokens) of the first best run of each group of overlapping runs with need tokens."""
    held: Counter[int] = Counter()
    left, best, end = 0, None, -1
    for at, token in places:
        held[token] += 1
        while at - places[left][0] >= length:
            held[places[left][1]] -= 1
            if not held[places[left][1]]:
                del held[places[left][1]]
            left += 1
        if len(held) >= need:
            if best and places[left][0] > end:
                yield best
                best = None
            if not best or len(held) > best[1]:
                best = (places[left][0], len(held))
            end = at
    if best:
        yield best


def scan_text(text: bytes, matcher: Matcher) -> tuple:
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        key, last, blanks = b" " + phrase.encode() + b" ", 0, 0
        at = joined.find(key)
        while at >= 0:
            blanks += joined.count(b" ", last, at)  # from the last place on
            places.append(blanks)
            base.add(label)
            last, at = at, joined.find(key, at + 1)
    found = []
    if not matcher.rare.isdisjoint(words):
        found = matcher.runs(words)
    labels = base | {label for _, label, _ in found}
    score = max([share for _, _, share in found] + [0.5 * bool(places)])
    blocks = [{"block": k, "label": label, "containment": share} for k, label, share in found]
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), float(score), blocks


def scan(docs: DataFrame, threshold: float = THRESHOLD, table: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks per row.

    blocks: number of the first word, template label and containment of every match. score:
    the best containment; 0.5 if only phrases are found, else 0. Null and empty
    texts have no words and no labels (empty strings); repeated rows give
    repeated results; an empty table gives no row; other columns are not read.
    table: templates (label, text) in place of TEMPLATES.
    """
    of = TEMPLATES if table is None else template_rows(table)
    matcher = Matcher(frequencies(docs, of), threshold, of)
    block = pa.struct([("block", pa.int32()), ("label", pa.string()), ("containment", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")], ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(block))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc_id, *scan_text(text, matcher)) for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    sql = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<block:int,label:string,containment:double>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, sql)
