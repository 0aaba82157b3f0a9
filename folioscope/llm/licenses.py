"""License scans by a positional rare-token index.

The index has a template's words with their places, for templates of two kinds: base phrases, which count wherever their words
stand consecutively, and passages and whole texts of well-known licences, which may be worded a little differently. Inverse
document frequencies of all template words come from one pass over the whole corpus. A file's licence words are looked up in the
order of these frequencies, the rarest first, until each template that the file may hold (it has all words of the template's key
phrase) has its anchors: the rarest of its words in this file. Their places, less their places in the template, give where it
could start; a start stays if the anchors agree on it (for passages: AGREE of their places, SLACK words off at most). There a base
phrase is verified word by word, and a passage by its mandatory key phrase, which must stand near its place, and its coverage, the
share of the passage's words that stand where they should. A passage has as many anchors that one with enough coverage can't be
missed, whichever of its words are changed.

Nulls count as empty texts: no words, no labels. Repeated rows each give a row; an empty table gives none (and all
frequencies zero, ties in rarity going to the earlier word of the template).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import doc_slices, id_and_text

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Passages of public licences (label, passage, mandatory key phrase).
PASSAGES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license", "attribution sharealike"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights", "waived all copyright"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors"
_LIABLE = "be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_BSD_3 = "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
_BSD_END = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
    "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
#: Whole texts of public licences, and the notices that whole licences ask for (label, words, mandatory key phrase).
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software " + _AS_IS + " or copyright holders " + _LIABLE, "deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software", "the author disclaims all warranties"),
    ("bsd-2", _BSD + _BSD_END, "redistributions in binary form must reproduce"),
    ("bsd-3", _BSD + _BSD_3 + _BSD_END, "neither the name of the copyright holder"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution", "origin of this software must not be misrepresented"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license", "except in compliance with the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses", "either version 3 of the license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "either version 2 of the license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _AS_IS + " " + _LIABLE, "dedicate any and all copyright interest"),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software "
        "and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following", "use reproduce display distribute execute"),
)
#: Looked-up places of a passage that must agree on a start, how far its words may have moved, and the least share in place.
AGREE, SLACK, LEAST_COVERAGE = 2, 2, 0.6

_WORD = bytes(c for c in range(256) if c >= 128 or chr(c).isalnum())
#: A-Z to lower case, all bytes that belong to no word to spaces.
_table = bytes((c + 32 if 65 <= c <= 90 else c) if c in _WORD else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_table).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    key: list[bytes]  # what a text must hold
    base: bool


class Index:
    """Postings (template, places) of each template word, and the words' order by inverse document frequency, highest first."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int, base: dict[str, str] = BASE, passages=(*PASSAGES, *TEXTS)):
        self.templates = [Template(label, words_of(p), words_of(p), True) for p, label in base.items()]
        self.templates += [Template(label, words_of(p), words_of(k), False) for label, p, k in passages]
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = {}
        for n, t in enumerate(self.templates):
            for w in dict.fromkeys(t.words):
                self.postings.setdefault(w, []).append((n, [i for i, x in enumerate(t.words) if x == w]))
        idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) for w in self.postings}
        self.order = {w: i for i, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.keys = [frozenset(t.key) for t in self.templates]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, str, float]]]:
        """(base places with labels, in order; passages' places with labels and coverage)."""
        present = self.order.keys() & words
        possible = {n for n, key in enumerate(self.keys) if key <= present}
        if not possible:
            return [], []
        # a passage that is there has LEAST_COVERAGE of its words in place, so of one place more than may be wrong one is right
        wrong = {n: math.floor(len(self.templates[n].words) * (1 - LEAST_COVERAGE) + 1e-9) for n in possible}
        absent = {n: sum(w not in present for w in self.templates[n].words) for n in possible}
        possible = {n for n in possible if absent[n] <= wrong[n]}
        wanted = {n: 2 if self.templates[n].base else wrong[n] - absent[n] + AGREE for n in possible}
        anchors: dict[int, list[tuple[bytes, list[int]]]] = {n: [] for n in possible}
        held = dict.fromkeys(possible, 0)
        for w in sorted(present, key=self.order.__getitem__):  # the file's licence words, the rarest first
            for n, places in self.postings[w]:
                if n in possible and held[n] < wanted[n]:
                    anchors[n].append((w, places))
                    held[n] += 1 if self.templates[n].base else len(places)
        where: dict[bytes, list[int]] = {w: [] for own in anchors.values() for w, _ in own}
        for i, w in enumerate(words):
            if w in where:
                where[w].append(i)
        base, found = [], []
        for n in sorted(possible):
            t = self.templates[n]
            if t.base:
                starts = [{i - p for i in where[w] for p in places} for w, places in anchors[n]]
                base += [(s, t.label) for s in set.intersection(*starts) if s >= 0 and words[s : s + len(t.words)] == t.words]
                continue
            votes: dict[int, int] = {}
            for w, places in anchors[n]:
                for p in places:
                    for s in {i - p + d for i in where[w] for d in range(-SLACK, SLACK + 1)}:
                        votes[s] = votes.get(s, 0) + 1
            fits = [(s, c) for s in sorted(s for s, v in votes.items() if v >= AGREE) if self._key_near(words, t, s) and (c := self._coverage(words, t, s)) >= LEAST_COVERAGE]
            done, close = -len(t.words), []  # close: starts that the same passage may have given
            for s, c in [*fits, (None, 0.0)]:
                if close and (s is None or s - close[0][0] > 2 * SLACK):
                    best = max(close, key=lambda x: (self._in_place(words, t, x[0]), -x[0]))
                    close = []
                    if best[0] - done >= len(t.words):
                        found.append((max(best[0], 0), t.label, best[1]))
                        done = best[0]
                if s is not None:
                    close.append((s, c))
        return sorted(base), sorted(found)

    @staticmethod
    def _in_place(words: list[bytes], t: Template, start: int) -> int:
        return sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words))

    @staticmethod
    def _key_near(words: list[bytes], t: Template, start: int) -> bool:
        part = words[max(0, start - SLACK) : start + len(t.words) + SLACK]
        return any(part[i : i + len(t.key)] == t.key for i in range(len(part) - len(t.key) + 1))

    @staticmethod
    def _coverage(words: list[bytes], t: Template, start: int) -> float:
        hit = sum(w in words[max(0, start + i - SLACK) : max(0, start + i + SLACK + 1)] for i, w in enumerate(t.words))
        return hit / len(t.words)


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the (small) vocabulary occurs, and the number of documents: all are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = dict.fromkeys(sorted(vocabulary), 0), 0
        for _, texts in doc_slices(batches):
            n += len(texts)
            for t in texts:
                for w in vocabulary.intersection(words_of(t)):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([*counts, b""], pa.binary()), pa.array([*counts.values(), n], pa.int64())], ["word", "n"])

    rows = id_and_text(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, passages) of docs(doc_id, text)."""
    vocabulary = frozenset(w for p in [*BASE, *(p for _, p, _ in (*PASSAGES, *TEXTS))] for w in words_of(p))
    frequency, n_docs = document_frequencies(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequency, n_docs)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("coverage", pa.float64())]))
        for ids, texts in doc_slices(batches):
            split = [words_of(t) for t in texts]
            rows = [index.scan(w) for w in split]
            own = [sorted({x[1] for x in base}) for base, _ in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids,
                    "n_words": pa.array([len(w) for w in split], pa.int64()),
                    "n_base": pa.array([len(base) for base, _ in rows], pa.int64()),
                    "first_word": pa.array([base[0][0] if base else None for base, _ in rows], pa.int64()),
                    "last_word": pa.array([base[-1][0] if base else None for base, _ in rows], pa.int64()),
                    "base_labels": pa.array([",".join(x) for x in own], pa.string()),
                    "labels": pa.array([",".join(sorted({*x, *(p[1] for p in found)})) for x, (_, found) in zip(own, rows)], pa.string()),
                    "score": pa.array([1.0 if base else max((p[2] for p in found), default=0.0) for base, found in rows], pa.float64()),
                    "passages": pa.array([[{"start": s, "label": n, "coverage": c} for s, n, c in found] for _, found in rows], kind),
                }
            )

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, passages array<struct<start:long,label:string,coverage:double>>")
