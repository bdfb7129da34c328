"""License scan by a positional index of rare words.

Templates are word sequences, sentences or whole licences, with a label and
mandatory key phrases. The document frequency of every template word is counted
over all documents (the result has at most as many rows as the templates have
words), which gives the words' IDF.

A template is found where words with ``min_coverage`` of its IDF weight, and
its key phrase, stand at one relative position. So of its rarest words, those
that together weigh more than the rest of 1 - min_coverage, one must stand
there: only their postings (template, position) are in the index. A file takes
its licence words by falling IDF; every place of one says at which positions
templates may begin. The weights of the rare words that meet at one position
are summed, which intersects their postings; a position that the others can't
bring to min_coverage any more drops out, and the key phrase and all words of
the template are verified at those left. No template that is there is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import id_and_text, map_columns, utf8

#: Bytes that are no part of a word, after A-Z were lower-cased, become blanks.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: Share of a template's words that has to be found at one relative position.
MIN_COVERAGE = 0.75
#: For sums of weights in different orders.
SLACK = 1e-6

# Base phrases and their labels.
BASE_PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Opening or key sentences of public licences; label, template text, mandatory key phrase.
TEMPLATES = [
    ("agpl-3", "gnu affero general public license version 3", "gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc0", "creative commons zero v1 0 universal public domain dedication", "creative commons zero"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
]


# Whole texts of short public licences, without their copyright lines.
WHOLE = [
    ("mit", "permission is hereby granted free of charge", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", "permission to use copy modify", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2", "source and binary forms", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("unlicense", "unencumbered software", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""),
    ("zlib", "altered source versions must be plainly marked", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
]


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key_at: int  # where the key phrase stands in the words
    key: tuple[bytes, ...]
    base: bool
    least: float  # the share of the weight that has to stand at one position


def templates(base=None, more=None, min_coverage: float = MIN_COVERAGE) -> list[Template]:
    out = []
    rows = [(label, p, p, True) for p, label in (BASE_PHRASES if base is None else base)]
    rows += [(*t, False) for t in ([*TEMPLATES, *((label, text, key) for label, key, text in WHOLE)] if more is None else more)]
    for label, text, key, is_base in rows:
        w, k = tuple(words_of(text)), tuple(words_of(key))
        at = next((i for i in range(len(w) - len(k) + 1) if w[i : i + len(k)] == k), None)
        if at is None or not k:
            raise ValueError(f"the key phrase of {label!r} is not in its template")
        out.append(Template(label, w, at, k, is_base, 1.0 if is_base else min_coverage))
    return out


def document_frequency(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary stands, and how many documents there are. ``docs``: text."""

    def make():
        sums: Counter = Counter()

        def count(texts):
            sums[None] += len(texts)
            for t in texts:
                sums.update(vocabulary.intersection(words_of(t)))

        count.finish = lambda: [{"word": [None if w is None else w.decode() for w in sums], "n": list(sums.values())}]
        return count

    schema = StructType([StructField("word", StringType()), StructField("n", LongType())])
    found = {r.word: r.n for r in map_columns(docs.select("text"), schema, make).groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w.encode(): n for w, n in found.items() if w is not None}, found.get(None, 0)


class Index:
    """Postings of rare words: word -> (template, position)."""

    def __init__(self, listed: list[Template], frequency: dict[bytes, int], documents: int):
        self.templates = listed
        self.idf = {w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1e-9 for t in listed for w in t.words}
        self.weight = [sum(self.idf[w] for w in t.words) for t in listed]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.needed: list[float] = []  # of each template's rare words' weight what has to be met at a position
        for k, t in enumerate(listed):
            spare, rare = (1 - t.least) * self.weight[k], 0.0
            # the rarest positions first, the first of equals; past the spare weight one of them must be met
            for i in sorted(range(len(t.words)), key=lambda i: (-self.idf[t.words[i]], i)):
                self.postings.setdefault(t.words[i], []).append((k, i))
                rare += self.idf[t.words[i]]
                if rare > spare + SLACK:
                    break
            self.needed.append(rare - spare - SLACK)
        self.rare = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, place of the key phrase, coverage) of every verified place."""
        present = self.rare.intersection(words)
        if not present:
            return []
        places: dict[bytes, list[int]] = {w: [] for w in present}
        for i, w in enumerate(words):
            if w in present:
                places[w].append(i)
        met: dict[tuple[int, int], float] = {}
        for w in sorted(present, key=lambda w: (-self.idf[w], w)):
            idf = self.idf[w]
            for k, j in self.postings[w]:
                for p in places[w]:
                    met[k, p - j] = met.get((k, p - j), 0.0) + idf
        found = []
        for (k, start), weight in met.items():
            t = self.templates[k]
            at = start + t.key_at
            if weight < self.needed[k] or at < 0 or tuple(words[at : at + len(t.key)]) != t.key:
                continue
            hit = sum(self.idf[x] for i, x in enumerate(t.words) if 0 <= start + i < len(words) and words[start + i] == x)
            if hit >= t.least * self.weight[k] - SLACK:
                found.append((k, at, min(1.0, hit / self.weight[k])))
        return found


def scan_licenses(docs: DataFrame, base=None, more=None, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Base phrases count wherever their words stand consecutively. A template's
    label is added where its key phrase stands and words with at least
    ``min_coverage`` of the template's IDF weight stand at the same relative
    position. The score is the highest coverage (1 for a base phrase, 0 without
    any place); spans lists ``label:word`` of all places. A null or empty text
    has no words and empty labels. Null ids and repeated rows pass through;
    other columns are ignored; an empty table gives an empty result.
    """
    docs = id_and_text(docs, id_col, text_col)
    listed = templates(base, more, min_coverage)
    frequency, documents = document_frequency(docs, {w for t in listed for w in t.words})
    kinds = {"n_words": LongType(), "n_base": LongType(), "first_word": LongType(), "last_word": LongType(), "base_labels": StringType(), "labels": StringType(), "score": DoubleType(), "spans": StringType()}
    schema = StructType([docs.schema["doc_id"], *(StructField(c, k) for c, k in kinds.items())])

    def make():
        index = Index(listed, frequency, documents)

        def scan(ids, texts):
            out: dict[str, list] = {c: [] for c in kinds}
            for t in texts:
                words = words_of(t)
                places = index.scan(words)
                own = [x for x in places if listed[x[0]].base]
                row = (
                    len(words), len(own), min((at for _, at, _ in own), default=None), max((at for _, at, _ in own), default=None),
                    ",".join(sorted({listed[k].label for k, _, _ in own})), ",".join(sorted({listed[k].label for k, _, _ in places})),
                    min(1.0, max((s for _, _, s in places), default=0.0)), ",".join(f"{listed[k].label}:{at}" for k, at, _ in sorted(places, key=lambda x: (x[1], x[0]))),
                )
                for c, v in zip(kinds, row):
                    out[c].append(v)
            return {"doc_id": ids, **out}

        return scan

    return map_columns(docs, schema, make)
