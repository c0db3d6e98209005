"""License scans by a positional index of rare words.

Notices and texts of the known licences are the templates. A template's postings give the places of each of its words that
isn't a function word; a word's rarity is its inverse document frequency over the whole corpus. A template stands at an offset of a file if
enough of its rare-word weight does, word by word at offset plus place (give or take a twentieth of a long template's length, for inserted
words), and if its mandatory phrase stands there, too.

The words are looked up from the rarest on. Any offset with enough weight has one of the rarest words that together weigh more than may be
missing, so the postings of these, laid over the file's places of the same words, give all offsets to consider. The
postings of the other words are intersected with them, from the rarest to the commonest, and an offset goes as soon as more is missing than may be.

The texts are read once: that pass counts words, finds phrases and keeps the places of licence words, and the
document frequencies come from what it wrote.

Defined cases: null text counts as empty; a text without words has zero counts, null places, no labels and score zero;
score is the best agreement of a verified template, at least BASE_SCORE where a base phrase stands; repeated
rows are scanned each (and counted each in the frequencies); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, materialise, table, texts, with_fields

# Fixed phrases of the base, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Fixed templates, notices and then texts: label, mandatory phrase, words.
TEMPLATES = (
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("mit", "mit license", "released under the mit license"),
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "public domain dedication", "creative commons zero public domain dedication"),
    ("reserved", "all rights reserved", "copyright all rights reserved"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("mit", "permission is hereby granted free of charge", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
        particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an
        action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""),
    ("bsd", "redistribution and use in source and binary forms", """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or
        implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"""),
    ("isc", "permission to use copy modify and or distribute this software", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special
        direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"""),
    ("zlib", "provided as is without any express or implied warranty", """this software is provided as is without any express or implied warranty in no event will the authors be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to
        alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote
        the original software altered source versions must be plainly marked as such this notice may not be removed or altered from any source distribution"""),
    ("apache-2.0", "apache license version 2 0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you
        may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing
        permissions and limitations under the license"""),
    ("gpl", "gnu general public license", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without
        any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""),
    ("mpl-2.0", "mozilla public license", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
        can obtain one at http mozilla org mpl 2 0"""),
    ("bsl-1.0", "boost software license", "distributed under the boost software license version 1 0"),
    ("unlicense", "released into the public domain", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""),
)

# Fixed function words, which have no postings.
FUNCTION_WORDS = frozenset("a all and any are as by free in into is of or that the this to with without under use for on be from not no 0 1 2 3 4 v".split())

#: Share of a template's rare-word weight that must agree in position.
AGREE = 0.6
BASE_SCORE = 0.5

#: bytes.translate table: letters in lower case, everything that is no word character to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PHRASES = tuple(dict.fromkeys([*BASE, *(t[1] for t in TEMPLATES)]))
#: Words of each template with their places, without function words.
POSTINGS = tuple([(w, p) for p, w in enumerate(text.split()) if w not in FUNCTION_WORDS] for _, _, text in TEMPLATES)
#: How far a word may stand from its place.
SLACK = tuple(len(text.split()) // 20 for _, _, text in TEMPLATES)
VOCABULARY = tuple(sorted({w for postings in POSTINGS for w, _ in postings}))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase stands; joined: the words with one space before, between and after."""
    out, at, seen, count = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        count += joined.count(b" ", seen, at)
        seen = at
        out.append(count)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


def licence_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, phrases (number, place), and of each licence word its number in found and its place in places, of every row."""
    frame = texts(docs, "doc_id")
    schema = with_fields(frame, ["doc_id"], "n_words bigint, phrases array<struct<p: int, at: bigint>>, found array<int>, places array<bigint>")
    pair = pa.list_(pa.struct([("p", pa.int32()), ("at", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for i, w in enumerate(VOCABULARY)}
        known, phrases = frozenset(number), [(i, p.encode(), frozenset(p.encode().split())) for i, p in enumerate(PHRASES)]
        for batch in batches:
            sizes, hits, found, places = [], [], [], []
            for (raw,) in zip(*columns(batch, "text")):
                own = words(raw)
                sizes.append(len(own))
                rows, have = [], set(own)
                present = known & have
                if present:
                    at = [i for i, w in enumerate(own) if w in present]
                    found.append([number[own[i]] for i in at])
                    places.append(at)
                    if stands := [x for x in phrases if x[2] <= have]:
                        joined = b" " + b" ".join(own) + b" "
                        for i, p, _ in stands:
                            rows += [{"p": i, "at": at} for at in phrase_places(joined, p)]
                else:
                    found.append([])
                    places.append([])
                hits.append(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(hits, pair), pa.array(found, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))],
                names=schema.names,
            )

    return frame.mapInArrow(run, schema)


@dataclass
class Template:
    """A template with its words by falling rarity: number, place and weight of each; the first so many are looked up."""

    label: str
    phrase: int
    size: int
    slack: int
    words: list[tuple[int, int, float]]
    total: float
    looked_up: int


def templates(idf: dict[str, float]) -> list[Template]:
    number, out = {w: i for i, w in enumerate(VOCABULARY)}, []
    for (label, phrase, text), postings, slack in zip(TEMPLATES, POSTINGS, SLACK):
        own = sorted(((number[w], p, idf[w]) for w, p in postings), key=lambda x: (-x[2], x[1]))
        total, weight, n = sum(x[2] for x in own), 0.0, 0
        while n < len(own) and weight <= (1 - AGREE) * total + 1e-9:
            weight, n = weight + own[n][2], n + 1
        out.append(Template(label, PHRASES.index(phrase), len(text.split()), slack, own, total, n))
    return out


def agreement(t: Template, places: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which enough of the template's weight stands, and the share that does. places: of each word's number, ascending."""
    looked = [places[w] - p for w, p, _ in t.words[: t.looked_up] if w in places]
    offsets = np.unique(np.concatenate(looked)) if looked else np.empty(0, np.int64)
    missing = np.zeros(len(offsets))
    for w, p, weight in t.words:
        if not len(offsets):
            break
        if w in places:
            low = np.searchsorted(places[w], offsets + (p - t.slack), "left")
            stands = low < np.searchsorted(places[w], offsets + (p + t.slack), "right")
            missing += np.where(stands, 0.0, weight)
        else:
            missing += weight
        left = missing <= (1 - AGREE) * t.total + 1e-9
        offsets, missing = offsets[left], missing[left]
    return offsets, 1 - missing / t.total


def match(found: list[int], at: list[int], phrases: dict[int, list[int]], known: list[Template]) -> dict[str, float]:
    """Labels of verified templates of one file and their best agreement. phrases: ascending places of each, by number."""
    number, place = np.asarray(found, np.int64), np.asarray(at, np.int64)
    order = np.argsort(number, kind="stable")
    names, starts = np.unique(number[order], return_index=True)
    places = dict(zip(names.tolist(), np.split(place[order], starts[1:])))
    best: dict[str, float] = {}
    for t in known:
        if not phrases.get(t.phrase):
            continue
        offsets, share = agreement(t, places)
        stands = np.asarray(phrases[t.phrase])
        near = np.searchsorted(stands, offsets - 1 - t.slack)
        sure = (near < len(stands)) & (stands[np.minimum(near, len(stands) - 1)] <= offsets + t.size + t.slack)
        if sure.any():
            best[t.label] = max(best.get(t.label, 0.0), float(share[sure].max()))
    return best


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    rows = materialise(licence_words(docs), "licence-words")
    # one row at most for each word of the templates
    df = rows.select(F.explode(F.array_distinct("found")).alias("w")).groupBy("w").count().collect()
    n = rows.count()
    seen = {r["w"]: r["count"] for r in df}
    idf = {w: math.log(1 + (n + 1) / (seen.get(i, 0) + 1)) for i, w in enumerate(VOCABULARY)}
    known = templates(idf)
    schema = with_fields(rows, ["doc_id", "n_words"], "n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for hits, found, places in zip(*columns(batch, "phrases", "found", "places")):
                phrases = defaultdict(list)
                for x in hits:
                    phrases[x["p"]].append(x["at"])
                base = {p: phrases[i] for i, p in enumerate(PHRASES) if p in BASE and phrases.get(i)}
                at = [x for v in base.values() for x in v]
                best = match(found, places, phrases, known) if phrases else {}
                own = {BASE[p] for p in base}
                score = max([0.0, *best.values(), *([BASE_SCORE] if at else [])])
                out.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(best))), score))
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_words")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))
