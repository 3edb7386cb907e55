"""Licence scans by diagonal voting.

Templates (licence texts and notices) and documents are cut into rolling runs of k
words. Spark joins all run hashes of the documents with the positions of the same
runs in the templates; a hit votes for a diagonal, the document position less
the template position. Votes are summed by diagonal; neighbouring diagonals,
a few words inserted or missing apart, are merged into one span, no wider than a
template can drift; and each span is verified by aligning its words with the template's.

A span holds its template if the aligned words cover ``cover`` of it, all words that tell the licence from its
relatives ([in brackets]: versions, noncommercial, lesser) are aligned,
and no such word of another licence stands inside or right behind it. Of spans that overlap the one with the most
aligned words wins, so a stretch has one label. Phrases are looked for as well, wherever their words stand
consecutively; their labels always stay.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case.

Defined results: null and empty texts have no words; a text shorter than k words
casts no vote, its phrases count; phrases and templates without words
match nothing; rows with the same doc_id share their spans, and each is verified by its own text;
a row without a doc_id is checked for phrases only; empty tables give no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.arrays import LOWER, document_of, pieces, text_bytes, whole_windows, window_hashes, word_hashes, words_in
from docquarry.llm.tables import doc_columns

RUN, NEAR, COVER = 4, 6, 0.8
BROADCAST_ROWS = 1 << 20  # template positions
PIECE = 1 << 20  # bytes of text at a time: every word becomes a row
BREAKS = np.zeros(256, bool)
BREAKS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

# Phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Words that make another licence of the same text, wherever they are not the template's own.
VARIANTS = ("nc", "noncommercial", "nd", "noderivatives", "noderivs", "sa", "sharealike", "lesser", "library", "affero")
# Parts of Creative Commons licence names, short and long.
_COMMONS = (("nc", "noncommercial"), ("sa", "sharealike"), ("nd", "noderivatives"))
_WARRANTY = ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
             "merchantability or fitness for a particular purpose see the gnu {} for more details")
_BSD = ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution {}this software is provided by the copyright holders and contributors "
        "as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
        "special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or "
        "profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
        "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage")
_ENDORSE = ("[neither] the name of the copyright holder nor the names of its contributors may be used to [endorse] or [promote] products derived from "
            "this software without specific prior written permission ")


def _gnu(label: str, name: str, version: str) -> list[tuple[str, str]]:
    """A GNU licence's notice, with and without its warranty clause, and the usual sentences that name it."""
    terms = (f"is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by "
             f"the free software foundation either version {version} of the license or at your option any later version ")
    return [(label, "this program " + terms + _WARRANTY.format(name)), (label, "this program " + terms), (label, f"licensed under the gnu {name} version {version}"),
            (label, f"under the terms of the gnu {name} version {version}"), (label, f"this work is licensed under the gnu {name} version {version}")]


def _commons() -> list[tuple[str, str]]:
    """The six Creative Commons attribution licences by their short and long names."""
    out = []
    for parts in ((), (0,), (1,), (2,), (0, 1), (0, 2)):
        short, long = (" ".join(f"[{_COMMONS[i][at]}]" for i in parts) for at in (0, 1))
        label = "-".join(["cc-by", *(_COMMONS[i][0] for i in parts)])
        out += [(label, f"licensed under cc by {short} 4.0"), (label, f"licensed under cc by {short}"), (label, f"licensed under a creative commons attribution {long} 4.0 international license"),
                (label, f"this work is licensed under the creative commons attribution {long} license")]
    return out


# Licence texts and notices by label; words in brackets must be there.
TEMPLATES = (
    ("mit", "released under the [mit] license"),
    ("mit", "licensed under the [mit] license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to "
            "deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or "
            "sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided "
            "as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular "
            "purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in "
            "an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
            "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with "
            "regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special "
            "direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
            "negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("apache-2", "licensed under the apache license version [2].0"),
    ("apache-2", "licensed under the apache license version [2].0 the license you may not use this file except in compliance with the license you may obtain a "
                 "copy of the license at http www apache org licenses license [2].0 unless required by applicable law or agreed to in writing software "
                 "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see "
                 "the license for the specific language governing permissions and limitations under the license"),
    ("apache-1.1", "licensed under the apache software license version [1].[1]"),
    ("apache-1.1", "licensed under the apache license version [1].[1]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2", _BSD.format("")),
    ("bsd-3", _BSD.format(_ENDORSE)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v [2].0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v [2].0 if a copy of the mpl was not distributed with this file you can "
              "obtain one at http mozilla org mpl [2].0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute "
                  "this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0", "licensed under [cc0] 1.0 universal"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved no part of this work may be reproduced"),
    *_commons(),
    *_gnu("gpl-2", "[general] public license", "[2]"),
    *_gnu("gpl-3", "[general] public license", "[3]"),
    *_gnu("lgpl-2.1", "[lesser] general public license", "[2].[1]"),
    *_gnu("lgpl-3", "[lesser] general public license", "[3]"),
    *_gnu("agpl-3", "[affero] general public license", "[3]"),
)


@dataclass
class Template:
    label: str
    words: list[int]
    required: set[int]  # positions


def parsed(label: str, text: str) -> Template:
    """A template's words, and the positions of those in brackets."""
    words: list[int] = []
    required: set[int] = set()
    for number, part in enumerate(re.split(r"[\[\]]", text)):
        own = _hash_text(part).tolist()
        if number % 2:
            required |= set(range(len(words), len(words) + len(own)))
        words += own
    return Template(label, words, required)


def words_from(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a piece, and each document's first word."""
    data = LOWER[data]
    starts, ends, first = words_in(data, offsets, BREAKS)
    return word_hashes(data, starts, ends), first


def _hash_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_from(raw, np.array([0, len(raw)]))[0]


def _runs(length: int):
    """(doc_id, place, hash) of every run of words of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches, size=PIECE):
            words, first = words_from(*text_bytes(table.column("text")))
            at = whole_windows(first, length)
            owner = document_of(first)[at]
            ids = table.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[owner]), pa.array((at - first[owner]).astype(np.int32)), pa.array(window_hashes(words, length)[at].view(np.int64))],
                ["doc_id", "place", "hash"])

    return run


def diagonals(docs: DataFrame, templates=TEMPLATES, length: int = RUN) -> DataFrame:
    """(doc_id, template, diagonal, votes): how many runs of each document stand on each diagonal with a template."""
    rows = []
    for number, (label, text) in enumerate(templates):
        words = np.array(parsed(label, text).words, np.uint64)
        rows += [(number, i, int(h)) for i, h in enumerate(window_hashes(words, length).view(np.int64))]
    places = docs.sparkSession.createDataFrame(rows, "template int, offset int, hash long")  # as many rows as the templates have words
    runs = doc_columns(docs).filter("doc_id IS NOT NULL").mapInArrow(_runs(length), "doc_id long, place int, hash long")
    small = F.broadcast(places) if len(rows) <= BROADCAST_ROWS else places
    hits = runs.join(small, "hash").select("doc_id", "template", (F.col("place") - F.col("offset")).alias("diagonal"), "place")
    return hits.groupBy("doc_id", "template", "diagonal").agg(F.countDistinct("place").alias("votes"))


def merged(marks: list[tuple[int, int]], near: int, drift: int) -> list[tuple[int, int, int]]:
    """(low, high, votes) of spans of (diagonal, votes) marks: neighbours at most ``near`` apart, and ``drift`` from first to last."""
    out: list[tuple[int, int, int]] = []
    for diagonal, votes in sorted(marks):
        if out and diagonal - out[-1][1] <= near and diagonal - out[-1][0] <= drift:
            out[-1] = (out[-1][0], diagonal, out[-1][2] + votes)
        else:
            out.append((diagonal, diagonal, votes))
    return out


def aligned(words: list[int], template: Template, low: int, high: int) -> list[tuple[int, int]]:
    """(place, position) of the template's words that stand in order in ``words`` on diagonals low to high:
    a longest common subsequence in that band, required words before all others."""
    wanted, more = template.words, len(template.words) + 1
    weights = [more if i in template.required else 1 for i in range(len(wanted))]
    before = [0] * (len(wanted) + 1)
    table = [before]
    for place, word in enumerate(words):
        now = before[:]
        first, stop = max(place - high, 0), min(place - low + 1, len(wanted))
        for i in range(first, stop):
            best = now[i] if now[i] > before[i + 1] else before[i + 1]
            if word == wanted[i] and before[i] + weights[i] > best:
                best = before[i] + weights[i]
            now[i + 1] = best
        for i in range(max(stop, 0), len(wanted)):
            if now[i + 1] < now[i]:
                now[i + 1] = now[i]
        table.append(now)
        before = now
    pairs, place, i = [], len(words), len(wanted)
    while place and i:
        if table[place][i] == table[place - 1][i]:
            place -= 1
        elif table[place][i] == table[place][i - 1]:
            i -= 1
        else:
            place, i = place - 1, i - 1
            pairs.append((place, i))
    return pairs[::-1]


@dataclass
class Found:
    label: str
    first: int
    last: int
    count: int
    share: float


def _verified(words: np.ndarray, template: Template, low: int, high: int, cover: float, variants: set[int]) -> tuple[float, Found | None]:
    """The share of the template that a span of a document's words holds, and the place, if that is the template's licence."""
    begin, stop = max(low, 0), min(len(words), high + len(template.words))
    part = words[begin:stop].tolist()
    # an upper bound first: words they have in common in any order
    most = sum((Counter(part) & Counter(template.words)).values()) / len(template.words)
    if most < cover:
        return most, None
    pairs = aligned(part, template, low - begin, high - begin)
    share = len(pairs) / len(template.words)
    failed = min(share, 0.99 * cover)
    if share < cover or not template.required <= {i for _, i in pairs}:
        return failed, None
    own = {place for place, _ in pairs}
    first, last = pairs[0][0], pairs[-1][0]
    around = words[begin + first : begin + last + 2].tolist()  # and the word behind it
    if any(word in variants and first + i not in own for i, word in enumerate(around)):
        return failed, None
    return share, Found(template.label, begin + first, begin + last, len(pairs), share)


def _best(found: list[Found]) -> list[Found]:
    """One template per stretch: the one with the most aligned words, then the greater share."""
    out: list[Found] = []
    for one in sorted(found, key=lambda f: (-f.count, -f.share, f.first, f.label)):
        if all(one.last < other.first or other.last < one.first for other in out):
            out.append(one)
    return sorted(out, key=lambda f: f.first)


def _phrase_places(words: np.ndarray, first: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Starts of the phrase in the piece."""
    at = np.flatnonzero(words == phrase[0])
    last = first[1:][np.searchsorted(first[1:], at, "right")] if len(at) else at
    at = at[at + len(phrase) <= last]
    for i in range(1, len(phrase)):
        at = at[words[at + i] == phrase[i]]
    return at


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, length: int = RUN, near: int = NEAR, cover: float = COVER, variants=VARIANTS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    ``spans`` lists the verified ones. ``score`` is 1 with a base phrase, else the greatest share of a template that a verified
    span holds; what fails gives less than ``cover``.
    """
    found = diagonals(docs, templates, length).groupBy("doc_id").agg(F.collect_list(F.struct("template", "diagonal", "votes")).alias("found"))
    joined = doc_columns(docs).join(found, "doc_id", "left")
    asked = [(_hash_text(text), label) for text, label in phrases]
    asked = [(words, label) for words, label in asked if len(words)]
    known = [parsed(label, text) for label, text in templates]
    other = {int(h) for word in variants for h in _hash_text(word)}

    def spans_of(words: np.ndarray, marks: list[dict]) -> tuple[float, list[Found]]:
        by_template: dict[int, list[tuple[int, int]]] = {}
        for mark in marks:
            by_template.setdefault(mark["template"], []).append((mark["diagonal"], mark["votes"]))
        score, good = 0.0, []
        for number, votes in by_template.items():
            template = known[number]
            for low, high, _ in merged(votes, near, max(near, len(template.words) // 4)):
                # words at the ends may be too few for a run of their own, after a missing or inserted one
                share, one = _verified(words, template, low - near, high + near, cover, other)
                score = max(score, share)
                if one is not None:
                    good.append(one)
        return score, _best(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("share", pa.float64())]))
        for table in pieces(batches, size=PIECE):
            words, first = words_from(*text_bytes(table.column("text")))
            n = table.num_rows
            count, begin, stop = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in asked:
                at = _phrase_places(words, first, phrase)
                owner = np.searchsorted(first, at, "right") - 1
                place = at - first[owner]
                np.add.at(count, owner, 1)
                np.minimum.at(begin, owner, place)
                np.maximum.at(stop, owner, place)
                for row in np.unique(owner).tolist():
                    base[row].add(label)
            labels, scores, verified = [], [], []
            for row, marks in enumerate(table.column("found").to_pylist()):
                score, good = spans_of(words[first[row] : first[row + 1]], marks or [])
                labels.append(",".join(sorted(base[row] | {g.label for g in good})))
                scores.append(1.0 if base[row] else score)
                verified.append([{"label": g.label, "first_word": g.first, "last_word": g.last, "share": g.share} for g in good])
            some = count > 0
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(np.diff(first)), pa.array(count), pa.array(begin, mask=~some), pa.array(stop, mask=~some),
                 pa.array([",".join(sorted(b)) for b in base]), pa.array(labels), pa.array(scores), pa.array(verified, span_type)],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return joined.mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first_word:long,last_word:long,share:double>>")
