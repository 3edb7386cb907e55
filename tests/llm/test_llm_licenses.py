"""Licence labels: near misses, best template per stretch, and a plain alignment of every template with every text."""

import random
import re

import numpy as np
import pytest

from docquarry.llm import licenses

SCHEMA = "doc_id long, text string"
CASES = [
    ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Licensed under CC BY 4.0. Licensed under CC BY 4.0.", "cc-by"),
    ("licensed under cc by nc 4.0", "cc-by-nc"),
    ("licensed under CC BY-NC-SA 4.0.", "cc-by-nc,cc-by-nc-sa"),  # 'cc by nc' is a base phrase
    ("Licensed under CC BY-ND 4.0 here", "cc-by-nd"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("This work is licensed under the GNU General Public License version 2.", "gpl-2"),
    ("This work is licensed under the GNU General Public License version 3.", "gpl-3"),
    ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("licensed under the GNU Lesser General Public License version 3", "lgpl-3"),
    ("licensed under the GNU Affero General Public License version 3", "agpl-3"),
    ("licensed under the Apache Software License, Version 1.1", "apache-1.1"),
    ("licensed under the Apache License, Version 2.0", "apache-2"),
    ("licensed under the Apache Licence of some kind", ""),
    ("All rights reserved. No part of this work may be reproduced.", "all-rights-reserved"),
    ("released under the BSD license", ""),
    ("one text licensed under CC BY 4.0 and twenty other words that stand between the two of them so that they are apart, "
     "released under the MIT license", "cc-by,mit"),
]


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))


@pytest.mark.parametrize("padding", ["", "lorem ipsum dolor sit amet " * 8])
def test_near_misses(spark, padding):
    docs = spark.createDataFrame([(i, padding + text + (". " + padding if padding else "")) for i, (text, _) in enumerate(CASES)], SCHEMA)
    found = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert {text: found[i].labels for i, (text, _) in enumerate(CASES)} == dict(CASES)
    assert all((r.score >= licenses.COVER) == bool(r.labels) for r in found.values())


def test_whole_licences_are_told_apart(spark):
    rows = [(i, " ".join(words_of(text))) for i, (_, text) in enumerate(licenses.TEMPLATES)]
    found = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in found[i].labels.split(",") and found[i].score == 1.0, label
        others = set(found[i].labels.split(",")) - {label} - {found[i].base_labels}
        assert not others, (label, others)
    # without the clause about names the three-clause text is the two-clause one
    assert [found[i].labels for i, (label, _) in enumerate(licenses.TEMPLATES) if label.startswith("bsd-")] == ["bsd-2", "bsd-3"]


def plain_labels(text):
    """Every template against every stretch of the text, by a full alignment, without votes."""
    words = licenses._hash_text(text).tolist()
    variants = {int(h) for w in licenses.VARIANTS for h in licenses._hash_text(w)}
    found = []
    for label, body in licenses.TEMPLATES:
        template = licenses.parsed(label, body)
        size, start = len(template.words), 0
        while start < len(words):
            part = words[start : start + size + licenses.NEAR]
            pairs = licenses.aligned(part, template, -size, len(part))
            count = len(pairs)
            if count >= licenses.COVER * size and pairs[0][0] == 0 and template.required <= {i for _, i in pairs}:
                own, last = {p for p, _ in pairs}, pairs[-1][0]
                if not any(w in variants and i not in own for i, w in enumerate(words[start : start + last + 2])):
                    found.append(licenses.Found(label, start, start + last, count, count / size))
            start += 1
    return ",".join(sorted({f.label for f in licenses._best(found)}))


def test_labels_of_noisy_notices_as_by_plain_alignment(spark):
    draw, rows = random.Random(2), []
    short = [(label, words_of(text)) for label, text in licenses.TEMPLATES if 10 <= len(words_of(text)) < 40]
    for i in range(60):
        label, words = draw.choice(short)
        words = list(words)
        at = draw.randrange(len(words) - 6) + 1
        kind = draw.choice(["same", "insert", "drop", "half"])
        if kind == "insert":
            words.insert(at, f"extra{i}")
        elif kind == "drop":
            del words[at]
        elif kind == "half":
            words = words[: len(words) // 2]
        rows.append((i, " ".join([f"before{i}", *words, f"after{i}"])))
    found = {r.doc_id: (r.labels, r.base_labels) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA), phrases=()).collect()}
    assert {i: found[i][0] for i, _ in rows} == {i: plain_labels(text) for i, text in rows}


def test_merged_diagonals_stay_near_each_other():
    marks = [(d, 1) for d in range(0, 100, 5)]
    assert licenses.merged(marks, 6, 20) == [(0, 20, 5), (25, 45, 5), (50, 70, 5), (75, 95, 5)]
    assert licenses.merged([], 6, 20) == [] and licenses.merged([(3, 2), (90, 1)], 6, 20) == [(3, 3, 2), (90, 90, 1)]


def test_alignment_prefers_required_words():
    template = licenses.parsed("x", "a b [c] d")
    words = [int(licenses._hash_text(w)[0]) for w in "a d c d".split()]
    assert [i for _, i in licenses.aligned(words, template, -4, 4)] == [0, 2, 3]
    assert np.array_equal(template.words, licenses._hash_text("a b c d")) and template.required == {2}
