"""The pipeline, each stage on what the one before kept."""

import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as cp
from docquarry.llm import quality, simhash
from docquarry.llm.tables import kept, read


@pytest.fixture(scope="module")
def steps(spark, small):
    """The rows after 0, 1, ... stages."""
    rows = [read(spark, small, "documents")]
    for _, stage in cp.STAGES:
        rows.append(kept(stage(spark, rows[-1], small), "step"))
    return rows


def as_dict(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert len(cp.STAGES) == 5
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:5])


def test_poor_documents_go_and_clean_ones_stay(steps, small):
    before, after = as_dict(steps[0]), as_dict(steps[1])
    assert all(before[i] == t for i, t in after.items())
    table = pq.read_table(f"{small}/labels.parquet").to_pydict()
    good = [i for i, q in zip(table["doc_id"], table["quality"]) if q == 1]
    poor = [i for i, q in zip(table["doc_id"], table["quality"]) if q == 0]
    assert sum(i in after for i in good) >= 0.97 * len(good)
    assert sum(i in after for i in poor) <= 0.2 * len(poor)


def test_the_stage_decides_as_the_classifier_does(spark, small, steps):
    scores = quality.quality_scores(steps[0], read(spark, small, "labels"))
    assert {r.doc_id for r in scores.filter("predicted = 1").collect()} == set(as_dict(steps[1]))


def test_repeated_lines_go(steps):
    before, after = as_dict(steps[1]), as_dict(steps[2])
    holder = {}
    for i in sorted(before):
        for line in before[i].split("\n"):
            holder.setdefault(line.encode().strip().lower(), i)
    for i, text in before.items():
        lines = [x for x in text.split("\n") if len(x.encode().strip().decode()) < 10 or holder[x.encode().strip().lower()] == i]
        assert after[i] == "\n".join(lines)
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_group_stays(steps):
    before, after = as_dict(steps[2]), as_dict(steps[3])
    groups = {r.doc_id: r.component_id for r in simhash.similar_groups(steps[2]).collect()}
    assert set(after) == set(groups.values()) == {min(i for i in groups if groups[i] == g) for g in set(groups.values())}
    assert all(after[i] == before[i] for i in after)
    seen = {}
    for i in sorted(before):
        first = seen.setdefault(before[i], i)
        assert first == i or i not in after


def test_contaminated_documents_go(steps, small):
    import re

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    def shingles(text):
        found = words(text)
        return {tuple(found[k : k + 5]) for k in range(len(found) - 4)}

    items = [shingles(t) for t in pq.read_table(f"{small}/benchmark.parquet").column("text").to_pylist()]
    before = as_dict(steps[3])
    held = {i for i, t in before.items() if any(len(item & shingles(t)) >= math.ceil(0.8 * len(item) - 1e-9) for item in items)}
    assert set(as_dict(steps[4])) == set(before) - held


def test_everything_left_is_packed(spark, small, steps):
    from docquarry.llm.tokens import encoder, vocabulary_folder

    left = as_dict(steps[4])
    packed = steps[5].collect()
    assert {r.doc_id for r in packed} == set(left)
    encode = encoder(vocabulary_folder())
    for i in list(left)[:50]:
        ids = np.r_[encode.encode([left[i].encode()])[0], 2].astype("<u4")
        for r in (r for r in packed if r.doc_id == i):
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    rows = cp.run(spark, small)
    assert sorted((r.doc_id, r.piece, r.length) for r in rows.collect()) == sorted((r.doc_id, r.piece, r.length) for r in packed)
