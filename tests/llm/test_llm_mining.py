"""Exact top-k search, periodic runs and phrase collocations against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import collocations, queries, runs, topk
from docquarry.llm.arrays import mix

WORD = re.compile("[^\x20\x09-\x0d]+")


# exact top-k


def nearest(rows, k=5, every=50):
    whole = [
        (i, vec_id, np.floor(256 * np.array(v, np.float64)).astype(np.int64))
        for i, (vec_id, v) in enumerate(rows)
        if v and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, query_id, q in whole:
        if query_id is not None and query_id % every == 0:
            found = sorted((-int(q @ v), vec_id is None, vec_id or 0) for j, vec_id, v in whole if j != i and len(v) == len(q))[:k]
            out += [(query_id, rank, None if no_id else vec_id, -score) for rank, (score, no_id, vec_id) in enumerate(found, 1)]
    return sorted(out, key=str)


def searched(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("x")).withColumn("width", F.lit(0))
    return sorted((tuple(r) for r in topk.top_k(df, **options).collect()), key=str)


def vectors(count, width, seed, most=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(8, width))
    found = (centres[draw.integers(0, 8, count)] + draw.normal(scale=0.4, size=(count, width))) * most
    return [(i, [float(x) for x in v]) for i, v in enumerate(found.astype(np.float32))]


@pytest.mark.parametrize("options", [{}, {"block_rows": 40, "dimensions": 3, "cell_bytes": 4000}])
def test_top_k_equals_all_products(spark, options):
    rows = vectors(700, 24, 3)
    rows += rows[:120] + [rows[5]] * 60  # repeated rows are candidates and queries of their own
    assert searched(spark, rows, **options) == nearest(rows)


def test_top_k_leaves_out_unusable_vectors_and_keeps_lengths_apart(spark):
    odd = [(None, [0.5, 0.5]), (100, None), (150, []), (200, [float("nan"), 1.0]), (250, [None, 1.0]), (300, [float("inf"), 0.0])]
    rows = [(0, [1.0, 0.5]), (50, [0.25, -1.0]), (7, [1.0, 0.5]), (3, [1.0, 0.5]), (1, [2.0]), (400, [3.0]), (350, [1.0, 2.0, 3.0]), *odd]
    assert searched(spark, rows) == nearest(rows)
    assert searched(spark, odd) == []
    assert searched(spark, []) == []


def test_top_k_with_products_beyond_doubles(spark):
    rows = [(i, [float(np.float32(2.0**20 + i * 2**13)), float(np.float32(-(2.0**19) - (i % 7) * 2**12))]) for i in range(120)]
    assert searched(spark, rows, dimensions=1) == nearest(rows)


def test_top_k_bounds_leave_no_candidate_out(spark, small):
    wide = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in wide.collect()]
    assert sorted((tuple(r) for r in queries.op11_exact_top_k(spark, small).collect()), key=str) == nearest(rows)


# periodic runs


def lyndon(codes):
    out = []
    for i in range(len(codes)):
        ends = [j for j in range(i + 1, len(codes) + 1) if all(codes[i:j] < codes[k:j] for k in range(i + 1, j))]
        out.append(max(ends) - i)
    return out


def all_runs(words, min_length=6, min_exponent=4):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(min_length, min_exponent * q):
                if not any(words[start : start + length - p] == words[start + p : start + length] for p in range(1, q)):
                    found.append((start, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_array_of_random_words():
    draw = random.Random(5)
    for _ in range(600):
        codes = [draw.randrange(draw.randint(1, 4)) for _ in range(draw.randint(1, 20))]
        codes = np.unique(codes, return_inverse=True)[1].tolist()
        assert runs.lyndon_array(codes) == lyndon(codes)


@pytest.mark.parametrize("least", [(1, 2), (6, 4), (5, 2.5)])
def test_runs_of_random_words(least):
    draw = random.Random(11)
    for _ in range(500):
        codes = [draw.randrange(draw.randint(1, 3)) for _ in range(draw.randint(1, 16))] * draw.randint(1, 5)
        words = mix(np.array(codes, np.uint64))
        cut = runs._stretches(words, np.zeros(len(words), np.int64), int(least[1]), least[0])
        found = [(a, b - a, q) for a, b, q in runs.runs_in(words, cut, *least)]
        assert found == all_runs(codes, *least)


def test_comparing_words_mends_a_wrong_extension():
    words = mix(np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 8, 2], np.uint64))
    assert runs._compared(words, 0, 11, 0, 11, 2) == (1, 9)
    assert runs._compared(words, 0, 11, 1, 9, 2) == (1, 9)


def run_digests(doc_id, text):
    words = WORD.findall(text or "")
    h, n = (None if doc_id is None else zlib.crc32(str(doc_id).encode())), len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = all_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lost = {i for s, length, q in found for i in range(s + q, s + length)}
    lines, kept = "".join("%d,%d,%d\n" % r for r in found), " ".join(w for i, w in enumerate(words) if i not in lost)
    shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shown, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_runs_of_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    short = {k for k, v in texts.items() if len(WORD.findall(v or "")) <= 800}
    found = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, small).collect()}
    assert set(found) == set(texts) and len(short) > 100
    assert [found[k] for k in sorted(short)] == [run_digests(k, texts[k]) for k in sorted(short)]
    assert sum(r[1] for r in found.values()) > 0


def test_runs_of_odd_rows(spark):
    tail = "a b " * 4000 + "c"  # one very long run
    rows = [(None, "x " * 9), (1, None), (2, ""), (3, " \t\n"), (4, "x y " * 6 + "é"), (4, "x y " * 6 + "é"), (5, tail), (6, "go go go go go go\x0bgo stop"),
            (7, "one two one two one two one"), (8, "one two one two one two one two")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, runs string").withColumn("start", F.lit(1))
    found = runs.digests(runs.find_runs(runs.with_planted_repeats(df)))
    by_id = defaultdict(list)
    for r in found.collect():
        by_id[r.doc_id].append(tuple(r))
    for doc_id, text in rows:
        if doc_id != 5:
            assert run_digests(doc_id, text) in by_id[doc_id]
    assert len(by_id[4]) == 2 and by_id[5][0][1:6] == (1, 0, 8000, 2, 4_000_000)
    assert runs.digests(runs.find_runs(df.limit(0))).collect() == []


# phrase collocations


def phrases(rows, least=100, longest=5, best=2000):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for size in range(1, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        ranked = []
        for p, a in candidates.items():
            if around[p] < a:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:best], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def test_collocations_of_documents(spark, small):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_phrase_collocations(spark, small).collect()) == phrases(rows) != []


def test_collocations_over_many_blocks_and_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(12)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert mined(docs, least=4, shards=3, best=60) == phrases(rows, 4, best=60)


def test_collocations_of_odd_rows(spark):
    rows = [(None, "New York city. New York, New York!"), ("und", "NEW york"), ("en", None), ("en", ""), ("en", " .;\n"), ("fr", "a a a a a a"), ("fr", "é b é b. é b"),
            ("de", "x y\x0bx y\x0cx y z"), ("de", "x y z"), ("", "so so so")] * 2
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int").withColumn("phrase", F.lit("p")).repartition(5)
    for least in (2, 4):
        assert mined(df, least=least, shards=2) == phrases(rows, least)
    assert mined(df.limit(0)) == []


def test_a_bitmap_never_says_no_to_its_phrases(spark):
    keys = np.arange(1, 60001, dtype=np.uint64)
    rows = [(bytearray(word.tobytes()), int(key) % 5) for key, word in zip(keys, mix(keys))]
    both, late = collocations.bitmaps(spark.createDataFrame(rows, "phrase binary, step int"), 3, len(rows))
    assert both.holds(mix(keys)).all() and late.holds(mix(keys[keys % np.uint64(5) >= 3])).all()
    assert both.holds(mix(keys + np.uint64(10**9))).mean() < 0.1


def test_packed_counts_add_up_in_a_few_bytes_a_phrase():
    rng = np.random.default_rng(3)
    words, parts, want = mix(np.arange(1, 3001, dtype=np.uint64)), [], Counter()
    for _ in range(3):
        own = rng.permutation(words)
        places = np.unique((rng.random((20_000, 2)) ** 3 * len(own)).astype(np.uint32), axis=0)
        counts = rng.geometric(0.7, len(places))
        parts.append((own, places, counts))
        want.update(dict(zip(map(tuple, own[places].tolist()), counts.tolist())))
    row = collocations.packed(*collocations.added(parts)) | {"width": 2}
    found, places, counts = collocations.unpacked(row)
    assert dict(zip(map(tuple, found[places].tolist()), counts.tolist())) == want
    assert len(counts) == len(want) and sum(len(x) for x in row.values() if isinstance(x, bytes)) < 6 * len(want)  # 24 each as rows


def test_collocations_sent_in_many_small_parts(spark, small, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 1)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 500)
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(150).repartition(3)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert mined(docs, least=4, best=60) == phrases(rows, 4, best=60) != []
