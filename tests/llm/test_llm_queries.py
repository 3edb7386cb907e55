"""Every registered query of the subpackage: against its SQL, or against plain Python over the same table."""

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

from check import check, connect
from docquarry.llm.oracles import ORACLES
from docquarry.llm.queries import QUERIES
from docquarry.llm.tokens import encoder, vocabulary_folder


@pytest.fixture(scope="module")
def texts(small):
    table = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist()))


@pytest.fixture(scope="module")
def library_tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary_folder() + "/byte_bpe_50k.json")
    found.encode_special_tokens = True
    return found


def rows(spark, small, name):
    return QUERIES[name](spark, small).collect()


@pytest.mark.parametrize("name", list(ORACLES))
def test_statement(spark, small, name):
    assert check(spark, connect(small), small, name) is None


def test_there_is_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_brown_scores(spark, small, texts):
    found = {r.doc_id: r for r in rows(spark, small, "op1_brown_scores")}
    assert set(found) == set(texts)
    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    unseen = [found[i] for i in texts if held[i]]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def test_packing(spark, small, texts, library_tokenizer):
    found = rows(spark, small, "op2_best_fit_packing")
    ids = {i: [*library_tokenizer.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids[i]) and all(r.length == 1024 for r in own[1:]) and 1 <= own[0].length <= 1024
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + r.length], "<u4").tobytes())
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        place = 0
        for offset, length in sorted(held):
            assert offset == place
            place += length
        assert place <= 1024
    assert len(sequences) <= math.ceil(sum(map(len, ids.values())) / 1024) + 1


def test_license_scan(spark, small, texts):
    break_up = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = [(b"under the mit license".split(), "mit"), (b"apache license version 2".split(), "apache-2"), (b"cc by nc".split(), "cc-by-nc")]
    found = {r.doc_id: r for r in rows(spark, small, "op5_license_scan")}
    assert set(found) == set(texts)
    for i, text in texts.items():
        words = break_up.findall(text.encode().lower())
        places = [(k, label) for phrase, label in phrases for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
        at, labels = [k for k, _ in places], {label for _, label in places}
        r = found[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        assert labels <= set(r.labels.split(",")) | (set() if labels else {""}) and 0 <= r.score <= 1


def test_quality_classifier(spark, small, texts):
    found = {r.doc_id: r for r in rows(spark, small, "op7_quality_classifier")}
    assert set(found) == set(texts)
    table = pq.read_table(f"{small}/labels.parquet").to_pydict()
    held = [(found[i], q) for i, q in zip(table["doc_id"], table["quality"]) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((r.score >= 0.7) == bool(q) for r, q in held) >= 0.85 * len(held)
    for i, r in found.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def test_document_fingerprints(spark, small, texts):
    found = {r.doc_id: r for r in rows(spark, small, "op8_document_fingerprints")}
    order = sorted(texts, reverse=True)
    assert set(found) == set(texts)
    same = {}
    for i, after in zip(order, order[1:] + order[:1]):
        text, cut = texts[i], len(texts[i]) // 3
        edited = text[: len(text) - cut] + texts[after][:cut]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert same.setdefault(text, r.fingerprint) == r.fingerprint and same.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1 if edited == text else 0.4 < r.near_edited <= 1)
    alike = sum(found[i].near_edited > found[i].near_next for i in order)
    assert alike >= 0.98 * len(order)


def test_token_counts(spark, small, texts, library_tokenizer):
    found = {}
    for r in rows(spark, small, "op9_token_counts"):
        found.setdefault(r.doc_id, {})[r.section] = r
    assert set(found) == set(texts)
    for i, text in texts.items():
        spans = library_tokenizer.encode(text, add_special_tokens=False).offsets
        n = len(text)
        edges = [0, n // 4, n - n // 4, n]
        wanted, crossing = Counter(), Counter()
        names = ["opening", "middle", "closing"]
        for a, b in spans:
            held = [max(0, min(b, edges[k + 1]) - max(a, edges[k])) for k in range(3)]
            best = held.index(max(held))
            wanted[names[best]] += 1
            crossing[names[best]] += sum(h > 0 for h in held) > 1
        for k, name in enumerate(names):
            r = found[i][name]
            assert (r.start_char, r.end_char, r.n_tokens, r.n_crossing, r.doc_tokens) == (edges[k], edges[k + 1], wanted[name], crossing[name], len(spans))


def brute_fingerprint(text):
    words = text.encode().lower().split()
    k = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[j : j + k]), 42) for j in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark, small, texts):
    found = {r.doc_id: r for r in rows(spark, small, "op10_simhash_near_dedup")}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    least = {i: i for i in texts}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids[: bisect.bisect_left(ids, a)]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    assert {i: (f"{prints[i]:016x}", root(i)) for i in texts} == {i: (r.fingerprint, r.component_id) for i, r in found.items()}


TRICKY = [
    "don't we'll 've 's's ''s !'s a 's 'll'ree 're", "  two  spaces ", "\n\n a\n\n", "\t\tx \t y", " ", "", "'", "x'", "x'r", "x're", "  a b",
    "日本語 text <|endoftext|>", "<|endoftext|>", "a1b2 3.14 ½ ²x", "écombining", " em ’s it’s", "tab\u0085nel", "a\x1cb\x00c", "emoji 😀😀 x",
    "trailing  ", "'sfoo 'dx 'mn 'tt", "a\r\n\r\nb \n c", "'S 'LL don'T", "x" * 3000,
]


def test_ids_are_those_of_the_library(texts, library_tokenizer):
    every = TRICKY + list(texts.values())
    ids, offsets = encoder(vocabulary_folder()).encode([t.encode() for t in every])
    for i, text in enumerate(every):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library_tokenizer.encode(text, add_special_tokens=False).ids, text
