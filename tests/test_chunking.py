import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.operators import chunking
from docquarry.plans import catalog
from docquarry.sources.corpus import read_corpus, read_table, supported_files


def split(text, size=800, overlap=120):
    found = []
    for start, stop in tx.window_spans(text, size, overlap):
        piece = text[start:stop].strip(tx.TRIM_CHARS)
        if piece:
            found.append(piece)
    return found


def letters(n, *newlines):
    return "".join("\n" if i in newlines else "a" for i in range(n))


def test_lengths_around_one_chunk():
    assert [len(p) for p in split(letters(800))] == [800]
    assert [len(p) for p in split(letters(801))] == [800, 121]


def test_newline_at_sixty_percent_does_not_break():
    spans = list(tx.window_spans(letters(900, 480), 800, 120))
    assert spans[0] == (0, 800)
    spans = list(tx.window_spans(letters(900, 481), 800, 120))
    assert spans[0] == (0, 481) and spans[1][0] == 361


def test_newline_at_the_end_position_counts():
    spans = list(tx.window_spans(letters(900, 700, 800), 800, 120))
    assert spans[0] == (0, 800)


def test_blank_middle_piece_uses_no_index(spark):
    text = "x" + " " * 40 + "y"
    rows = chunking.chunk_text(spark.createDataFrame([(1, text)], "doc_id long, text string"), chunk_size=10, overlap=2)
    got = sorted((r.chunk_index, r.text) for r in rows.collect())
    assert got == [(0, "x"), (1, "y")]


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, 11), (10, -1)])
def test_bad_options_are_rejected(size, overlap):
    with pytest.raises(ValueError):
        tx.split_pieces(size, overlap)


def test_blank_texts_give_no_rows(spark):
    docs = spark.createDataFrame([(1, ""), (2, "   "), (3, "\r\n \r\n"), (4, None), (5, "a")], "doc_id long, text string")
    assert [r.doc_id for r in chunking.chunk_text(docs).collect()] == [5]


def test_normalize_text(spark):
    raw = "﻿  a\r\nb\rc  　\n"
    row = spark.createDataFrame([(raw,)], "t string").select(tx.normalize_text(F.col("t")).alias("t")).first()
    assert row.t == "a\nb\rc"
    keep = "\u0085x\x1c"
    row = spark.createDataFrame([(keep,)], "t string").select(tx.normalize_text(F.col("t")).alias("t")).first()
    assert row.t == keep


def plain_spans(text, size, overlap):
    """The rule stated step by step, for comparison."""
    spans, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            at = max((i for i in range(0, end + 1) if text[i] == "\n"), default=-1)
            if at > start + int(size * 0.6):
                end = at
        spans.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return spans


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=120), st.integers(1, 30), st.data())
def test_spans_follow_the_rule(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    spans = list(tx.window_spans(text, size, overlap))
    assert spans == plain_spans(text, size, overlap)
    assert all(0 < stop - start <= size for start, stop in spans)
    assert all(b[0] <= a[1] and a[1] - b[0] <= overlap for a, b in zip(spans, spans[1:]))
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)


@pytest.mark.parametrize("sf,chunks,characters", [("sf0.001", 850, 562_948), ("sf0.01", 4_249, 2_799_051)])
def test_golden_counts(spark, sf, chunks, characters):
    row = catalog.document_chunks(spark, f"/root/testdata/{sf}").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("c"),
        F.max("chunk_index").alias("m")).first()
    assert (row.n, row.c) == (chunks, characters)
    assert row.m == {"sf0.001": 30, "sf0.01": 48}[sf]


def test_native_expression_agrees(spark, small):
    docs = read_table(spark, small, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("t"))
    both = docs.select("doc_id", tx.split_pieces()(F.col("t")).alias("a"), tx.split_pieces_native(F.col("t")).alias("b"))
    assert both.filter(F.col("a") != F.col("b")).count() == 0
    assert both.agg(F.sum(F.size("b"))).first()[0] == 850


def test_chunk_pages_runs_on_over_pages(spark):
    pages = spark.createDataFrame(
        [(1, 1, "  \n"), (1, 2, "abcdefghij" * 3), (1, 3, "tail"), (2, 1, "other")], "doc_id long, page long, text string")
    rows = chunking.chunk_pages(pages, chunk_size=20, overlap=5).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.chunk_id, r.page) for r in rows] == [
        (1, 0, "chunk-0", 2), (1, 1, "chunk-1", 2), (1, 2, "chunk-2", 3), (2, 0, "chunk-0", 1)]


def test_chunk_pages_golden_and_block_size(spark, medium):
    pages = catalog.paged(spark, medium)
    assert chunking.chunk_pages(pages).count() == 741
    whole = chunking.chunk_pages(pages, chunk_size=200, overlap=30)
    blocked = chunking.chunk_pages(pages, chunk_size=200, overlap=30, large_key_rows=3)
    assert whole.count() == 1_897
    assert whole.exceptAll(blocked).count() == 0 and blocked.exceptAll(whole).count() == 0


def test_merge_pages_parts_make_the_whole(spark):
    texts = [" ", "", " a ", "", "b", "c\n", "  "]
    pages = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)] + [(2, 1, " "), (2, 2, "\n")],
                                  "doc_id long, page long, text string")
    want = "\n\n".join(texts).strip()
    assert {r.doc_id: r.text for r in chunking.merge_pages(pages).collect()} == {1: want, 2: ""}
    parts = chunking.merge_pages(pages, part_bytes=4).orderBy("doc_id", "part").collect()
    assert "".join(r.text for r in parts if r.doc_id == 1) == want
    assert [r.part for r in parts if r.doc_id == 1] == list(range(len(parts) - 1))


def test_extension_gate(spark):
    names = ["a.TXT", "b.md", "c.csv", "d.pdf", "e.docx", "f.html", "txt", None, "g.txt.gz"]
    df = chunking.extension_gate(spark.createDataFrame([(n,) for n in names], "file_name string"))
    assert [r.supported for r in df.collect()] == [True] * 5 + [False] * 4


def test_ingest_gate_order(spark):
    docs = spark.createDataFrame(
        [(1, None, None), (2, "a.exe", None), (3, "a.txt", None), (4, "a.txt", " \n"), (5, "a.pdf", "text"), (6, "a.txt", "b")],
        "doc_id long, file_name string, text string")
    local = {r.doc_id: (r.status, r.chunk_count) for r in chunking.ingest_gate(docs).collect()}
    assert local == {1: ("invalid", 0), 2: ("unsupported", 0), 3: ("unreadable", 0), 4: ("empty", 0),
                     5: ("ready", 1), 6: ("ready", 1)}
    chunks = chunking.chunk_text(docs.filter("doc_id = 6").select("doc_id", "text"))
    joined = {r.doc_id: r.status for r in chunking.ingest_gate(docs, chunks).collect()}
    assert joined[5] == "no_chunks" and joined[6] == "ready"


def test_read_corpus(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "c.html").write_text("<p>")
    files = read_corpus(spark, str(tmp_path), upload_id="u1")
    assert {r.file_name: r.text for r in files.collect()} == {"a.txt": "one\ntwo", "b.csv": "x,y\n1,2\n", "c.html": "<p>"}
    assert sorted(r.file_name for r in supported_files(files).collect()) == ["a.txt", "b.csv"]
    again = read_corpus(spark, str(tmp_path), upload_id="u1")
    assert {r.doc_id for r in files.collect()} == {r.doc_id for r in again.collect()}
    other = read_corpus(spark, str(tmp_path), upload_id="u2")
    assert not {r.doc_id for r in files.collect()} & {r.doc_id for r in other.collect()}


def test_characters_above_the_plane_count_twice(spark):
    docs = spark.createDataFrame([(1, "\U0001F600" * 500), (2, "ab" * 399 + "\U0001F600" * 3)], "doc_id long, text string")
    found = {}
    for r in chunking.chunk_text(docs).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(r.doc_id, []).append(r.text)
    assert [len(t) for t in found[1]] == [400, 160]
    assert found[2][0] == "ab" * 399 + "\U0001F600" and found[2][1].endswith("\U0001F600" * 3)


def test_pages_without_a_number_come_first(spark):
    pages = spark.createDataFrame([(1, 1, "b"), (1, None, "a"), (2, None, "alone")], "doc_id long, page long, text string")
    assert {r.doc_id: r.text for r in chunking.merge_pages(pages).collect()} == {1: "a\n\nb", 2: "alone"}


def test_repeated_page_numbers_get_chunks_of_their_own(spark):
    rows = [(1, 1, "a" * 25), (1, 1, "b" * 12), (1, 1, "b" * 12), (1, None, "c" * 25), (1, 2, "d"), (1, 2, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page long, text string")
    for large in (1_000_000, 2):
        found = chunking.chunk_pages(pages, chunk_size=10, overlap=2, large_key_rows=large).orderBy("chunk_index").collect()
        assert [r.chunk_index for r in found] == list(range(len(found)))
        by_text = {}
        for r in found:
            by_text.setdefault(r.text[0], []).append(r.chunk_index)
        assert by_text["c"][0] == 0 and by_text["d"] == [len(found) - 1]  # pages without a number first
        assert len(by_text["b"]) == 4 and all(b - a == 1 for a, b in zip(by_text["a"], by_text["a"][1:]))


def test_splits_of_a_batch_are_joined_in_order(spark):
    """A Python worker takes a few hundred texts at a time out of a batch of any size."""
    docs = spark.range(0, 3 * tx.TEXTS_AT_ONCE + 5, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 3, F.repeat(F.concat("id", F.lit(" word ")), 30)).alias("text"))
    got = {(r.doc_id, r.chunk_index): r.text for r in chunking.chunk_text(docs, chunk_size=100, overlap=10).collect()}
    want = {(d.doc_id, i): piece for d in docs.collect() for i, piece in enumerate(tx.pieces_of((d.text or "").strip(), 100, 10))}
    assert got == want
