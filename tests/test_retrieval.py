import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.functions import vectors
from docquarry.operators import embedding, retrieval
from docquarry.plans import ask, catalog

CHUNK = "doc_id long, chunk_index long, embedding array<float>"


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, CHUNK)


def query_table(spark, rows):
    return spark.createDataFrame(rows, "query_id string, scope string, embedding array<float>")


def brute_force(queries, chunks, k, allowed=None):
    """All pairs on the driver, for small inputs."""
    out = {}
    for q in queries:
        scored = []
        qv = np.array(q.embedding, dtype=float)
        for c in chunks:
            if allowed is not None and not allowed(q, c):
                continue
            cv = np.array(c.embedding, dtype=float)
            if not qv.any() or not cv.any():
                continue
            score = round(float(qv @ cv / np.sqrt(qv @ qv) / np.sqrt(cv @ cv)), 6)
            scored.append((-score, c.doc_id, c.chunk_index))
        out[q.query_id] = [(d, i, -s) for s, d, i in sorted(scored)[:k]]
    return {q: hits for q, hits in out.items() if hits}


def as_dict(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.doc_id, r.chunk_index, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert [h[:2] for h in got[key]] == [h[:2] for h in want[key]]
        assert np.allclose([h[2] for h in got[key]], [h[2] for h in want[key]], atol=2e-6)


def test_golden_neighbours(spark, medium):
    chunks = catalog.vector_chunks(spark, medium)
    asked = chunks.filter("chunk_index < 5").select(F.col("chunk_index").alias("query_id"), "embedding")
    got = as_dict(retrieval.top_k(asked, chunks))
    want = {
        0: [(0, 1.0), (365, 0.369994), (334, 0.362722)],
        1: [(1, 1.0), (386, 0.371485), (27, 0.348208)],
        2: [(2, 1.0), (117, 0.318143), (450, 0.266344)],
        3: [(3, 1.0), (130, 0.399872), (149, 0.329934)],
        4: [(4, 1.0), (114, 0.398513), (496, 0.341212)],
    }
    assert {q: [(i, s) for _, i, s in hits] for q, hits in got.items()} == want
    assert retrieval.top_k_per_document(asked, chunks).count() == 150


def test_all_against_all_is_exact_in_one_block_or_many(spark, small):
    chunks = catalog.vector_chunks(spark, small).repartition(7)
    asked = chunks.select(F.col("chunk_index").cast("string").alias("query_id"), "embedding")
    want = brute_force(asked.collect(), chunks.collect(), 4)
    same(as_dict(retrieval.top_k(asked, chunks, 4)), want)
    same(as_dict(retrieval.top_k(asked, chunks, 4, block_bytes=20_000)), want)


def test_merge_of_per_document_lists_equals_global(spark, small):
    chunks = catalog.vector_chunks(spark, small)
    asked = catalog.centroid_queries(spark, small)
    merged = {}
    for r in retrieval.top_k_per_document(asked, chunks).collect():
        merged.setdefault(r.query_id, []).append((-r.score, r.doc_id, r.chunk_index))
    want = {q: [(d, i, -s) for s, d, i in sorted(hits)[:3]] for q, hits in merged.items()}
    same(as_dict(retrieval.top_k(asked, chunks)), want)


def test_ties_copies_and_zero_vectors(spark):
    """Most chunks are copies of one vector; order falls back to ids, exactly."""
    rows = [(d, i, [1.0, 0.0]) for d in range(4) for i in range(300)] + [(9, 0, [0.0, 0.0]), (9, 1, None), (9, 2, [0.0, 1.0])]
    chunks = chunk_table(spark, rows).repartition(5)
    asked = query_table(spark, [("q", None, [2.0, 0.0]), ("zero", None, [0.0, 0.0])])
    assert as_dict(retrieval.top_k(asked, chunks, 5)) == {"q": [(0, i, 1.0) for i in range(5)]}
    everything = as_dict(retrieval.top_k(asked, chunks, 5_000))["q"]
    assert len(everything) == 1_201 and everything[-1] == (9, 2, 0.0)


def test_newest_document_wins_ties(spark):
    chunks = spark.createDataFrame(
        [(1, 0, 10, [1.0, 0.0]), (2, 0, 20, [1.0, 0.0]), (2, 1, 20, [1.0, 0.0]), (3, 0, 5, [1.0, 0.0])],
        "doc_id long, chunk_index long, uploaded_at long, embedding array<float>").repartition(3)
    asked = query_table(spark, [("q", None, [1.0, 0.0])])
    got = as_dict(retrieval.top_k(asked, chunks, 3, newest_col="uploaded_at"))
    assert [h[:2] for h in got["q"]] == [(2, 0), (2, 1), (1, 0)]


def test_scopes(spark, small):
    chunks = catalog.vector_chunks(spark, small)
    base = [list(map(float, r.embedding)) for r in chunks.orderBy("chunk_index").limit(4).collect()]
    asked = query_table(spark, [("all", "  ", base[0]), ("none", None, base[1]), ("doc", " 3 ", base[2]), ("gone", "77", base[3])])
    registry = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = as_dict(retrieval.scoped_top_k(asked, chunks, registry))

    def allowed(q, c):
        scope = (q.scope or "").strip()
        return c.doc_id == int(scope) if scope else c.doc_id in (1, 2)

    same(got, brute_force(asked.collect(), chunks.collect(), 3, allowed))
    assert "gone" not in got
    assert retrieval.scoped_top_k(asked, chunks, registry.filter("doc_id < 0")).count() == 0


@pytest.mark.parametrize("bound,registered", [(100, [1, 2]), (3, [0, 1, 2, 3, 4, 5, 6, 7]), (3, list(range(10))), (1, [1, 2, 3])])
def test_registered_chunks_by_any_route(spark, small, monkeypatch, bound, registered):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", bound)
    chunks = catalog.vector_chunks(spark, small)
    registry = spark.createDataFrame([(d,) for d in registered], "doc_id long")
    kept = retrieval.registered_chunks(chunks, registry)
    assert kept.count() == chunks.filter(F.col("doc_id").isin(registered)).count()


def test_in_document_prunes_the_scan(spark, small):
    chunks = catalog.vector_chunks(spark, small)
    asked = query_table(spark, [("a", "3", [1.0] * 64)])
    plan = retrieval.top_k_in_document(asked, chunks)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan" in line)
    assert "EqualTo(label,3)" in scan or "In(label, [3])" in scan, scan
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>,label:int>" in scan


def test_no_questions(spark, small):
    chunks = catalog.vector_chunks(spark, small)
    asked = query_table(spark, []).filter("false")
    assert retrieval.top_k(asked, chunks).count() == 0


def test_vectors_of_other_length_are_an_error(spark):
    chunks = chunk_table(spark, [(1, 0, [1.0, 0.0]), (1, 1, [1.0])]).coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        retrieval.top_k(query_table(spark, [("q", None, [1.0, 0.0])]), chunks).collect()


def test_cosine_expression_agrees_with_block_scores(spark, small):
    asked, chunks = catalog.centroid_queries(spark, small), catalog.vector_chunks(spark, small)
    scores = retrieval.cosine_scores(asked, chunks)
    pairs = chunks.join(asked.select(F.col("scope").alias("doc_id"), F.col("embedding").alias("q")), "doc_id")
    again = pairs.select("doc_id", "chunk_index", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("s"))
    both = scores.join(again, ["doc_id", "chunk_index"])
    assert both.count() == scores.count() == chunks.count()
    assert both.filter(F.abs(F.col("s") - F.col("score")) > 1e-6).count() == 0


def test_vector_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(
        vectors.norm(F.col("a")).alias("n"), vectors.unit_vector(F.col("a")).alias("u"),
        vectors.unit_vector(F.col("z")).alias("uz"), vectors.cosine(F.col("a"), F.col("z")).alias("c"),
        vectors.rescale_score(F.lit(-1.0)).alias("r")).first()
    assert row.n == 5.0 and np.allclose(row.u, [0.6, 0.8]) and row.uz is None and row.c is None and row.r == 0.0


def test_embedder_plugin_sees_batches_and_loads_once(spark):
    class Lengths:
        def __call__(self):
            loads = [0]

            def run(texts):
                loads[0] += 1
                assert len(texts) <= 3
                return np.array([[len(t), loads[0]] for t in texts], dtype=float)

            return run

    rows = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id long, text string").coalesce(1)
    got = embedding.embed(rows, model=Lengths(), batch_size=3).orderBy("id").collect()
    assert [r.embedding[0] for r in got] == list(range(10))
    assert [r.embedding[1] for r in got] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4]


def test_hashed_vectors(spark):
    rows = spark.createDataFrame([(1, "Alpha beta ALPHA"), (2, "--"), (3, None)], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in embedding.embed(rows, model=embedding.HashedTerms(64)).collect()}
    assert np.isclose((got[1] ** 2).sum(), 1.0) and np.isclose(got[1].max(), 2 / np.sqrt(5))
    assert not got[2].any() and not got[3].any() and len(got[3]) == 64


def test_prompts_over_a_store_like_table(spark, small):
    docs = catalog.uploads(spark, small)
    from docquarry.plans.ingest import embedded_documents
    chunks = embedded_documents(docs, embedding.HashedTerms(128)).cache()
    asked = catalog.questions(spark, small).withColumn("scope", F.lit(None).cast("string"))
    blank = asked.limit(1).select(F.lit(-1).cast("long").alias("query_id"), F.lit("  ").alias("question"), "scope")
    prompts = ask.prompts_for(asked.unionByName(blank), chunks, docs.select("doc_id"), model=embedding.HashedTerms(128))
    rows = prompts.collect()
    assert len(rows) == asked.count()
    assert all(r.prompt.startswith("Question:\n") and "\n\nContext:\nSource 1 (" in r.prompt for r in rows)
    assert all(r.prompt.count("\n\nSource 3 (") >= 1 for r in rows)
    none = ask.prompts_for(asked, chunks, docs.select("doc_id").filter("false"), model=embedding.HashedTerms(128))
    assert none.count() == 0
    chunks.unpersist()


def test_many_small_batches_per_task(spark, small):
    """The running cut and its floor, with ties across batches."""
    chunks = catalog.vector_chunks(spark, small)
    copies = chunks.unionByName(chunks.withColumn("chunk_index", F.col("chunk_index") + 1_000)).repartition(3)
    asked = chunks.select(F.col("chunk_index").cast("string").alias("query_id"), "embedding")
    want = brute_force(asked.collect(), copies.collect(), 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        same(as_dict(retrieval.top_k(asked, copies, 5)), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_many_scopes_take_the_join(spark, small, monkeypatch):
    chunks = catalog.vector_chunks(spark, small)
    asked = catalog.centroid_queries(spark, small)
    few = as_dict(retrieval.top_k_in_document(asked, chunks))
    monkeypatch.setattr(retrieval, "INLINE_SCOPES", 2)
    assert as_dict(retrieval.top_k_in_document(asked, chunks)) == few and len(few) == 10


def test_repeated_query_ids_do_not_make_a_huge_block(spark, small, monkeypatch):
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 10)
    chunks = catalog.vector_chunks(spark, small)
    asked = spark.range(5_000).select(F.lit("same").alias("query_id"), F.array(*[F.lit(1.0).cast("float")] * 64).alias("embedding"))
    with pytest.raises(ValueError, match="unique"):
        retrieval.top_k(asked, chunks, block_bytes=400_000)


@pytest.mark.parametrize("block_bytes", [1 << 26, 64])
def test_repeated_question_ids_are_refused_at_any_size(spark, block_bytes):
    vector = [1.0, 0.0]
    chunks = spark.createDataFrame([(1, 0, vector)], "doc_id long, chunk_index long, embedding array<double>")
    asked = spark.createDataFrame([(1, vector), (1, vector)], "query_id long, embedding array<double>")
    with pytest.raises(ValueError, match="unique"):
        retrieval.top_k(asked, chunks, block_bytes=block_bytes)


def test_questions_are_embedded_once(spark, tmp_path):
    import uuid

    calls = str(tmp_path)

    @F.pandas_udf("array<double>")
    def model(ids):
        with open(f"{calls}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(len(ids)))
        return ids.map(lambda i: [1.0, float(i)])

    asked = spark.range(3000).coalesce(1).select(F.col("id").alias("query_id"), model("id").alias("embedding"))
    chunks = spark.createDataFrame([(1, 0, [1.0, 0.0])], "doc_id long, chunk_index long, embedding array<double>")
    assert retrieval.top_k(asked, chunks, block_bytes=8_000).count() == 3000
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) <= 3000 + retrieval.FEW_QUERIES + 10_000


def test_scoped_questions_open_their_buckets_only(spark, tmp_path):
    from docquarry.sources import store

    path = str(tmp_path / "store")
    chunks = spark.createDataFrame([(d, 0, [1.0, float(d)]) for d in range(40)], "doc_id long, chunk_index long, embedding array<double>")
    store.save_chunks(chunks, path, 0, buckets=8, gather=True)
    store.save_chunks(chunks, path, 1, gather=True)
    asked = spark.createDataFrame([(1, "7", [1.0, 7.0])], "query_id long, scope string, embedding array<double>")
    found = retrieval.top_k_in_document(asked, store.read_chunks(spark, path), buckets=store.store_buckets(spark, path))
    assert [(r.doc_id, r.score) for r in found.collect()] == [(7, 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "embedding" in line]
    assert scans and all("doc_bucket" in line.split("PartitionFilters: [")[1].split("]")[0] for line in scans)


def test_scoring_a_large_batch_takes_little_more_than_the_batch():
    """A batch of the largest size Spark sends is scored in slices, with the results of one piece."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from docquarry.operators.scoring import BlockScorer, Held

    draw = np.random.default_rng(1)
    vectors = draw.random((10_000, 512), dtype=np.float32)
    asked = draw.random((3, 512), dtype=np.float32)
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * 512), pa.array(m.ravel())) for m in (vectors, asked)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([0] * 10_000), lists[0]], ["doc_id", "chunk_index", "embedding"])
    block = pa.table({"query_id": [0, 1, 2], "scope": pa.array([None] * 3, pa.int64()), "embedding": lists[1]})
    tracemalloc.start()
    found = list(BlockScorer(Held(block), 3, False, [("doc_id", "ascending"), ("chunk_index", "ascending")])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * batch.nbytes
    scores = (asked / np.linalg.norm(asked.astype(float), axis=1)[:, None]) @ (vectors / np.linalg.norm(vectors.astype(float), axis=1)[:, None]).T
    want = [(q, d, round(s[d], 6)) for q, s in enumerate(scores) for d in sorted(range(len(s)), key=lambda d: (-round(s[d], 6), d))[:3]]
    assert [(r["query_id"], r["doc_id"], r["score"]) for b in found for r in b.to_pylist()] == want


def test_vectors_leave_as_they_come(spark, monkeypatch):
    """A worker holds the vectors of one model call, not those of an Arrow batch of many rows."""
    found = []
    monkeypatch.setattr(embedding.F, "arrow_udf", lambda _: lambda f: found.append(f) or (lambda column: column))
    embedding.embed(spark.range(1).select(F.lit("a").alias("text")), batch_size=3)
    assert [len(part) for part in found[0](iter([pa.array(["a b"] * 7), pa.array([], pa.string())]))] == [3, 3, 1]
