"""Questions to prompts over a table of embedded chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docquarry.operators.chunking import chunk_text
from docquarry.operators.embedding import ModelFactory, embed
from docquarry.operators.prompts import answerable, build_context, build_prompt, validate_questions
from docquarry.operators.retrieval import DEFAULT_K, attach_text, hint_small, scoped_top_k, source_rows, top_k
from docquarry.session import spread


def embed_questions(questions: DataFrame, model: ModelFactory | None = None) -> DataFrame:
    """``questions(query_id, question[, scope])`` with their vectors."""
    return embed(questions, text_col="question", model=model)


def find_sources(
    questions: DataFrame,
    chunks: DataFrame,
    texts: DataFrame | None = None,
    registry: DataFrame | None = None,
    k: int = DEFAULT_K,
    model: ModelFactory | None = None,
    newest_col: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Source rows of each question.

    ``chunks`` needs ids and vectors only; ``texts`` (default: the same table)
    supplies text, file name and page of the few chunks that were found. With a
    ``registry`` each question is answered in its own scope. Equal scores go to the newest document by ``newest_col``;
    ``buckets`` is the bucket count of the store the chunks come from.
    """
    options = {"newest_col": newest_col, "buckets": buckets}
    asked = embed_questions(questions, model)
    hits = top_k(asked, chunks, k, **options) if registry is None else scoped_top_k(asked, chunks, registry, k, **options)
    return source_rows(attach_text(hits, chunks if texts is None else texts, questions.count() * k))


def find_sources_in_documents(
    questions: DataFrame,
    docs: DataFrame,
    k: int = DEFAULT_K,
    model: ModelFactory | None = None,
) -> DataFrame:
    """The same over documents that have no store yet.

    All documents are chunked and embedded for ranking; only those that were
    hit are chunked once more for their texts.
    """
    hits = top_k(embed_questions(questions, model), embed(chunk_text(spread(docs.select("doc_id", "text"))), model=model), k)
    at_most = questions.count() * k
    hit_docs = hint_small(hits.select("doc_id").distinct(), at_most)
    texts = chunk_text(docs.join(hit_docs, "doc_id", "left_semi"))
    return source_rows(attach_text(hits, texts, at_most))


def prompts_for(
    questions: DataFrame,
    chunks: DataFrame,
    registry: DataFrame | None = None,
    k: int = DEFAULT_K,
    model: ModelFactory | None = None,
    newest_col: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """(query_id, prompt) for every question that can be answered."""
    valid = answerable(validate_questions(questions, registry))
    sources = find_sources(valid, chunks, registry=registry, k=k, model=model, newest_col=newest_col, buckets=buckets)
    return build_prompt(valid, build_context(valid, sources))
