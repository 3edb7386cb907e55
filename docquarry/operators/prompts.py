"""Questions, histories and hits to the message list of a chat model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.labels import prompt_location
from docquarry.functions.text import is_blank, trim_text
from docquarry.operators.retrieval import has_document

# The system prompt and the history length (turns of two messages).
SYSTEM_PROMPT = (
    "You are a document question-answering assistant. Answer only from the provided context. "
    "Do not use outside knowledge. If the answer is not in the context, clearly say you could not find it "
    "in the uploaded document. Prior conversation turns are provided for follow-up context only — keep "
    "grounding every answer in the supplied document context."
)
HISTORY_TURNS = 6
CHAT_ROLES = ("user", "assistant")

# Texts for requests that cannot be answered.
NO_QUESTION_TEXT = "Please enter a question."
NO_DOCUMENT_TEXT = "Upload a document before asking a question."


def validate_questions(questions: DataFrame, registry: DataFrame | None = None, text_col: str = "question") -> DataFrame:
    """Trim the question and set ``error``: null when it can be answered."""
    error = F.when(is_blank(F.col(text_col)), NO_QUESTION_TEXT)
    if registry is not None:
        error = error.when(~has_document(registry), NO_DOCUMENT_TEXT)
    return questions.withColumn("error", error).withColumn(
        text_col, F.coalesce(trim_text(F.col(text_col)), F.lit(""))
    )


def answerable(questions: DataFrame) -> DataFrame:
    return questions.filter(F.col("error").isNull()).drop("error")


def build_context(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, context): numbered sources in rank order; '' without hits.

    ``sources`` holds at most k rows per question.
    """
    location = prompt_location(F.col("page"), F.col("chunk_index"))
    line = F.concat(
        F.lit("Source "), F.col("rank").cast("string"), F.lit(" ("), F.col("file_name"), F.lit(", "), location,
        F.lit("):\n"), F.col("text"),
    )
    joined = F.expr(r"listagg(_line, '\n\n') within group (order by rank)")
    contexts = sources.withColumn("_line", line).groupBy("query_id").agg(joined.alias("context"))
    return (
        questions.select("query_id")
        .join(contexts, "query_id", "left")
        .select("query_id", F.coalesce("context", F.lit("")).alias("context"))
    )


def build_prompt(questions: DataFrame, contexts: DataFrame, text_col: str = "question") -> DataFrame:
    """(query_id, prompt) from the trimmed question and its context."""
    prompt = F.concat(F.lit("Question:\n"), F.col(text_col), F.lit("\n\nContext:\n"), F.col("context"))
    return questions.select("query_id", text_col).join(contexts, "query_id").select("query_id", prompt.alias("prompt"))


def history_window(messages: DataFrame, max_messages: int = HISTORY_TURNS * 2, conv_col: str = "conv_id") -> DataFrame:
    """The last ``max_messages`` user/assistant messages with text, per chat.

    The filter comes before the cut. The rank limit is applied to each input
    partition before the shuffle, so a very long chat sends few rows.
    """
    usable = messages.filter(F.col("role").isin(*CHAT_ROLES) & ~is_blank(F.col("text")))
    place = F.row_number().over(Window.partitionBy(conv_col).orderBy(F.desc("turn")))
    return usable.withColumn("_place", place).filter(F.col("_place") <= max_messages).drop("_place")


def message_list(prompts: DataFrame, history: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per message: system first, history in turn order, prompt last.

    ``prompts(conv_id, prompt)`` has one request per chat; ``history`` is the
    cut history, so the ordering window is over a bounded group.
    """
    head = prompts.select(conv_col, F.lit(0).alias("_part"), F.lit(0).cast("bigint").alias("turn"),
                          F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content"))
    body = history.join(prompts.select(conv_col), conv_col, "left_semi").select(
        conv_col, F.lit(1).alias("_part"), F.col("turn").cast("bigint").alias("turn"), "role",
        F.col("text").alias("content"))
    tail = prompts.select(conv_col, F.lit(2).alias("_part"), F.lit(0).cast("bigint").alias("turn"),
                          F.lit("user").alias("role"), F.col("prompt").alias("content"))
    place = F.row_number().over(Window.partitionBy(conv_col).orderBy("_part", "turn"))
    return head.unionByName(body).unionByName(tail).select(
        conv_col, place.cast("bigint").alias("position"), "role", "content"
    )


def message_arrays(messages: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``message_list`` folded to one ARRAY<STRUCT<role, content>> per request."""
    items = F.array_sort(F.collect_list(F.struct("position", "role", "content")))
    return messages.groupBy(conv_col).agg(
        F.transform(items, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )
