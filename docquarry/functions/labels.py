"""Labels and display strings: citations, scores, client ids, error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import trim_text

ANONYMOUS = "anonymous"  # Fixed value: client id when none is forwarded.

# Client-facing error texts.
MISSING_KEY_TEXT = "Missing OPENAI_API_KEY. Add it to .env.local, then restart the dev server."
REJECTED_KEY_TEXT = (
    "OpenAI rejected the configured API key. Replace OPENAI_API_KEY in .env.local with a valid key,"
    " then restart the dev server."
)
QUOTA_TEXT = (
    "OpenAI billing or quota is preventing this request. Check your API billing and usage limits."
)
RATE_LIMIT_TEXT = "OpenAI rate limit reached. Wait a moment and try again."


def has_page(page: Column) -> Column:
    """A page of null or 0 counts as absent."""
    return F.coalesce(page != 0, F.lit(False))


def prompt_location(page: Column, chunk_index: Column) -> Column:
    return F.when(has_page(page), F.concat(F.lit("page "), page.cast("string"))).otherwise(
        F.concat(F.lit("chunk "), (chunk_index + 1).cast("string"))
    )


def display_location(file_name: Column, page: Column, chunk_index: Column) -> Column:
    place = F.when(has_page(page), F.concat(F.lit("Page "), page.cast("string"))).otherwise(
        F.concat(F.lit("Chunk "), (chunk_index + 1).cast("string"))
    )
    prefix = F.when(F.coalesce(file_name, F.lit("")) != "", F.concat(file_name, F.lit(" · ")))
    return F.concat(F.coalesce(prefix, F.lit("")), place)


def display_score(score: Column) -> Column:
    return F.format_string("%.3f", score)


def client_id(forwarded_for: Column) -> Column:
    """First entry of a forwarded-for list; blank or missing means anonymous."""
    first = trim_text(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit(ANONYMOUS))


# What failures are told by.
MISSING_KEY_MARK = "Missing OPENAI_API_KEY"
BAD_KEY_PATTERN = "(?i)incorrect api key|invalid api key"
QUOTA_PATTERN = "(?i)quota|credits|billing"
BAD_KEY_CODE, QUOTA_CODE, RATE_LIMIT_CODE = "invalid_api_key", "insufficient_quota", "rate_limit_exceeded"


def classify_error(message: Column, code: Column, status: Column, fallback: str) -> Column:
    """Struct (error STRING, status BIGINT); the first rule that holds decides."""
    message = F.coalesce(message, F.lit(""))
    code = F.coalesce(code, F.lit(""))
    status = F.coalesce(status, F.lit(-1))

    def answer(text: str, answer_status: int) -> Column:
        return F.struct(F.lit(text).alias("error"), F.lit(answer_status).cast("bigint").alias("status"))

    bad_key = message.rlike(BAD_KEY_PATTERN)
    quota = message.rlike(QUOTA_PATTERN)
    return (
        F.when(message.contains(MISSING_KEY_MARK), answer(MISSING_KEY_TEXT, 500))
        .when((status == 401) | (code == BAD_KEY_CODE) | bad_key, answer(REJECTED_KEY_TEXT, 500))
        .when((code == QUOTA_CODE) | quota, answer(QUOTA_TEXT, 500))
        .when((status == 429) | (code == RATE_LIMIT_CODE), answer(RATE_LIMIT_TEXT, 429))
        .otherwise(answer(fallback, 500))
    )
