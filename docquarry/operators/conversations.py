"""Chats: latest question, feedback pairs, Markdown export, stream replay.

``messages(conv_id, turn, role, text)`` holds user and assistant rows only;
``chat_messages`` drops anything else first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.json import is_strict_json
from docquarry.operators.prompts import CHAT_ROLES
from docquarry.operators.scans import LARGE_KEY_ROWS, PART_BYTES, all_ordinary, concat_in_order, in_parts, large_keys, previous_row
from docquarry.sources.files import write_texts

# The export's heading, speakers and file name, and the error text of a broken stream.
HEADING = "# Conversation export\n"
YOU, ASSISTANT = "**You:** ", "**Assistant:** "
FILE_NAME = ("conversation-", ".md")
INVALID_DATA_TEXT = "Chat failed."


def chat_messages(messages: DataFrame) -> DataFrame:
    return messages.filter(F.col("role").isin(*CHAT_ROLES))


def latest_question(messages: DataFrame) -> DataFrame:
    """Text of each chat's last user message, '' when it has none."""
    last = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(F.coalesce(last, F.lit("")).alias("question"))


def latest_sources(messages: DataFrame) -> DataFrame:
    """Sources of each chat's last message that has any value, even an empty
    array; an empty array when no message has one."""
    given = F.col("sources").isNotNull()
    last = F.max_by(F.when(given, F.col("sources")), F.when(given, F.col("turn")))
    empty = F.array().cast(messages.schema["sources"].dataType)
    return messages.groupBy("conv_id").agg(F.coalesce(last, empty).alias("sources"))


def feedback_pairs(messages: DataFrame, large_key_rows: int = LARGE_KEY_ROWS) -> DataFrame:
    """Each assistant message with the message directly before it, else ''."""
    said = messages.select("conv_id", "turn", "role", "text")
    large = large_keys(said, ["conv_id"], F.col("turn"), large_key_rows)
    paired = previous_row(said, ["conv_id"], "turn", "_before", large)
    return paired.filter(F.col("role") == "assistant").select(
        "conv_id",
        "turn",
        F.coalesce("_before.text", F.lit("")).alias("question"),
        F.col("text").alias("answer"),
    )


def export_markdown(messages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Markdown of each chat as (conv_id, part, markdown).

    A chat of up to ``part_bytes`` is part 0; the parts of a longer
    one, put together in order, are the whole file. A message without a text keeps its speaker.
    """
    speaker = F.when(F.col("role") == "user", YOU).otherwise(ASSISTANT)
    lines = messages.select("conv_id", "turn", F.concat(F.lit("\n"), speaker, F.coalesce("text", F.lit("")), F.lit("\n")).alias("_line"))
    placed = in_parts(lines, ["conv_id"], "turn", "_line", part_bytes)
    merged = concat_in_order(placed, ["conv_id", "part"], "turn", "_line", "", "markdown")
    heading = F.when(F.col("part") == 0, HEADING).otherwise("")
    return merged.select("conv_id", "part", F.concat(heading, F.col("markdown")).alias("markdown"))


def export_file_name(exported_at):
    """File name of an export made on the given day (UTC session)."""
    return F.concat(F.lit(FILE_NAME[0]), F.date_format(exported_at, "yyyy-MM-dd"), F.lit(FILE_NAME[1]))


def write_markdown(exported: DataFrame, path: str, folders: int = 64) -> None:
    """The exports as files ``conversation-<conv_id>.md`` in ``folders`` hashed folders below ``path``."""
    name = F.concat(F.lit(FILE_NAME[0]), F.col("conv_id").cast("string"), F.lit(FILE_NAME[1]))
    write_texts(exported.select(name.alias("name"), "part", F.col("markdown").alias("text")), path, folders)


# A line ends at any of these characters; the class spells out what "." and
# "$" mean to the client that reads the stream.
_LINE = r"[^\n\r\u2028\u2029]+"
_EVENT = rf"(?:^|[\n\r\u2028\u2029])event: ({_LINE})"
_DATA = rf"(?:^|[\n\r\u2028\u2029])data: ({_LINE})"


def parse_stream_log(log: DataFrame) -> DataFrame:
    """(request_id, seq, event, data); both are null for a record without both lines."""
    event, data = F.regexp_extract("raw", _EVENT, 1), F.regexp_extract("raw", _DATA, 1)
    usable = (event != "") & (data != "")
    return log.select("request_id", "seq", F.when(usable, event).alias("event"), F.when(usable, data).alias("data"))


def replay_requests(log: DataFrame) -> DataFrame:
    """One row per request: ``failed``, ``error``, ``sources`` (JSON), ``deltas``.

    The last sources and the last error win; an error without a text fails nothing. A
    record whose data is not JSON fails the request where it stands, as a reader would. A request of unusable
    records alone has an empty answer.
    """
    summary = _events(log).groupBy("request_id").agg(*_outcome())
    return summary.select("request_id", *_told(), "sources", "deltas")


def _events(log: DataFrame) -> DataFrame:
    return parse_stream_log(log).withColumn("_valid", F.when(F.col("data").isNotNull(), is_strict_json(F.col("data"))))


def _outcome() -> list[Column]:
    """Aggregates over a request's events that tell how it ended."""
    is_error = F.col("_valid") & (F.col("event") == "error")
    is_sources = F.col("_valid") & (F.col("event") == "sources")
    text = F.coalesce(F.get_json_object("data", "$.error"), F.lit(""))
    return [
        F.coalesce(F.bool_or(~F.col("_valid")), F.lit(False)).alias("_broken"),
        F.coalesce(F.max_by(F.when(is_error, text), F.when(is_error, F.col("seq"))), F.lit("")).alias("_text"),
        F.max_by(F.when(is_sources, F.get_json_object("data", "$.sources")),
                 F.when(is_sources, F.col("seq"))).alias("sources"),
        F.count_if(F.col("_valid") & (F.col("event") == "delta")).alias("deltas"),
    ]


def _told() -> list[Column]:
    return [
        (F.col("_broken") | (F.col("_text") != "")).alias("failed"),
        F.when(F.col("_broken"), INVALID_DATA_TEXT).when(F.col("_text") != "", F.col("_text")).alias("error"),
    ]


def replay_answers(log: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(request_id, part, answer, sources) of the requests that did not fail.

    Deltas are joined in order; an answer of up to ``part_bytes`` is part 0, and
    longer ones go on in the next parts. A request without deltas still gives
    one empty part.

    If every request's log is below ``part_bytes``, one aggregate gives outcome and answer; else answers are placed in parts.
    """
    if all_ordinary(log, ["request_id"], "raw", part_bytes):
        is_delta = F.col("_valid") & (F.col("event") == "delta")
        delta = F.when(is_delta, F.struct("seq", F.coalesce(F.get_json_object("data", "$.delta"), F.lit("")).alias("text")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(delta)), lambda d: d["text"]), "")
        whole = _events(log).groupBy("request_id").agg(*_outcome(), joined.alias("answer"))
        return whole.filter(~_told()[0]).select("request_id", F.lit(0).cast("bigint").alias("part"), "answer", "sources")
    deltas = (
        parse_stream_log(log)
        .filter(F.col("event") == "delta")
        .select("request_id", "seq", F.coalesce(F.get_json_object("data", "$.delta"), F.lit("")).alias("_delta"))
    )
    placed = in_parts(deltas, ["request_id"], "seq", "_delta", part_bytes)
    parts = concat_in_order(placed, ["request_id", "part"], "seq", "_delta", "", "answer")
    good = replay_requests(log).filter(~F.col("failed"))
    told = parts.join(good.select("request_id", "sources"), "request_id")
    silent = good.filter(F.col("deltas") == 0).select(
        "request_id", F.lit(0).cast("bigint").alias("part"), F.lit("").alias("answer"), "sources"
    )
    return told.unionByName(silent)


def replayed_messages(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Messages a client shows: the user's always, the assistant's on success."""
    asked = requests.select("request_id", F.lit("user").alias("role"), F.lit(0).cast("bigint").alias("part"),
                            F.col("question").alias("text"))
    told = answers.select("request_id", F.lit("assistant").alias("role"), "part", F.col("answer").alias("text"))
    return asked.unionByName(told)
