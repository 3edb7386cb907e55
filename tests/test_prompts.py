from pyspark.sql import functions as F

from docquarry.functions import labels
from docquarry.operators import highlights, prompts, retrieval
from docquarry.plans import catalog
from docquarry.sources.corpus import read_table


def test_citation_labels(spark):
    rows = spark.createDataFrame([(None, 0, "f"), (3, 0, ""), (0, 1, None)], "page long, i long, name string")
    got = rows.select(labels.prompt_location(F.col("page"), F.col("i")).alias("p"),
                      labels.display_location(F.col("name"), F.col("page"), F.col("i")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("chunk 1", "f · Chunk 1"), ("page 3", "Page 3"), ("chunk 2", "Chunk 2")]


def test_source_defaults(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, 7, None, None, None, None)],
                                 "query_id long, rank long, score double, doc_id long, chunk_index long, text string,"
                                 " file_name string, page long")
    row = retrieval.source_rows(hits).first()
    assert (row.chunk_id, row.text, row.chunk_index, row.file_name, row.page) == ("chunk-0", "", 0, "", None)


def test_context_and_prompt(spark):
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, question string")
    sources = spark.createDataFrame(
        [(1, 2, "b", 4, "f.txt", None), (1, 1, "a", 0, "g.pdf", 3)],
        "query_id long, rank long, text string, chunk_index long, file_name string, page long")
    contexts = prompts.build_context(asked, sources)
    built = {r.query_id: r.prompt for r in prompts.build_prompt(asked, contexts).collect()}
    assert built == {
        1: "Question:\nwhy?\n\nContext:\nSource 1 (g.pdf, page 3):\na\n\nSource 2 (f.txt, chunk 5):\nb",
        2: "Question:\nhow?\n\nContext:\n",
    }


def test_history_filter_comes_before_the_cut(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(20)]
    rows[18] = (1, 18, "user", " \n")
    rows[17] = (1, 17, "tool", "x")
    rows.append((2, 0, "user", "only"))
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prompts.history_window(talk).orderBy("conv_id", "turn").collect()
    assert [r.turn for r in got if r.conv_id == 1] == [*range(6, 17), 19]
    assert [r.text for r in got if r.conv_id == 2] == ["only"]


def test_history_golden(spark, medium):
    talk = read_table(spark, medium, "conversations")
    assert prompts.history_window(talk, 4).count() == 362
    assert prompts.history_window(talk).count() == 512


def test_message_list(spark):
    asked = spark.createDataFrame([(1, "p1"), (2, "p2")], "conv_id long, prompt string")
    history = spark.createDataFrame([(1, 5, "assistant", "b"), (1, 4, "user", "a"), (3, 0, "user", "z")],
                                    "conv_id long, turn long, role string, text string")
    rows = prompts.message_list(asked, history)
    got = [(r.conv_id, r.position, r.role, r.content) for r in rows.orderBy("conv_id", "position").collect()]
    system = prompts.SYSTEM_PROMPT
    assert got == [(1, 1, "system", system), (1, 2, "user", "a"), (1, 3, "assistant", "b"), (1, 4, "user", "p1"),
                   (2, 1, "system", system), (2, 2, "user", "p2")]
    arrays = {r.conv_id: [m.content for m in r.messages] for r in prompts.message_arrays(rows).collect()}
    assert arrays == {1: [system, "a", "b", "p1"], 2: [system, "p2"]}


def test_validation(spark):
    asked = spark.createDataFrame([(1, " why? "), (2, " \n"), (3, None)], "query_id long, question string")
    some = spark.createDataFrame([(1,)], "doc_id long")
    with_docs = {r.query_id: (r.question, r.error) for r in prompts.validate_questions(asked, some).collect()}
    assert with_docs == {1: ("why?", None), 2: ("", prompts.NO_QUESTION_TEXT), 3: ("", prompts.NO_QUESTION_TEXT)}
    without = {r.query_id: r.error for r in prompts.validate_questions(asked, some.filter("false")).collect()}
    assert without[1] == prompts.NO_DOCUMENT_TEXT and without[2] == prompts.NO_QUESTION_TEXT


def terms(spark, question):
    return spark.createDataFrame([(question,)], "q string").select(highlights.highlight_terms(F.col("q")).alias("t")).first().t


def test_highlight_terms(spark, medium):
    assert terms(spark, "What is the MAIN total of total revenue-2024?") == ["total", "revenue", "2024"]
    assert terms(spark, "a b c") == [] and terms(spark, None) == []
    assert terms(spark, "préparation") == ["paration"]
    assert terms(spark, " ".join(f"word{i}" for i in range(12))) == [f"word{i}" for i in range(8)]
    asked = catalog.questions(spark, medium).select(F.size(highlights.highlight_terms(F.col("question"))).alias("n"))
    assert [r.n for r in asked.distinct().collect()] == [8] and asked.count() == 40


def test_highlight_text(spark):
    rows = spark.createDataFrame(
        [("Revenues rose", ["revenue"]), ("abcd abcdef", ["abcd", "abcdef"]), ("abcdef", ["abcdef", "abcd"]), ("$1 x", [])],
        "text string, terms array<string>")
    got = [r.m for r in rows.select(highlights.highlight_text(F.col("text"), F.col("terms")).alias("m")).collect()]
    assert got == ["<mark>Revenue</mark>s rose", "<mark>abcd</mark> <mark>abcd</mark>ef", "<mark>abcdef</mark>", "$1 x"]


def test_score_display(spark):
    assert spark.range(1).select(labels.display_score(F.lit(0.98765)).alias("s")).first().s == "0.988"
