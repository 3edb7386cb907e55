import json

from docquarry.operators import conversations as cv
from docquarry.plans import catalog
from docquarry.sources.corpus import read_corpus

TALK = "conv_id long, turn long, role string, text string"


def talk(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)]
    rows += [(2, 0, "assistant", "hello"), (3, 0, "user", "q"), (3, 5, "assistant", "late"), (3, 6, "assistant", "later")]
    return spark.createDataFrame(rows, TALK)


def test_latest_question(spark):
    got = {r.conv_id: r.question for r in cv.latest_question(talk(spark)).collect()}
    assert got == {1: "m6", 2: "", 3: "q"}


def test_latest_sources_counts_an_empty_array(spark):
    rows = [(1, 1, ["a"]), (1, 3, []), (1, 4, None), (2, 0, None), (3, 1, ["x", "y"]), (3, 2, None)]
    got = cv.latest_sources(spark.createDataFrame(rows, "conv_id long, turn long, sources array<string>"))
    assert {r.conv_id: r.sources for r in got.collect()} == {1: [], 2: [], 3: ["x", "y"]}


def test_feedback_pairs_any_block_size(spark, medium):
    want = {(1, 1, "m0"), (1, 3, "m2"), (1, 5, "m4"), (2, 0, ""), (3, 5, "q"), (3, 6, "late")}
    for size in (1, 2, 5, 10_000):
        got = cv.feedback_pairs(talk(spark), large_key_rows=size).collect()
        assert {(r.conv_id, r.turn, r.question) for r in got} == want
    assert cv.feedback_pairs(catalog.chats(spark, medium)).count() == 233


def test_export_parts_make_the_whole(spark, tmp_path):
    lines = [("**You:** " if t % 2 == 0 else "**Assistant:** ") + f"m{t}" for t in range(7)]
    want = "# Conversation export\n\n" + "\n\n".join(lines) + "\n"
    one = {(r.conv_id, r.part): r.markdown for r in cv.export_markdown(talk(spark)).collect()}
    assert one[(1, 0)] == want and set(one) == {(1, 0), (2, 0), (3, 0)}
    parts = cv.export_markdown(talk(spark), part_bytes=60).orderBy("conv_id", "part")
    assert "".join(r.markdown for r in parts.collect() if r.conv_id == 1) == want
    cv.write_markdown(cv.export_markdown(talk(spark)), str(tmp_path / "out"))
    written = {r.file_name: r.text for r in read_corpus(spark, str(tmp_path / "out")).filter("file_name <> '_SUCCESS'").collect()}
    assert written["conversation-1.md"] == want and len(written) == 3


def test_export_file_name(spark):
    row = spark.sql("SELECT timestamp'2024-05-06 23:59:59' AS t").select(cv.export_file_name("t").alias("n")).first()
    assert row.n == "conversation-2024-05-06.md"


def event(name, data):
    return f"event: {name}\ndata: {json.dumps(data, ensure_ascii=False)}"


def stream(spark):
    logs = {
        "good": [event("sources", {"sources": [{"id": "x"}]}), event("delta", {"delta": "a\n"}), event("delta", {"delta": "b"}),
                 event("done", {})],
        "failed": [event("sources", {"sources": []}), event("delta", {"delta": "a"}), event("error", {"error": "one"}),
                   event("error", {"error": "two"})],
        "broken": [event("delta", {"delta": "a"}), "event: delta\ndata: {oops"],
        "separator": ["event: delta\ndata: {\"delta\":\"a b\"}"],
        "empty": [event("sources", {"sources": []}), event("done", {})],
        "garbage": ["hello", "data: {}"],
        "soft": [event("delta", {"delta": "d"}), event("error", {"error": ""})],
        "skips": ["event: delta", "data: {}", "hello", event("other", {"delta": "z"}), "x: 1\n" + event("delta", {"delta": "c"})],
    }
    rows = [(name, i, raw) for name, records in logs.items() for i, raw in enumerate(records)]
    return spark.createDataFrame(rows, "request_id string, seq long, raw string")


def test_replay(spark):
    for size in (1, 10_000):
        answers = cv.replay_answers(stream(spark), part_bytes=size)
        whole = {}
        for r in answers.orderBy("request_id", "part").collect():
            whole[r.request_id] = whole.get(r.request_id, "") + r.answer
        assert whole == {"good": "a\nb", "empty": "", "skips": "c", "garbage": "", "soft": "d"}
    requests = {r.request_id: r for r in cv.replay_requests(stream(spark)).collect()}
    assert json.loads(requests["good"].sources) == [{"id": "x"}]
    assert requests["failed"].error == "two" and requests["failed"].failed
    assert requests["broken"].failed and requests["separator"].failed
    assert requests["skips"].sources is None


def test_parts_count_from_zero_whatever_the_numbers(spark):
    rows = [("r", seq, event("delta", {"delta": "x"})) for seq in (10_500, 20_500, 1_700_000_000_000)]
    log = spark.createDataFrame(rows, "request_id string, seq long, raw string")
    assert [(r.part, r.answer) for r in cv.replay_answers(log).collect()] == [(0, "xxx")]
    assert sorted((r.part, r.answer) for r in cv.replay_answers(log, part_bytes=2).collect()) == [(0, "xx"), (1, "x")]


def test_replayed_messages_keep_the_question(spark):
    asked = spark.createDataFrame([("good", "q1"), ("failed", "q2")], "request_id string, question string")
    rows = cv.replayed_messages(asked, cv.replay_answers(stream(spark)).filter("request_id = 'good'")).collect()
    assert {(r.request_id, r.role, r.text) for r in rows} == {
        ("good", "user", "q1"), ("failed", "user", "q2"), ("good", "assistant", "a\nb")}
