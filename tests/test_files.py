import os

import pytest
from pyspark.sql import functions as F

from docquarry.operators import conversations
from docquarry.plans import catalog
from docquarry.sources import files
from docquarry.sources.corpus import read_corpus, read_pages, stream_corpus

TEXTS = "name string, part long, text string"


def contents(path):
    found = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if not name.startswith((".", "_")):
                with open(os.path.join(folder, name), newline="") as file:
                    found[name] = file.read()
    return found


def test_parts_make_whole_files(spark, tmp_path):
    rows = [("b.md", 1, " two"), ("b.md", 0, "one\r\n"), ("a.md", 0, "é\n"), ("empty.txt", 0, None), ("x/../y", 0, "kept apart"), (None, 0, "no name")]
    path = str(tmp_path / "out")
    for _ in range(2):  # a repeated job writes the same files
        files.write_texts(spark.createDataFrame(rows, TEXTS), path, folders=3)
    assert contents(path) == {"b.md": "one\r\n two", "a.md": "é\n", "empty.txt": "", "x%2F..%2Fy": "kept apart"}
    assert sorted(n for n in os.listdir(path) if n.startswith("_")) == ["_SUCCESS"]


def test_a_failed_write_leaves_no_half_file(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = F.when(F.col("id") == 900, F.raise_error(F.lit("stop"))).otherwise(F.lit("x"))
    rows = spark.range(1000).select(F.lit("one.txt").alias("name"), F.col("id").alias("part"), bad.alias("text"))
    with pytest.raises(Exception, match="stop"):
        files.write_texts(rows, path)
    assert contents(path) == {}


def test_pages_of_text_files(spark, tmp_path, monkeypatch):
    long = "".join(f"page {i} \U0001f600 é\n" for i in range(30000))  # characters cut by every block
    texts = {"one.txt": "only", "none.txt": "", "three.txt": "a\f\fc", "ends.txt": "a\f", "long.txt": long + "\f" + "end"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "_hidden").write_text("no")
    pages = files.read_paged_files(spark, str(tmp_path), split_bytes=10).collect()
    found = {}
    for row in sorted(pages, key=lambda r: (r.file_name, r.page)):
        found.setdefault(row.file_name, []).append(row.text)
    assert found == {name: text.split("\f") for name, text in texts.items()}
    assert [r.page for r in sorted(pages, key=lambda r: r.page) if r.file_name == "three.txt"] == [1, 2, 3]
    by_doc = read_pages(spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("n"), F.first("file_name").alias("name")).collect()
    assert {r.name: r.n for r in by_doc} == {name: len(text.split("\f")) for name, text in texts.items()}


def test_no_files_no_pages(spark, tmp_path):
    assert files.read_paged_files(spark, str(tmp_path / "nothing")).collect() == []


def test_one_file_per_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", "x" * 500), (2, 1, "assistant", "y" * 500)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    path = str(tmp_path / "out")
    conversations.write_markdown(conversations.export_markdown(chats, part_bytes=100), path, folders=2)
    head = "# Conversation export\n\n**You:** "
    assert contents(path) == {
        "conversation-1.md": head + "hi\n\n**Assistant:** \n",  # a message without a text keeps its place
        "conversation-2.md": head + "x" * 500 + "\n\n**Assistant:** " + "y" * 500 + "\n",
    }


def test_files_arrive_once_each(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = stream_corpus(spark, str(folder), "u", files_each=2)
        stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(f"text {i}\nmore")
    assert {(r.file_name, r.text) for r in run().collect()} == {(f"{i}.txt", f"text {i}\nmore") for i in range(3)}
    (folder / "late.csv").write_text("a,b")
    seen = run()
    assert seen.count() == 4 and seen.select("batch").distinct().count() == 3
    batch = read_corpus(spark, str(folder), "u")
    assert {r.doc_id for r in batch.collect()} == {r.doc_id for r in seen.collect()}


def test_a_journal_of_files_stands_for_their_list(spark, tmp_path):
    """Files are taken once each, as Spark's own stream takes them, but its source knows the journal's tables alone."""
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"

    def run():
        stream = stream_corpus(spark, str(folder), "u", files_each=40, journal=str(tmp_path / "journal"))
        stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")) \
            .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    (folder / "a" / "b c").mkdir(parents=True)
    (folder / "_hidden").mkdir()
    for i in range(100):
        (folder / ("" if i % 3 else "a") / f"{i}.txt").write_text(f"text {i}\nmore")
    odd = {"x%2F y.txt": "é \U0001f600", "é+[1]#?.md": "a\r\nb", "empty.txt": "", "_no.txt": "no", ".no.txt": "no", "_k=1.txt": "shown"}
    for name, text in odd.items():
        (folder / "a" / "b c" / name).write_text(text, newline="")
    (folder / "_hidden" / "no.txt").write_text("no")
    (folder / "bytes.txt").write_bytes(b"not \xff UTF-8")
    columns = ["doc_id", "file_name", F.to_binary("text", F.lit("utf-8")).alias("text"), "uploaded_at"]
    want = sorted(read_corpus(spark, str(folder), "u").select(*columns).collect())
    seen = run()
    assert sorted(seen.select(*columns).collect()) == want and len(want) == 104
    assert max(r["count"] for r in seen.groupBy("batch").count().collect()) <= 40
    (folder / "a" / "late.csv").write_text("a,b")
    late = run().exceptAll(seen)
    assert [r.file_name for r in late.collect()] == ["late.csv"]
    noted = [line for log in (checkpoint / "sources" / "0").iterdir() if not log.name.startswith(".") for line in log.read_text().splitlines() if "path" in line]
    assert len(noted) < 12  # of 105 files
    assert run().count() == 105


def test_corpus_files_keeps_no_list_of_its_files(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(catalog, "work_dir", lambda *_: str(tmp_path / "work"))
    assert catalog.corpus_files(spark, small).count() == 160  # of 200 files
    noted = [line for log in (tmp_path / "work" / "checkpoint" / "sources" / "0").iterdir() if not log.name.startswith(".")
             for line in log.read_text().splitlines() if "path" in line]
    assert 0 < len(noted) < 20
