"""A journal of the files below a folder, for streams of very many files.

Spark's own stream of files keeps the path of every file it has seen, and the status of every file it lists, in the driver. Here
tasks list the folders, level by level, and files not noted before are written to the journal, a folder of
Parquet tables with a row a file. A stream takes one table after the other and its tasks
open the files, so that the driver knows tables, each of which stands for many files.

The journal belongs to the folder, as a checkpoint belongs to a stream: keep it, and let one process at a time add to it. Streams with checkpoints
of their own may share it. Paths are URIs that pyarrow opens; without a scheme, local ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import work_dir
from docquarry.sources.shared import opened

BATCH_BYTES = 512 << 20  # of files in a micro-batch
SEND_BYTES = 1 << 20  # of texts in a batch of rows
SEND_ROWS = 1000
ENTRY = "path string, size bigint, modified_ms bigint"
TEXT = "file_path string, file_name string, modified_ms bigint, value binary"


def can_open(path: str) -> bool:
    """Whether pyarrow knows the scheme of a path."""
    try:
        opened(path)
    except (pa.ArrowException, ImportError, OSError):
        return False
    return True


def _shown(name: str) -> bool:
    """What Spark reads: neither hidden files nor those still being copied."""
    return not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))


def _lister(root: str):
    """Rows of what lies in each folder, not deeper."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = opened(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                found = [f for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if _shown(f.base_name)]
                for at in range(0, len(found), SEND_ROWS):
                    some = found[at : at + SEND_ROWS]
                    times = [None if f.mtime_ns is None else f.mtime_ns // 1_000_000 for f in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f.path for f in some], pa.string()), pa.array([f.size for f in some], pa.int64()),
                         pa.array(times, pa.int64()), pa.array([f.type == fs.FileType.Directory for f in some], pa.bool_())],
                        ["path", "size", "modified_ms", "folder"])

    return run


def _files_below(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """The files below ``path`` as entries, found level by level by tasks that list a folder each."""
    schema = f"{ENTRY}, folder boolean"
    level, levels = spark.createDataFrame([(opened(path)[1],)], "path string"), []
    while not levels or not level.isEmpty():
        found = f"{scratch}/level={len(levels)}"
        level.repartition(_tasks(spark)).mapInArrow(_lister(path), schema).write.parquet(found)
        levels.append(found)
        level = spark.read.schema(schema).parquet(found).filter("folder").select("path")
    return spark.read.schema(schema).parquet(*levels).filter("NOT folder").drop("folder")


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def note_files(spark: SparkSession, path: str, journal: str, files_each: int | None = None, batch_bytes: int = BATCH_BYTES) -> None:
    """Add the files below ``path`` that the journal does not have yet, in tables of about ``batch_bytes`` of files and at most ``files_each``.

    A journal that was written in part, by a job that failed, is completed.
    """
    folders, target = _folder(spark, journal)
    folders.mkdirs(target)
    scratch = work_dir(spark, "listing")
    try:
        new = _files_below(spark, path, scratch)
        new = new.join(spark.read.schema(ENTRY).parquet(journal).select("path"), "path", "left_anti")
        count, size = new.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        if count:
            tables = max(-(-size // batch_bytes), -(-count // files_each) if files_each else 1)
            new.select("path", "size", "modified_ms").repartition(tables).write.option("maxRecordsPerFile", files_each or 0).mode("append").parquet(journal)
    finally:
        folders, target = _folder(spark, scratch)
        folders.delete(target, True)


def _reader(path: str, uri: str):
    """The bytes of the files of entries, with their names as Spark gives them; as there, a file that is empty or gone is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        rows: list[tuple] = []
        size = 0

        def sent() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file_path", "file_name", "modified_ms", "value"])

        for batch in batches:
            for entry in batch.select(["path", "modified_ms"]).to_pylist():
                try:
                    with files.open_input_stream(entry["path"]) as source:
                        value = source.read()
                except FileNotFoundError:
                    continue
                if not value:
                    continue
                below = entry["path"][len(root.rstrip("/")) :]
                rows.append((uri + _quoted(below), _quoted(below.rsplit("/", 1)[-1]), entry["modified_ms"], value))
                size += len(value)
                if size >= SEND_BYTES or len(rows) >= SEND_ROWS:
                    yield sent()
                    rows, size = [], 0
        if rows:
            yield sent()

    return run


def _quoted(path: str) -> str:
    """As Java's URI quotes a path: letters of all scripts stay."""
    return re.sub(r"[^\w/\-.!~'()*,;:$&+=@]", lambda m: m[0] if ord(m[0]) > 0x9F and not m[0].isspace() else quote(m[0], safe=""), path)


def stream_files(spark: SparkSession, path: str, journal: str) -> DataFrame:
    """(file_path, file_name, modified_ms, value) of the files that the journal notes, a table of it in a micro-batch."""
    folders, target = _folder(spark, path)
    uri = folders.makeQualified(target).toUri().toString().rstrip("/")
    uri = re.sub(r"^file:/+", "file:/", uri)
    entries = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).parquet(journal)
    return entries.repartition(_tasks(spark)).mapInArrow(_reader(path, uri), TEXT)
