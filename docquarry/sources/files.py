"""Text files as Spark data sources: whole texts out, page-broken texts in.

``text_files`` writes rows (name, part, text) as one file per name, in hashed
folders. A task writes a file under a temporary name and gives it its own when it
is whole, so a retried or twin task leaves no half-written file, and the
same content at last. ``paged_text`` reads files whose pages end at form feeds, a page a row; large
files are read in blocks and never held whole.

Paths are URIs that pyarrow opens; without a scheme, local ones.
"""

from __future__ import annotations

import codecs
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from docquarry.sources.shared import opened

PAGE_BREAK = "\f"
READ_BYTES = 1 << 20  # read at a time
SPLIT_BYTES = 64 << 20  # of small files in one task
PAGES_EACH = 1000  # rows of a batch, at most
FOLDERS = 64


# --- writing --------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    files: int


class TextFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, folders: int):
        self.path, self.folders = path, folders
        self.waiting = f"_writing-{uuid.uuid4().hex}"  # of this job

    def _target(self, name: str) -> str:
        folder = int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") % self.folders
        return f"{folder:04d}/{quote(name, safe=' ()+,@')}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Rows of one name come together and in order of their parts."""
        files, root = opened(self.path)
        files.create_dir(f"{root}/{self.waiting}", recursive=True)
        count, name, out, draft = 0, None, None, None

        def finish() -> None:
            nonlocal count
            if out is not None:
                out.close()
                target = f"{root}/{self._target(name)}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                files.move(draft, target)
                count += 1

        for batch in iterator:
            for row_name, text in ((n.as_py(), t.as_py()) for n, t in zip(batch.column("name"), batch.column("text"))):
                if row_name is None:
                    continue
                if row_name != name:
                    finish()
                    name, draft = row_name, f"{root}/{self.waiting}/{uuid.uuid4().hex}"
                    out = files.open_output_stream(draft)
                out.write((text or "").encode())
        finish()
        return Written(count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = opened(self.path)
        files.create_dir(root, recursive=True)
        self._clear(files, root)
        with files.open_output_stream(f"{root}/_SUCCESS") as done:
            done.write(b"")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, files: fs.FileSystem, root: str) -> None:
        if files.get_file_info(f"{root}/{self.waiting}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.waiting}")


class TextFiles(DataSource):
    """The sink: ``format("text_files")`` with options path and folders."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, part bigint, text string"

    def writer(self, schema, overwrite: bool) -> TextFilesWriter:
        return TextFilesWriter(self.options["path"], int(self.options.get("folders", FOLDERS)))


def write_texts(texts: DataFrame, path: str, folders: int = FOLDERS) -> None:
    """``texts(name, part, text)`` as files; the parts of a name follow each other in its file. Rows without a name
    are left out, a null text is empty, and files of other names stay."""
    spark = texts.sparkSession
    spark.dataSource.register(TextFiles)
    rows = texts.filter("name IS NOT NULL").select(F.col("name").cast("string").alias("name"), F.col("part").cast("bigint").alias("part"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition(F.xxhash64("name")).sortWithinPartitions("name", "part")
    ordered.write.format("text_files").option("folders", str(folders)).mode("append").save(path)


# --- reading --------------------------------------------------------------------

@dataclass
class Files(InputPartition):
    paths: list[str]


class PagedTextReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Files]:
        """Files in groups of about ``split_bytes``, a larger one alone; names beginning with _ or . are not read."""
        files, root = opened(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        shown = sorted((f.path, f.size) for f in found if f.is_file and not any(p[:1] in "_." for p in f.path[len(root) :].strip("/").split("/")))
        groups: list[Files] = []
        size = self.split_bytes
        for path, length in shown:
            if size + length > self.split_bytes:
                groups.append(Files([]))
                size = 0
            groups[-1].paths.append(path)
            size += length
        return groups or [Files([])]

    def _texts(self, files: fs.FileSystem, path: str) -> Iterator[str]:
        """The pages of one file; what is not UTF-8 becomes U+FFFD."""
        decoder, page = codecs.getincrementaldecoder("utf-8")("replace"), []
        with files.open_input_stream(path) as source:
            while True:
                raw = source.read(READ_BYTES)
                pieces = decoder.decode(raw, final=not raw).split(PAGE_BREAK)
                for piece in pieces[:-1]:
                    yield "".join([*page, piece])
                    page = []
                page.append(pieces[-1])
                if not raw:
                    yield "".join(page)
                    return

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        for path in partition.paths:
            rows: list[tuple[int, str]] = []
            size = 0
            for number, text in enumerate(self._texts(files, path), 1):
                rows.append((number, text))
                size += len(text)
                if len(rows) >= PAGES_EACH or size >= READ_BYTES:
                    yield self._batch(path, rows)
                    rows, size = [], 0
            if rows:
                yield self._batch(path, rows)

    def _batch(self, path: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        columns = [pa.array([path] * len(rows)), pa.array([path.rsplit("/", 1)[-1]] * len(rows)),
                   pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "file_name", "page", "text"])


class PagedText(DataSource):
    """The source: ``format("paged_text")`` with options path and split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "paged_text"

    def schema(self) -> str:
        return "path string, file_name string, page bigint, text string"

    def reader(self, schema) -> PagedTextReader:
        return PagedTextReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))


def read_paged_files(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, file_name, page, text) of all files below ``path``: pages from 1, divided by form feeds.

    A file without any is one page, an empty one is one empty page.
    """
    spark.dataSource.register(PagedText)
    return spark.read.format("paged_text").option("split_bytes", str(split_bytes)).load(path)
