"""Narrow tables on shared storage, read inside tasks.

What every task needs a part of, and no node should hold whole, is written by Spark
as one Parquet file per part; tasks open the parts they need. Vectors then meet
such a table where they are read, without a shuffle and without a broadcast that grows with the data.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.session import work_dir

HELD_PARTS = 4  # parts a task keeps open


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, as Spark lists it, and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class SharedParts:
    """A table split by a whole number, one file per part."""

    def __init__(self, files: dict[int, list[str]]):
        self.files = files
        self.held: OrderedDict[int, pa.Table] = OrderedDict()

    def part(self, number: int) -> pa.Table | None:
        """The rows of one part, None if it has none."""
        if number not in self.files:
            return None
        if number not in self.held:
            tables = []
            for uri in self.files[number]:
                files, path = opened(uri)
                with files.open_input_file(path) as file:
                    tables.append(pq.ParquetFile(file).read())
            self.held[number] = pa.concat_tables(tables)
            if len(self.held) > HELD_PARTS:
                self.held.popitem(last=False)
        self.held.move_to_end(number)
        return self.held[number]

    def __getstate__(self) -> dict:
        return {"files": self.files, "held": OrderedDict()}


def write_parts(df: DataFrame, part: Column, label: str) -> tuple[SharedParts, DataFrame] | None:
    """``df`` as parts, and the written table with its column ``_part``; None where tasks cannot open the shared folder themselves."""
    path = work_dir(df.sparkSession, label)
    df.withColumn("_part", part.cast("int")).repartition("_part").write.partitionBy("_part").parquet(path)
    # the schema is given, as a table without rows has no file to tell it
    written = df.sparkSession.read.schema(", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "_part int"])).parquet(path)
    files: dict[int, list[str]] = {}
    for uri in sorted(written.inputFiles()):
        files.setdefault(int(re.search(r"/_part=(\d+)/", uri).group(1)), []).append(uri)
    try:
        for uris in list(files.values())[:1]:
            opened(uris[0])[0].get_file_info(opened(uris[0])[1])
    except (pa.ArrowException, ImportError, OSError):
        return None
    return SharedParts(files), written


def _marked(parts: SharedParts, on: list[str], keep: bool):
    """Rows whose ``on`` columns are in the part of their ``_part`` (keep), or are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([False] * batch.num_rows)
            # one stored file holds one bucket and one batch, so these are few
            groups = pa.table({c: batch.column(c) for c in ["_part", *on[1:]]}).group_by(["_part", *on[1:]]).aggregate([]).to_pylist()
            for group in groups:
                known = parts.part(group["_part"])
                if known is not None:
                    inside = pa.array([True] * batch.num_rows)
                    for column, value in group.items():
                        inside = pc.and_(inside, pc.equal(batch.column(column), value))
                    for column in on[1:]:
                        known = known.filter(pc.equal(known.column(column), group[column]))
                    found = pc.or_(found, pc.and_(inside, pc.is_in(batch.column(on[0]), value_set=known.column(on[0]).combine_chunks())))
            found = pc.fill_null(found, False)
            yield batch.filter(found if keep else pc.invert(found)).drop_columns(["_part"])

    return run


def filtered_by_parts(rows: DataFrame, keys: DataFrame, on: list[str], part: Column, keep: bool) -> DataFrame | None:
    """Semi (``keep``) or anti join of ``rows`` with narrow ``keys`` without an exchange of rows.

    ``part`` says, of both tables alike, which part of the keys a row has to meet; ``rows`` should come
    ordered by it, as files of a store do. None where tasks cannot open the shared folder.
    """
    written = write_parts(keys.select(*on).distinct().filter(part.isNotNull()), part, "keys")
    if written is None:
        return None
    return rows.withColumn("_part", part.cast("int")).mapInArrow(_marked(written[0], on, keep), rows.schema)
