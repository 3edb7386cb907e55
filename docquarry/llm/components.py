"""Connected components of a table of links, with joins only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.tables import kept


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one partition as stars around the smallest node of each part,
    holding at most one million nodes at a time."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in parent]
        pairs = [p for p in pairs if p[0] != p[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield stars()
    yield stars()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(u, v): every linked node except the smallest of its component, and that smallest node.

    ``links`` is (u long, v long); loops and repeats do no harm. Each partition
    first reduces its links to a forest. Then large-star and small-star rounds
    (Kiveris et al., 2014) run until nothing changes; each round is written to
    the shared folder. Links with a null end are dropped.
    """
    links = links.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    now = kept(links.mapInArrow(_forest, "u long, v long").distinct(), label)
    while True:
        # stars already: no node is both an end and a centre, and no end has two centres
        ends = now.groupBy("u").agg(F.count("*").alias("n"))
        centres = now.select(F.col("v").alias("u")).distinct()
        loose = ends.join(centres.withColumn("c", F.lit(1)), "u", "left").filter("n > 1 OR c = 1").limit(1)
        if loose.isEmpty():
            return now
        now = kept(_small_star(_large_star(now)), label)
