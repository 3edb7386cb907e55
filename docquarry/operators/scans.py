"""Ordered work per key - running totals, previous rows - when one key may
hold most of the rows.

A window partitioned by the key sends a key to one task. That is the best plan
for ordinary keys, and it is used as long as no key is large. Keys found to be
large are cut into blocks along the row order. One shuffle on (key, block)
lets every block compute its own values. Blocks of large keys are also summed
up before any shuffle, to one row each; these carry over from block to block
and are joined on, which reuses the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LARGE_KEY_ROWS = 500_000  # rows one task orders without holding up the others
BLOCKS_PER_LARGE_KEY = 8  # at least; larger keys get more, of this share
MOST_BLOCKS = 1024  # of one key
MOST_CUTS = 4_000_000  # of all keys; a log has one large key per LARGE_KEY_ROWS rows at most
PART_BYTES = 64 * 1024 * 1024  # of one concatenated text


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Equality on keys of two aliased tables, null being a key like any other."""
    return [F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) for key in keys]


def large_keys(
    df: DataFrame, keys: Sequence[str], position: Column, large_key_rows: int = LARGE_KEY_ROWS
) -> DataFrame | None:
    """Large keys as (keys, _cuts): the positions where their blocks begin, so
    that each block holds about the same number of rows wherever the rows lie.
    None when no key is large.

    One pre-aggregated job counts keys; a second takes quantiles of the positions
    of large keys only. There is at most one large key per ``large_key_rows``
    rows, and cuts per key shrink as keys get more, so the result may be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > large_key_rows)
    heavy = counts.collect()
    if not heavy:
        return None
    spark = df.sparkSession
    blocks = BLOCKS_PER_LARGE_KEY
    while blocks < MOST_BLOCKS and 2 * blocks * len(heavy) <= MOST_CUTS:
        blocks *= 2
    share = large_key_rows / BLOCKS_PER_LARGE_KEY
    wanted = F.least(F.greatest(F.ceil(F.col("_rows") / F.lit(share)), F.lit(BLOCKS_PER_LARGE_KEY)), F.lit(blocks)).cast("int")
    points = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    placed = df.select(*keys, position.cast("bigint").alias("_position")).alias("l").join(
        F.broadcast(spark.createDataFrame(heavy, counts.schema)).alias("r"), _same(df, counts, keys)
    )
    cuts = placed.groupBy(*[F.col(f"l.{key}").alias(key) for key in keys], "_rows").agg(
        F.percentile_approx("_position", points, F.lit(20 * blocks)).alias("_all"))
    chosen = F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.get("_all", F.floor(i * blocks / wanted).cast("int") - 1))
    found = cuts.select(*keys, F.array_sort(F.array_distinct(chosen)).alias("_cuts"))
    return spark.createDataFrame(found.collect(), found.schema)


def all_ordinary(df: DataFrame, keys: Sequence[str], value: str, part_bytes: int = PART_BYTES, large_key_rows: int = LARGE_KEY_ROWS) -> bool:
    """Whether every key has few rows and few bytes of ``value``, so that one task may hold any of them whole.
    One job, pre-aggregated by key."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("_rows"), F.sum(F.octet_length(value).cast("bigint")).alias("_bytes"))
    return sums.filter((F.col("_rows") > large_key_rows) | (F.col("_bytes") > part_bytes)).isEmpty()


def block_among(position: Column, cuts: Column) -> Column:
    """How many cuts are below or at a position, by binary search."""
    steps = F.array(*[F.lit(MOST_BLOCKS >> i) for i in range(MOST_BLOCKS.bit_length())])
    search = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= position, at + step).otherwise(at))
    return search.cast("bigint")


def split_large_keys(df: DataFrame, keys: Sequence[str], position: Column, large: DataFrame, only: bool = False) -> DataFrame:
    """Add ``_block``: 0, 1, ... along a large key, -1 for all other keys (or
    drop those, with ``only``)."""
    marked = df.withColumn("_position", position.cast("bigint")).alias("l").join(
        F.broadcast(large).alias("r"), _same(df, large, keys), "inner" if only else "left")
    block = F.when(F.col("_cuts").isNotNull(), block_among(F.col("_position"), F.col("_cuts"))).otherwise(F.lit(-1).cast("bigint"))
    return marked.select("l.*", block.alias("_block")).drop("_position")


def by_block(df: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Partition by key and block, for several uses that share the exchange.

    Naming the null test here keeps the uses identical down to the exchange;
    Spark would otherwise add it below one of them and run both.
    """
    columns = [F.col(c) for c in [*keys, block]]
    for column in columns:
        df = df.filter(column.isNotNull())
    return df.repartition(*columns)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    position: Column,
    large: DataFrame | None,
    large_rows: DataFrame | None = None,
    together: bool = True,
) -> DataFrame:
    """Add ``name``: sum of ``value`` over all rows of the key up to this one.

    ``position`` is a whole number that never falls along ``order``. Rows equal
    in ``order`` count together, as in a SQL RANGE frame, so they must share a
    position; without ``together`` one after another. ``large_rows`` are the rows of large keys, if there is a cheaper
    way to them than through all of ``df``.
    """
    def upto(window):
        ordered = window.orderBy(*order)
        return ordered if together else ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    if large is None:
        return df.withColumn(name, F.sum(value).over(upto(Window.partitionBy(*keys))))
    inside = upto(Window.partitionBy(*keys, "_block"))
    across = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        split_large_keys(df if large_rows is None else large_rows, keys, position, large, only=True)
        .groupBy(*keys, "_block")
        .agg(F.sum(value).alias("_total"))
        .select(*keys, "_block", F.sum("_total").over(across).alias("_carried"))
    )
    inner = split_large_keys(df, keys, position, large).withColumn(name, F.sum(value).over(inside))
    return _carry(inner, carried, keys).withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0))).drop("_carried", "_block")


def _carry(inner: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join what earlier blocks of a key carry over."""
    on = [*_same(inner, carried, keys), F.col("l._block") == F.col("r._block")]
    return inner.alias("l").join(carried.alias("r"), on, "left").select("l.*", "_carried")


def previous_row(
    df: DataFrame, keys: Sequence[str], order: str, name: str, large: DataFrame | None
) -> DataFrame:
    """Add ``name``: the row directly before this one in the key, as a struct.

    ``order`` is a whole number, unique within the key.
    """
    row = F.struct(*df.columns)
    if large is None:
        return df.withColumn(name, F.lag(row).over(Window.partitionBy(*keys).orderBy(order)))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    across = Window.partitionBy(*keys).orderBy("_block")
    carried = (
        split_large_keys(df, keys, F.col(order), large, only=True)
        .groupBy(*keys, "_block")
        .agg(F.max_by(row, order).alias("_last"))
        .select(*keys, "_block", F.lag("_last").over(across).alias("_carried"))
    )
    inner = split_large_keys(df, keys, F.col(order), large).withColumn(name, F.lag(row).over(inside))
    return _carry(inner, carried, keys).withColumn(name, F.coalesce(F.col(name), F.col("_carried"))).drop("_carried", "_block")


def block_of(position: Column, size: int) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")


def in_parts(df: DataFrame, keys: Sequence[str], order: str, value: str, part_bytes: int, large_key_rows: int = LARGE_KEY_ROWS) -> DataFrame:
    """Add ``part``: 0, 1, ... along the order, a new one for every ``part_bytes`` of ``value``.

    A text below that is part 0 alone, whatever the numbers in ``order`` are. A single
    value longer than a part leaves a gap in the numbers after it.
    """
    size = F.octet_length(F.col(value)).cast("bigint")
    large = large_keys(df, keys, F.col(order), large_key_rows)
    through = running_total(df, keys, [order], size, "_through", F.col(order), large)
    return through.withColumn("part", F.floor(F.greatest(F.col("_through") - size, F.lit(0)) / F.lit(part_bytes)).cast("bigint")).drop("_through")


def concat_in_order(df: DataFrame, keys: Sequence[str], order: str, value: str, separator: str, name: str) -> DataFrame:
    """One string per key: ``value`` joined in ``order``. Keys must name bounded
    groups, such as one block of a longer document."""
    joined = F.expr(f"listagg(`{value}`, '{separator}') within group (order by `{order}`)")
    return df.groupBy(*keys).agg(joined.alias(name))
