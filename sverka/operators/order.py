"""Neighbours and running values in an order, without a task per key.

A window over a key sends each key's rows to one task; a key that holds a third of all
rows then makes one task of them. Here the rows are split by ranges of (key, order), so a
large key spans many tasks. What a range needs from its neighbours is little: a few rows
at its edge, or one carried value per key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sverka.session import checkpoint


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds _range and _id: rows in ranges of an order, _id rising in that order within and over the ranges."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = spread.withColumn("_id", F.monotonically_increasing_id())
    return placed.withColumn("_range", F.shiftright("_id", 33))


#: Rows of one block in which neighbours are looked for; a larger window makes larger blocks.
BLOCK = 8192


def sorted_neighbours(df: DataFrame, window: int, *order: Column | str, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of rows, as structs, of which a comes at most window places before b.

    Rows are numbered over the whole order and cut into blocks of at least window rows, so
    what lies at most window places past a block's end is in the next one, however short
    the ranges of the sort are; those rows are copied to the block before.
    """
    size = max(window, block)
    keys = [(F.col(c) if isinstance(c, str) else c).alias(f"_k{k}") for k, c in enumerate(order)]
    placed = numbered(df.select(F.struct(*df.columns).alias("_row"), *keys), *(f"_k{k}" for k in range(len(keys))))
    own = F.floor(F.col("n") / size)
    blocks = F.when((F.col("n") % size < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    copied = placed.select("n", F.col("_row").alias("b"), own.alias("_own"), F.explode(blocks).alias("_block"))
    w = Window.partitionBy("_block").orderBy("n")
    lags = F.array(*(F.lag(F.struct("b", "_own"), k).over(w) for k in range(1, window + 1)))
    pairs = copied.withColumn("_before", lags).select("_block", "b", F.explode("_before").alias("_a"), "_own")
    # a pair of two copied rows is found in their own block
    return pairs.where("_a is not null and not (_own > _block and _a._own > _block)").select(F.col("_a.b").alias("a"), "b")


def next_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Pairs (a, b) of neighbouring rows of one key in an order."""
    return sorted_neighbours(df, 1, key, *order).where(F.col(f"a.{key}") == F.col(f"b.{key}"))


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Adds n, the place of a row in the order over the whole table, and keeps _range.

    The ranges' sizes are counted first: one number a range is sent to the tasks (there
    are at most as many ranges as shuffle partitions).
    """
    placed = checkpoint(ranged(df, *order))
    sizes = {r["_range"]: r["c"] for r in placed.groupBy("_range").agg(F.count("*").alias("c")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    start = df.sparkSession.createDataFrame(starts, "_range bigint, _start bigint")
    joined = placed.join(F.broadcast(start), "_range")
    return joined.withColumn("n", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id", "_start")


def running_last(numbered_rows: DataFrame, key: str, value: Column, name: str, current: bool = False) -> DataFrame:
    """Adds the last non-null value of the rows of one key before a row (or up to it).

    numbered_rows: as numbered gives them. Inside a range by a window; between ranges the
    last value of each (key, range) is carried over the ranges of the key.
    """
    held = numbered_rows.withColumn("_v", value)
    w = Window.partitionBy(key, "_range").orderBy("n").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    inside = held.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    ends = held.where(F.col("_v").isNotNull()).groupBy(key, "_range").agg(F.max_by("_v", "n").alias("_end"))
    parts = held.select(key, "_range").distinct().join(ends, [key, "_range"], "left")
    over = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_carry", F.last("_end", ignorenulls=True).over(over)).where(F.col("_carry").isNotNull()).select(key, "_range", "_carry")
    out = inside.join(carried, [key, "_range"], "left")
    return out.withColumn(name, F.coalesce("_in", "_carry")).drop("_v", "_in", "_carry")
