"""Order without a window over everything: rows in ranges of their order, numbers and last values carried over the borders.

A table is range-partitioned and sorted by its keys, and written; each written partition is a range. Only one row a
range (a count, a last value) goes round, so a hot group is split over as many tasks as it has ranges. The last key
is the row's place in the input, which splits rows that are equal otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slimwire.session import stored

RANGE, WITHIN = "__range", "__within"


def in_ranges(df: DataFrame, keys: Sequence[Column | str], name: str = "ranges") -> DataFrame:
    """``df`` sorted by ``keys``, with the number of each row's range and its place within that."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(n, *keys, "__place").sortWithinPartitions(*keys, "__place").drop("__place")
    return stored(ordered.withColumn(RANGE, F.spark_partition_id()).withColumn(WITHIN, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)


def numbered(df: DataFrame, order: Sequence[Column | str], column: str, name: str = "ranges") -> DataFrame:
    """``df`` with each row's position in ``order``, without gaps, from 0; equal rows stand in any order."""
    held = in_ranges(df, order, name)
    before, total = [], 0
    for r in held.groupBy(RANGE).agg(F.count("*").alias("n")).orderBy(RANGE).collect():  # one row a range
        before.append((r[RANGE], total))
        total += r["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(before, f"{RANGE} int, __before long"))
    return held.join(starts, RANGE).withColumn(column, F.col("__before") + F.col(WITHIN)).drop(RANGE, WITHIN, "__before")


def last_known(df: DataFrame, order: Sequence[Column | str], known: Column, values: Sequence[str], out: str, group: Sequence[str] = ()) -> DataFrame:
    """``df`` with struct ``out``: the ``values`` of the last row up to each one, itself included, for which ``known`` holds (null: none).

    ``group``: only rows of equal group count. The value at a range's border is that of the last known row of all ranges
    before; as groups are in order as well, it holds for the range's first group or for none."""
    value = F.struct(*values)
    held = in_ranges(df.withColumn("__known", known), [*group, *order])
    own = F.struct(*group) if group else F.struct(F.lit(0).alias("_"))
    each = held.groupBy(RANGE).agg(F.max_by(F.when(F.col("__known"), F.struct(own.alias("g"), value.alias("v"))), F.when(F.col("__known"), F.col(WITHIN))).alias("last"))
    border = F.last("last", ignorenulls=True).over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))
    borders = F.broadcast(each.select(RANGE, border.alias("__border")))  # one row a range
    up_to = Window.partitionBy(RANGE, *group).orderBy(WITHIN).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(F.when(F.col("__known"), value), ignorenulls=True).over(up_to)
    carried = F.when(F.col("__border.g").eqNullSafe(own), F.col("__border.v"))
    return held.join(borders, RANGE).withColumn(out, F.coalesce(inside, carried)).drop(RANGE, WITHIN, "__known", "__border")
