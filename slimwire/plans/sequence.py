"""Dense 0-based numbering in a given order, globally or within a group, without
a single-partition window and without one task per group.

Used for metric ids (M1), turn indexes (H2) and registry ids (R1). A hot group
(one session holding a third of the rows) is split over several range partitions
like any other data:

1. ``repartitionByRange(group, *order)`` + ``sortWithinPartitions``, then
   ``checkpoint()`` so both passes see the same partitions.
2. Pass A (``mapInPandas``): one summary row per partition — its first and last
   group and their row counts. This is O(#partitions), collected to the driver.
3. The driver prefix-sums the counts of groups that cross partition boundaries
   (only the first group of a partition can continue an earlier one).
4. Pass B (``mapInPandas``): per batch ``cumcount`` per group plus the rows so far of the
   group that goes on from the batch (or partition) before; offsets are passed in the closure (size bounded
   by the partition count, never by the data).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from slimwire.session import checkpoint_dir


def _keys(pdf: pd.DataFrame, group: str | None) -> pd.Series:
    return pdf[group].astype(str) if group else pd.Series("", index=pdf.index)


def _summary(group: str | None) -> callable:
    """First and last group of a partition with their rows. Input is sorted by group, so only these two are held."""
    def f(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        first = last = None
        n_first = n_last = total = 0
        for pdf in it:
            if pdf.empty:
                continue
            keys = _keys(pdf, group)
            if first is None:
                first = keys.iloc[0]
            n_first += int((keys == first).sum())
            tail = int((keys == keys.iloc[-1]).sum())
            n_last = n_last + tail if keys.iloc[-1] == last else tail
            last = keys.iloc[-1]
            total += len(pdf)
        yield pd.DataFrame({"pid": [pid], "first": [first], "n_first": [n_first], "last": [last], "n_last": [n_last], "total": [total]})
    return f


def _offsets(rows: list) -> dict[int, int]:
    """Offset of the first group of each partition (count of that group in earlier partitions)."""
    rows = sorted(rows, key=lambda r: r["pid"])
    off: dict[int, int] = {}
    run_key, run_n = None, 0
    for r in rows:
        if r["total"] == 0:
            continue
        off[r["pid"]] = run_n if r["first"] == run_key else 0
        if r["first"] == r["last"]:
            run_n = (run_n if r["first"] == run_key else 0) + r["total"]
            run_key = r["first"]
        else:
            run_key, run_n = r["last"], r["n_last"]
    return off


def sequence(df: DataFrame, order: Sequence[str], out_col: str, group: str | None = None,
             num_partitions: int | None = None) -> DataFrame:
    """Add ``out_col`` = 0-based position in ``order`` (within ``group`` when given).

    ``order`` (plus ``group``) must be unique so the numbering is deterministic.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group] if group else []) + list(order)
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).checkpoint(eager=True)

    summ_schema = StructType([StructField("pid", LongType()), StructField("first", StringType()),
                              StructField("n_first", LongType()), StructField("last", StringType()),
                              StructField("n_last", LongType()), StructField("total", LongType())])
    rows = ordered.mapInPandas(_summary(group), summ_schema).collect()
    offsets = _offsets([r.asDict() for r in rows])

    out_schema = StructType(ordered.schema.fields + [StructField(out_col, LongType())])

    def number(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        last, held = None, offsets.get(pid, 0)   # the group that may go on, and its rows so far
        started = False
        for pdf in it:
            if pdf.empty:
                continue
            keys_ = _keys(pdf, group)
            goes_on = keys_.iloc[0] if not started else last
            started = True
            local = keys_.groupby(keys_, sort=False).cumcount()
            pdf = pdf.copy()
            pdf[out_col] = (local + (keys_ == goes_on).astype("int64") * held).astype("int64")
            tail = int((keys_ == keys_.iloc[-1]).sum())
            held = held + tail if keys_.iloc[-1] == goes_on else tail
            last = keys_.iloc[-1]
            yield pdf

    return ordered.mapInPandas(number, out_schema)


def global_ids(df: DataFrame, order: Sequence[str], out_col: str = "id") -> DataFrame:
    return sequence(df, order, out_col)


__all__ = ["sequence", "global_ids", "F"]
