"""The reduction config in force for each row (requests, or blocks that carry their request's time).

``config_log`` rows are ``[valid_from_ms, valid_to_ms)`` intervals that don't overlap, holding the stage
toggles, ``min_savings`` and ``store``. A log of a counted, small size is taken along: a binary search over its
sorted starts gives each row the place of its interval, and an equi-join on the place brings the settings, so that
rows are read once, stay where they are and never multiply. A longer log is merged with the rows: both are put in
order of time in ranges, and the last interval's settings are carried along, over the borders of the ranges as well
(:mod:`slimwire.plans.ordered`). No buckets of time are made, so a wrong timestamp costs nothing.

A change log (``at_ms`` + settings per change) becomes intervals with the next change's time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slimwire.operators.stages import TOGGLE_KEYS
from slimwire.plans.ordered import last_known

DAY_MS = 86_400_000
OPEN_END = 1 << 62
TAKEN_ALONG = 20_000   # intervals up to which the log's starts are part of the plan
CONFIG_COLS = list(TOGGLE_KEYS) + ["min_savings", "store"]


def intervals_from_changes(changes: DataFrame) -> DataFrame:
    """A change log (at_ms, settings...) as [valid_from, valid_to) intervals. Of several changes at one instant
    all but one are empty intervals.

    ``lead`` runs within a day; the day's last change ends at the first change of the next day that has one,
    read from a table of one row a day."""
    day = F.floor(F.col("at_ms") / DAY_MS).cast("bigint")
    days = (changes.groupBy(day.alias("_day")).agg(F.min("at_ms").alias("_first"))
                   .withColumn("_next", F.lead("_first").over(Window.orderBy("_day"))).select("_day", "_next"))
    w = Window.partitionBy("_day").orderBy("at_ms")
    return (changes.withColumn("_day", day).withColumn("_lead", F.lead("at_ms").over(w)).join(days, "_day")
                   .withColumn("valid_to_ms", F.coalesce("_lead", "_next", F.lit(OPEN_END)))
                   .withColumnRenamed("at_ms", "valid_from_ms").drop("_day", "_lead", "_next"))


def _place(starts: list[int], at: Column) -> Column:
    """How many of the sorted ``starts`` are not after ``at``, by halving steps (none for a null)."""
    n = len(starts)
    array = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")  # folded to one literal
    steps = [1 << k for k in range(n.bit_length() - 1, -1, -1)]

    def step(place: Column, s: Column) -> Column:
        on = place + s
        return F.when((on <= n) & (F.element_at(array, F.least(on, F.lit(n))) <= at), on).otherwise(place)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def config_as_of(rows: DataFrame, config_log: DataFrame, time_col: str = "at_ms") -> DataFrame:
    """Attach the config in force at ``time_col`` to every row (NULLs when none, or without a time)."""
    cfg = config_log.select("valid_from_ms", "valid_to_ms", *CONFIG_COLS).where("valid_from_ms < valid_to_ms")
    some = cfg.select("valid_from_ms").limit(TAKEN_ALONG + 1).collect()
    t = F.col(time_col)
    inside = t < F.col("_cfg.valid_to_ms")
    if len(some) > TAKEN_ALONG:
        merged = last_known(_union(rows, cfg, time_col), [time_col, F.col("_cfg").isNull()], F.col("_cfg").isNotNull(), ["_cfg"], "_last")
        found = merged.where("_is_row").withColumn("_cfg", F.col("_last._cfg"))
    elif some:
        starts = sorted(r["valid_from_ms"] for r in some)
        # neither side's key is a named expression: from one with a lambda Spark infers a filter on the log that names the rows' time
        places = rows.sparkSession.createDataFrame([(v, i + 1) for i, v in enumerate(starts)], "valid_from_ms long, _place int")
        own = cfg.join(F.broadcast(places), "valid_from_ms").select("_place", F.struct(*cfg.columns).alias("_cfg"))
        found = rows.withColumn("_place", F.explode(F.array(_place(starts, t)))).join(F.broadcast(own), "_place", "left")
    else:
        found = rows.withColumn("_cfg", F.lit(None).cast(cfg.select(F.struct(*cfg.columns).alias("c")).schema["c"].dataType))
    return found.select(*rows.columns, *(F.when(inside, F.col(f"_cfg.{c}")).alias(c) for c in CONFIG_COLS))


def _union(rows: DataFrame, cfg: DataFrame, time_col: str) -> DataFrame:
    """Rows and intervals under one another: an interval has its start as its time and its settings in ``_cfg``."""
    events = cfg.select(F.col("valid_from_ms").cast(rows.schema[time_col].dataType).alias(time_col), F.struct(*cfg.columns).alias("_cfg"), F.lit(False).alias("_is_row"))
    return rows.withColumn("_is_row", F.lit(True)).unionByName(events, allowMissingColumns=True)
