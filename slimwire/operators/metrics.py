"""Request metrics as aggregates, windows and top-k over a metrics fact table.

The fact table has the columns of ``request_metrics``:
id, at_ms, provider, model, session_id, tokens_before, tokens_after, saved, duration_ms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slimwire.functions import text as tx

RING_CAPACITY = 1000      # fixed value: metrics ring buffer size
RECENT_DEFAULT = 50       # fixed value: default page of recent requests
LOG_PREFIX = "[reduce]"   # log line prefix (a parameter of log_line)


def assign_sequential_ids(df: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """M1: dense 0-based ids in ``order`` (a unique key) without a single-partition window.

    Delegates to :func:`slimwire.plans.sequence.sequence`: range partitions are
    counted, the per-partition counts (not the data) are prefix-summed, and the
    offsets are added back partition by partition.
    """
    from slimwire.plans.sequence import sequence
    return sequence(df, order, id_col)


def ring_buffer(metrics: DataFrame, capacity: int = RING_CAPACITY) -> DataFrame:
    """M2: the newest ``capacity`` rows by id (TakeOrderedAndProject, no full sort)."""
    return metrics.orderBy(F.col("id").desc()).limit(capacity)


def metrics_total(metrics: DataFrame) -> DataFrame:
    """M3: one row of totals; savedPct and avgDurationMs to 1 place, 0 when empty."""
    agg = metrics.agg(F.count(F.lit(1)).alias("requests"),
                      F.coalesce(F.sum("tokens_before"), F.lit(0)).cast("bigint").alias("tokens_before"),
                      F.coalesce(F.sum("tokens_after"), F.lit(0)).cast("bigint").alias("tokens_after"),
                      F.coalesce(F.sum("saved"), F.lit(0)).cast("bigint").alias("saved"),
                      F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("_dur"))
    return agg.select(
        "requests", "tokens_before", "tokens_after", "saved",
        F.when(F.col("tokens_before") > 0, tx.js_round(F.col("saved") / F.col("tokens_before") * 100, 1))
         .otherwise(F.lit(0.0)).alias("saved_pct"),
        F.when(F.col("requests") > 0, tx.js_round(F.col("_dur") / F.col("requests"), 1))
         .otherwise(F.lit(0.0)).alias("avg_duration_ms"))


def metrics_by_model(metrics: DataFrame) -> DataFrame:
    """M4: per model, ranked by tokens_before desc; ties keep first-seen order (min id)."""
    agg = (metrics.groupBy("model")
                  .agg(F.count(F.lit(1)).alias("requests"),
                       F.sum("tokens_before").cast("bigint").alias("tokens_before"),
                       F.sum("saved").cast("bigint").alias("saved"),
                       F.min("id").alias("_first")))
    # clients name the models, so their number has no bound: ranked without a window over all of them in one task
    from slimwire.plans.ordered import numbered
    ranked = numbered(agg, [F.desc("tokens_before"), "_first"], "rank")
    return ranked.select("model", "requests", "tokens_before", "saved", "rank")


def recent_requests(metrics: DataFrame, limit: int = RECENT_DEFAULT) -> DataFrame:
    """M5: newest first. ``limit`` 0 gives no rows; negative is an error (A9 fixed)."""
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < 0:
        raise ValueError(f"limit must be a non-negative integer, got {limit!r}")
    return metrics.orderBy(F.col("id").desc()).limit(limit)


def request_summary(metrics: DataFrame) -> DataFrame:
    """M6: savedPct to 1 place, durationMs to 2 places."""
    return metrics.select(
        "id", "tokens_before", "tokens_after", "saved",
        F.when(F.col("tokens_before") > 0, tx.js_round(F.col("saved") / F.col("tokens_before") * 100, 1))
         .otherwise(F.lit(0.0)).alias("saved_pct"),
        tx.js_round(F.col("duration_ms"), 2).alias("duration_ms"))


def run_summary(requests: DataFrame) -> DataFrame:
    """M6 over a reduction's ``per_request`` rows: savedPct to 1 place and the stages as (name, saved, reversible)."""
    return requests.select(
        "session_id", "request_id", "tokens_before", "tokens_after", "saved",
        F.when(F.col("tokens_before") > 0, tx.js_round(F.col("saved") / F.col("tokens_before") * 100, 1))
         .otherwise(F.lit(0.0)).alias("saved_pct"),
        F.transform("stages", lambda s: F.struct(s["stage"].alias("name"), s["saved"].alias("saved"),
                                                 s["reversible"].alias("reversible"))).alias("stages"))


def metrics_of_run(requests: DataFrame) -> DataFrame:
    """The metric rows of a reduction (without ids, see :func:`assign_sequential_ids`; no clock runs in a plan, so the
    duration is null)."""
    return requests.select("at_ms", "provider", "model", "session_id", "tokens_before", "tokens_after", "saved",
                           F.lit(None).cast("double").alias("duration_ms"))


def log_line(metrics: DataFrame, prefix: str = LOG_PREFIX) -> DataFrame:
    """M7: one human-readable line per request."""
    pct = F.when(F.col("tokens_before") > 0, F.col("saved") / F.col("tokens_before") * 100).otherwise(0.0)
    line = F.format_string(prefix + " model=%s before=%d after=%d saved=%d (%s%%) %sms",
                           F.col("model"), F.col("tokens_before"), F.col("tokens_after"), F.col("saved"),
                           tx.js_fixed1(pct), tx.js_fixed1("duration_ms"))
    return metrics.select("id", line.alias("line"))


def savings_share(by_model: DataFrame) -> DataFrame:
    """M8: bar scale per model: width vs the largest model, saved share clamped to 0..100."""
    # one number, read once: no window over all models in one task
    mx = F.lit(max(by_model.agg(F.max("tokens_before")).first()[0] or 0, 1))
    share = F.when(F.col("tokens_before") > 0, F.col("saved") / F.col("tokens_before") * 100).otherwise(0.0)
    return by_model.select(
        "model", (F.col("tokens_before") / mx * 100).alias("width_pct"),
        F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)).alias("saved_pct_clamped"))


def session_spend(metrics: DataFrame) -> DataFrame:
    """Spend per (provider, session)."""
    return (metrics.groupBy("provider", "session_id")
                   .agg(F.count(F.lit(1)).alias("requests"),
                        F.sum("tokens_before").cast("bigint").alias("tokens_before"),
                        F.sum("tokens_after").cast("bigint").alias("tokens_after"),
                        F.sum("saved").cast("bigint").alias("saved")))


def spend_rollup(metrics: DataFrame) -> DataFrame:
    """Subtotals per provider and grand total via ROLLUP(provider, model)."""
    return (metrics.rollup("provider", "model")
                   .agg(F.count(F.lit(1)).alias("requests"),
                        F.sum("tokens_before").cast("bigint").alias("tokens_before"),
                        F.sum("saved").cast("bigint").alias("saved"),
                        F.grouping_id().cast("bigint").alias("level")))


# --------------------------------------------------------------------------- M9, M10
def snapshot_metrics(metrics: DataFrame, path: str, next_id: int | None = None) -> str:
    """M9: write the metrics rows as a new snapshot version (see sources.snapshot), and the id that the next
    request gets (by default one more than the highest), which outlives the rows."""
    from slimwire.sources.snapshot import write_snapshot
    if next_id is None:
        top = metrics.agg(F.max("id")).first()[0]
        next_id = 0 if top is None else top + 1
    write_snapshot(metrics.sparkSession.createDataFrame([(next_id,)], "next_id long"), path + "-sequence")
    return write_snapshot(metrics, path)


def restore_sequence(spark: SparkSession, path: str) -> int:
    """M9: the id that the next request gets after a restore."""
    from pyspark.sql.types import LongType, StructType
    from slimwire.sources.snapshot import read_snapshot
    row = read_snapshot(spark, path + "-sequence", StructType().add("next_id", LongType())).first()
    return row["next_id"] if row else 0


def restore_metrics(spark: SparkSession, path: str, capacity: int = RING_CAPACITY) -> DataFrame:
    """M9: read the latest snapshot and keep only the newest ``capacity`` rows."""
    from slimwire.sources.snapshot import METRICS_SCHEMA, read_snapshot
    return ring_buffer(read_snapshot(spark, path, METRICS_SCHEMA), capacity)


def clear_metrics(spark: SparkSession, path: str) -> str:
    """Empty the store by writing an empty snapshot version (ids restart at 0)."""
    from slimwire.sources.snapshot import METRICS_SCHEMA
    return snapshot_metrics(spark.createDataFrame([], METRICS_SCHEMA), path, next_id=0)

