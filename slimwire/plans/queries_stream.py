"""Registered stream queries (I13, G1-G5). Each runs its stream to completion
(availableNow) into the shared checkpoint folder and returns the result as a batch
DataFrame, so the oracle can compare it with the batch form in DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from slimwire.plans import oracle_views as ov
from slimwire.plans.queries_stages import PREV_SQL
from slimwire.registry import register
from slimwire.sources import ingest as ig
from slimwire.sources import tables as tb
from slimwire.streaming import jobs as sj


@register("i13_request_log_stream", ov.with_views("request_blocks") + """
SELECT request_id, CAST(count(*) AS BIGINT) AS blocks FROM request_blocks GROUP BY request_id""")
def q_i13(spark, d):
    # the request log lands as JSON-lines files; the stream normalizes them as they arrive
    src = sj.new_run_dir(spark, "request-log")
    log = tb.request_json(spark, d)
    log.write.json(src)
    schema = log.schema
    stream = sj.stream_dir(spark, src, schema, fmt="json", max_files=8)
    _, blocks = ig.normalize(stream)
    out = sj.run_append(blocks.select("request_id", "section", "msg_idx", "block_idx"), sj.new_run_dir(spark, "out"))
    res = spark.read.parquet(out)
    return res.groupBy("request_id").agg(F.count(F.lit(1)).alias("blocks"))


@register("g1_stream_metrics", ov.with_views("request_metrics") + """,
 m AS (SELECT r.*, e.ts FROM request_metrics r JOIN events e ON e.event_id = r.id)
SELECT epoch_ms(date_trunc('day', ts)) AS window_start_ms, epoch_ms(date_trunc('day', ts)) + 86400000 AS window_end_ms,
       model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens_before) AS BIGINT) AS tokens_before,
       CAST(sum(saved) AS BIGINT) AS saved
FROM m GROUP BY 1, 2, model""")
def q_g1(spark, d):
    metrics = sj.metrics_stream(sj.stream_table(spark, d, "events"))
    out = sj.run_complete(sj.stream_metrics(metrics), sj.new_run_dir(spark, "g1"))
    return sj.read_newest(spark, out)


@register("g2_stream_sessions", ov.with_views("request_metrics") + """,
 r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms DESC, id DESC) AS rn FROM request_metrics)
SELECT session_id, max(CASE WHEN rn = 1 THEN model END) AS model, min(at_ms) AS first_seen, max(at_ms) AS last_active,
       CAST(sum(tokens_before) AS BIGINT) AS total_tokens, CAST(count(*) AS BIGINT) AS turns
FROM r GROUP BY session_id""")
def q_g2(spark, d):
    metrics = sj.metrics_stream(sj.stream_table(spark, d, "events"))
    out = sj.run_append(sj.stream_sessions(metrics), sj.new_run_dir(spark, "g2"), mode="update")
    res = sj.latest_per_key(spark.read.parquet(out), ["session_id"])
    return res.select("session_id", "model", "first_seen", "last_active", "total_tokens", "turns")


@register("g3_stream_context_ids", ov.with_views("context_puts") + """
SELECT DISTINCT session_id, md5(content) AS hash FROM context_puts""")
def q_g3(spark, d):
    docs = sj.stream_table(spark, d, "documents")
    ex = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "ln"))
    puts = ex.where(F.col("ln") != "").select(
        F.col("ln").alias("content"),
        F.concat(F.lit("d"), (F.col("doc_id") % 20).cast("string")).alias("session_id"),
        # event time anchored at 2024-01-01: the initial watermark is 0 ms, so ts=0 would count as late
        F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("doc_id") * 1000 + F.col("pos")).alias("ts"))
    out = sj.run_append(sj.stream_context_ids(puts), sj.new_run_dir(spark, "g3"))
    return spark.read.parquet(out).select("session_id", "hash")


EPOCH_MS = 1_704_067_200_000   # event times begin here: the initial watermark is 0 ms
SLICES = 4


# Sends come in four slices of their time, every fifth one a slice late; the watermark is two slices behind, so all come in order.
@register("g4_stream_file_versions", PREV_SQL + f""",
 span AS (SELECT max(at_ms) AS hi, (max(at_ms) - min(at_ms)) // {SLICES} + 1 AS step FROM q WHERE p IS NOT NULL)
SELECT l.session_id, l.path, l.request_id, prev_request_id, prev IS NOT NULL AND prev <> l.text AS differs
FROM lagged l JOIN q USING (request_id), span WHERE q.at_ms <= hi - 2 * step""")
def q_g4(spark, d):
    from slimwire.functions import text as tx
    src, kept = sj.new_run_dir(spark, "file-versions"), sj.new_run_dir(spark, "file-versions-log")
    # same qualification as the batch stage: a file block is >= 200 units with a path line
    files = (tb.file_versions(spark, d).where(tx.utf16_len("text") >= tx.MIN_FILE_CHARS)
               .withColumn("path", tx.detect_path("text")).where(F.col("path").isNotNull()))
    files.withColumn("ts", F.timestamp_millis(F.col("at_ms") + EPOCH_MS)).write.parquet(kept)
    log = spark.read.parquet(kept)
    span = log.agg(F.min("at_ms").alias("lo"), F.max("at_ms").alias("hi")).first()
    lo, step = span["lo"] or 0, ((span["hi"] or 0) - (span["lo"] or 0)) // SLICES + 1
    late = F.when(F.col("request_id") % 5 == 0, 1).otherwise(0)
    arrival = F.least(F.floor((F.col("at_ms") - lo) / step) + late, F.lit(SLICES - 1))
    out, watermark = sj.new_run_dir(spark, "g4"), f"{2 * step} milliseconds"
    for i in range(SLICES):
        log.where(arrival == i).write.mode("append").parquet(src)
        # a slice is read when it has come; batches of so many files would be as many as the tasks that wrote them, and each goes over all state
        sj.run_append(sj.stream_file_versions(sj.stream_dir(spark, src, log.schema), watermark), out)
    return spark.read.parquet(out).drop("batch_id")


WINDOWS_SQL = ov.with_views("request_metrics") + """,
 m AS (SELECT r.*, epoch_ms(e.ts) AS t FROM request_metrics r JOIN events e ON e.event_id = r.id),
 w AS (SELECT *, unnest(range((t // {slide} - {window} // {slide} + 1) * {slide}, t + 1, {slide})) AS start FROM m)
SELECT start AS window_start_ms, start + {window} AS window_end_ms, model, CAST(count(*) AS BIGINT) AS requests,
       CAST(sum(tokens_before) AS BIGINT) AS tokens_before, CAST(sum(saved) AS BIGINT) AS saved
FROM w GROUP BY ALL HAVING start + {window} <= (SELECT max(t) FROM m) - 86400000"""


def _appended(spark, d, name: str, window: str, slide: str | None = None):
    metrics = sj.metrics_stream(sj.stream_table(spark, d, "events"))
    out = sj.run_append(sj.stream_metrics(metrics, window, slide), sj.new_run_dir(spark, name))
    return spark.read.parquet(out).drop("batch_id")


# Windows that the watermark, a day behind the newest event, has passed.
@register("g1_stream_metrics_appended", WINDOWS_SQL.format(window=86_400_000, slide=86_400_000))
def q_g1_appended(spark, d):
    return _appended(spark, d, "g1-day", "1 day")


@register("g1_stream_metrics_sliding", WINDOWS_SQL.format(window=86_400_000, slide=21_600_000))
def q_g1_sliding(spark, d):
    return _appended(spark, d, "g1-sliding", "1 day", "6 hours")


@register("g5_stream_idle_sessions", ov.with_views("request_metrics") + """,
 m AS (SELECT r.session_id, e.ts FROM request_metrics r JOIN events e ON e.event_id = r.id),
 g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY session_id ORDER BY ts) IS NULL
                        OR ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts) >= INTERVAL 30 MINUTE
                      THEN 1 ELSE 0 END AS brk FROM m),
 s AS (SELECT *, sum(brk) OVER (PARTITION BY session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT session_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts) + INTERVAL 30 MINUTE) // 1000 AS end_ms,
       CAST(count(*) AS BIGINT) AS events
FROM s GROUP BY session_id, sid
-- spans that the watermark (a day behind the newest event) has passed
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 DAY FROM m)""")
def q_g5(spark, d):
    metrics = sj.metrics_stream(sj.stream_table(spark, d, "events"))
    out = sj.run_append(sj.stream_idle_sessions(metrics), sj.new_run_dir(spark, "g5"))
    return spark.read.parquet(out).drop("batch_id")
