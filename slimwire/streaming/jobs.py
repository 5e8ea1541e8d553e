"""Structured Streaming jobs over the request log, each with a batch twin.

Sources are file streams with a fixed schema (``readStream.schema(...)``); a
bundled table that is a folder of files is streamed as it is, one that is a single
parquet file with ``pathGlobFilter`` over its folder. Sinks write parquet under the shared checkpoint folder:

* windows are appended once the watermark has passed them; rows behind it go to a side table;
* small aggregations can also run in ``complete`` mode through ``foreachBatch`` that writes a
  version of the result per batch; readers take the newest whole one;
* spans of activity are appended once the watermark has passed them, so their state
  and their output are bounded by the watermark;
* stateful keyed jobs append their updates and readers keep the newest update per
  key (``max_by`` over the batch id);
* ``trigger(availableNow=True)`` processes everything present and stops, which
  makes the jobs testable and restartable from their checkpoints (an executor lost
  mid-batch re-runs that batch; the sinks are idempotent per batch id).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from slimwire.session import checkpoint_dir


def _base(spark: SparkSession) -> str:
    return checkpoint_dir(spark).replace("file:", "")


def new_run_dir(spark: SparkSession, name: str) -> str:
    return os.path.join(_base(spark), "streams", f"{name}-{uuid.uuid4().hex[:12]}")


def stream_table(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """A bundled parquet table, one file or a folder of files, as a file stream with a fixed schema."""
    table = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(table).schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return r.parquet(table)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream's source is a folder


def stream_dir(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
               max_files: int | None = None) -> DataFrame:
    """A directory of request-log files as a stream (new files are new requests)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def run_complete(stream: DataFrame, out: str) -> str:
    """Run an aggregation in complete mode; each batch writes the full result as a version of its own
    (``out/version=<batch>``), so a failure midway leaves the last whole one. See :func:`read_newest`."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/version={batch_id}")

    q = (stream.writeStream.outputMode("complete").foreachBatch(sink)
               .option("checkpointLocation", out + "._ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def read_newest(spark: SparkSession, out: str) -> DataFrame:
    """The newest version that :func:`run_complete` finished writing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(s.getPath()) for s in fs.listStatus(path)
            if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.parquet(max(done, key=lambda p: int(p.rsplit("=", 1)[1])))


def run_append(stream: DataFrame, out: str, mode: str = "append") -> str:
    """Run a stream writing each micro-batch to ``out/batch_id=<id>``.

    A batch re-executed after a failure overwrites its own folder, so the sink is
    exactly-once; readers get ``batch_id`` back from partition discovery."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
               .option("checkpointLocation", out + "._ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    return out


# --------------------------------------------------------------------------- inputs
def event_time(df: DataFrame, col: str = "ts"):
    """An event-time TIMESTAMP that does not depend on the session time zone.

    ``TIMESTAMP_NTZ`` wall-clock values are read as UTC (watermarks need TIMESTAMP;
    a plain cast would interpret the wall clock in the session zone)."""
    from pyspark.sql.types import TimestampNTZType
    if isinstance(df.schema[col].dataType, TimestampNTZType):
        tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
        return F.from_utc_timestamp(F.col(col).cast("timestamp"), F.lit(tz))
    return F.col(col)


def metrics_stream(events: DataFrame) -> DataFrame:
    """request_metrics rows from an events stream, with an event-time TIMESTAMP."""
    saved = F.col("event_id") % 97 - 5
    before = F.col("event_id") % 900 + 100
    return events.select(F.col("event_id").alias("id"), event_time(events).alias("ts"),
                         (F.col("event_id") * 1000).alias("at_ms"),
                         F.when(F.col("user_id") % 2 == 0, "anthropic").otherwise("openai").alias("provider"),
                         F.col("event_type").alias("model"),
                         F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
                         before.alias("tokens_before"), (before - saved).alias("tokens_after"),
                         saved.alias("saved"), F.col("value").alias("duration_ms"))


# --------------------------------------------------------------------------- G1
def stream_metrics(metrics: DataFrame, window: str = "1 day", slide: str | None = None,
                   watermark: str = "1 day") -> DataFrame:
    """G1: savings per model per event-time window (tumbling, or sliding with ``slide``).

    Appended (:func:`run_append`), a window comes out once, when the watermark has passed its end, and its state goes;
    rows that come later are in :func:`stream_late_rows`. In complete mode all windows come out with every batch."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (metrics.withWatermark("ts", watermark)
                   .groupBy(w.alias("w"), "model")
                   .agg(F.count(F.lit(1)).alias("requests"),
                        F.sum("tokens_before").cast("bigint").alias("tokens_before"),
                        F.sum("saved").cast("bigint").alias("saved"))
                   .select(F.unix_millis(F.col("w.start")).alias("window_start_ms"),
                           F.unix_millis(F.col("w.end")).alias("window_end_ms"),
                           "model", "requests", "tokens_before", "saved"))


LATE_OUT = StructType([StructField("id", LongType()), StructField("ts_ms", LongType()), StructField("model", StringType()), StructField("tokens_before", LongType()),
                       StructField("saved", LongType()), StructField("missed", LongType()), StructField("windows", LongType())])
LATE_KEYS = 64   # keys over which rows are dealt, for their watermark alone


def _late(window_ms: int, slide_ms: int):
    def find(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        passed = state.getCurrentWatermarkMs()
        for pdf in pdfs:
            newest = pdf["ts_ms"] // slide_ms * slide_ms          # start of the last window that holds the row
            windows = (window_ms - (pdf["ts_ms"] - newest) + slide_ms - 1) // slide_ms
            # windows end at newest + window, a slide earlier each; those up to the watermark have been given out
            missed = ((passed - (newest + window_ms)) // slide_ms + windows).clip(0, None).clip(upper=windows)
            rows = pdf.assign(missed=missed.astype("int64"), windows=windows.astype("int64"))
            yield rows.loc[rows["missed"] > 0, [f.name for f in LATE_OUT.fields]]
    return find


def stream_late_rows(metrics: DataFrame, window_ms: int, slide_ms: int | None = None, watermark: str = "1 day") -> DataFrame:
    """G1's side table: rows that came when the watermark had passed the end of some of their ``windows``, and how many
    of these they ``missed``. No state is kept; keys only deal the rows."""
    rows = metrics.select("id", "ts", F.unix_millis("ts").alias("ts_ms"), "model", F.col("tokens_before").cast("long"), F.col("saved").cast("long"),
                          F.pmod(F.xxhash64("id"), F.lit(LATE_KEYS)).alias("_k"))
    return (rows.withWatermark("ts", watermark).groupBy("_k")
                .applyInPandasWithState(_late(window_ms, slide_ms or window_ms), LATE_OUT, StructType([StructField("_", LongType())]), "append", GroupStateTimeout.NoTimeout))


# --------------------------------------------------------------------------- G2
SESSION_FIELDS = [StructField("model", StringType()), StructField("first_seen", LongType()),
                  StructField("last_active", LongType()), StructField("total_tokens", LongType()),
                  StructField("turns", LongType()), StructField("last_id", LongType())]
SESSION_STATE = StructType(SESSION_FIELDS + [StructField("max_ts_ms", LongType())])
SESSION_OUT = StructType([StructField("session_id", StringType())] + SESSION_FIELDS)


def _session_update(ttl_ms: int):
    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()  # H7: an idle session is forgotten
            return
        if state.exists:
            model, first, last, total, turns, last_id, max_ts = state.get
        else:
            model, first, last, total, turns, last_id, max_ts = None, None, None, 0, 0, None, 0
        for pdf in pdfs:
            # rows of one micro-batch arrive unordered and in pieces; every update is order-free
            max_ts = max(max_ts, int(pdf["ts"].max().value // 1_000_000))
            low, newest = int(pdf["at_ms"].min()), pdf.sort_values(["at_ms", "id"]).iloc[-1]
            first = low if first is None else min(first, low)
            at, rid = int(newest["at_ms"]), int(newest["id"])
            if last is None or (at, rid) >= (last, last_id if last_id is not None else -1):
                last, last_id, model = at, rid, newest["model"]
            total += int(pdf["tokens_before"].sum())
            turns += len(pdf)
        state.update((model, first, last, total, turns, last_id, max_ts))
        # event-time TTL: forget the session once the watermark passes its last event + ttl
        state.setTimeoutTimestamp(max_ts + ttl_ms)
        yield pd.DataFrame({"session_id": [key[0]], "model": [model], "first_seen": [first],
                            "last_active": [last], "total_tokens": [total], "turns": [turns],
                            "last_id": [last_id]})
    return update


def stream_sessions(metrics: DataFrame, ttl_ms: int = 365 * 24 * 3600 * 1000,
                    watermark: str = "1 day") -> DataFrame:
    """Per-session running state (H1) as keyed state with an event-time idle timeout (H7).

    Event-time (not processing-time) timeouts: they fire only when the watermark
    moves, so ``availableNow`` runs terminate and replays are deterministic."""
    return (metrics.withWatermark("ts", watermark).groupBy("session_id")
                   .applyInPandasWithState(_session_update(ttl_ms), SESSION_OUT, SESSION_STATE, "update",
                                           GroupStateTimeout.EventTimeTimeout))


def latest_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest emitted update per key (by batch id) from an appended update log."""
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    return df.groupBy(*keys).agg(*[F.max_by(c, "batch_id").alias(c) for c in cols])


# --------------------------------------------------------------------------- G3
def stream_context_ids(puts: DataFrame, watermark: str = "30 days") -> DataFrame:
    """First sight of each (session, content hash); later copies within the watermark dropped.

    State holds the hashes of the last ``watermark`` of event time, no more."""
    return (puts.withColumn("hash", F.md5("content"))
                .withWatermark("ts", watermark)
                .dropDuplicatesWithinWatermark(["session_id", "hash"])
                .select("session_id", "hash", "ts"))


# --------------------------------------------------------------------------- G4
FILE_STATE = StructType([StructField("digest", StringType()), StructField("ts_ms", LongType()),
                         StructField("request_id", LongType()), StructField("waiting", StringType())])
FILE_OUT = StructType([StructField("session_id", StringType()), StructField("path", StringType()),
                       StructField("request_id", LongType()), StructField("prev_request_id", LongType()),
                       StructField("differs", BooleanType())])
FOREVER_MS = 365 * 24 * 3600 * 1000


def _file_update(ttl_ms: int):
    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = None, []
        if state.exists:
            digest, ts, rid, held = state.get
            last, waiting = (None if rid is None else (ts, rid, digest)), [tuple(x) for x in json.loads(held)]
        for pdf in pdfs:  # none when the timer has run out
            waiting += zip(pdf["ts_ms"].tolist(), pdf["request_id"].tolist(), pdf["digest"].tolist(), strict=True)
        passed = state.getCurrentWatermarkMs()
        waiting.sort()
        rows = []
        while waiting and waiting[0][0] <= passed:  # nothing earlier can come any more
            now = waiting.pop(0)
            rows.append((key[0], key[1], now[1], None if last is None else last[1], last is not None and last[2] != now[2]))
            last = now
        if not waiting and (last is None or last[0] + ttl_ms <= passed):
            if state.exists:
                state.remove()
        else:
            ts, rid, digest = last or (None, None, None)
            state.update((digest, ts, rid, json.dumps(waiting)))
            state.setTimeoutTimestamp(waiting[0][0] if waiting else last[0] + ttl_ms)
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in FILE_OUT.fields])
    return update


def stream_file_versions(versions: DataFrame, watermark: str = "1 hour", ttl_ms: int = FOREVER_MS) -> DataFrame:
    """Previous version per (session, path) from keyed state (as S8 in batch), for a stream with event time ``ts``.

    A send waits until the watermark has passed it, so sends that come out of order within the watermark are put in
    order of (ts, request_id) and give what the batch ``lag`` gives; a timer lets them go. Sends behind the watermark are
    dropped, as everywhere in a watermarked stream. The state holds a digest of the last text, the digests of the sends
    that wait, and goes when the file has been idle for ``ttl_ms``: its next send is then a first one."""
    rows = versions.select("session_id", "path", "request_id", "ts", F.unix_millis("ts").alias("ts_ms"), F.sha2("text", 256).alias("digest"))
    return (rows.withWatermark("ts", watermark).groupBy("session_id", "path")
                .applyInPandasWithState(_file_update(ttl_ms), FILE_OUT, FILE_STATE, "append", GroupStateTimeout.EventTimeTimeout))


# --------------------------------------------------------------------------- G5
def stream_idle_sessions(metrics: DataFrame, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """Gap-based activity spans per session (session windows). To be appended: a span comes out once the
    watermark has passed its end, and its state goes."""
    return (metrics.withWatermark("ts", watermark)
                   .groupBy(F.session_window("ts", gap).alias("s"), "session_id")
                   .agg(F.count(F.lit(1)).alias("events"))
                   .select("session_id", F.unix_millis(F.col("s.start")).alias("start_ms"),
                           F.unix_millis(F.col("s.end")).alias("end_ms"), "events"))
