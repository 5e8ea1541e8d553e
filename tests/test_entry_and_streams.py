"""Driver contract and batch == stream twins on the smallest fixture."""

from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and set(df.columns) >= {"model", "requests", "tokens_before", "saved"}
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 80
    # the training-data queries come and go with their subpackage
    from importlib.util import find_spec
    there = find_spec("slimwire.llm") is not None and find_spec("corpus_pipeline") is not None
    assert ("pipeline" in qs) == there == any(k.startswith("op1_") for k in qs)


def test_stream_metrics_equal_batch(spark):
    from slimwire.plans.queries_stream import q_g1
    from slimwire.sources import tables as tb
    got = {(r.window_start_ms, r.model): (r.requests, r.saved) for r in q_g1(spark, SF_SMALL).collect()}
    ev = tb.read_table(spark, SF_SMALL, "events").select("event_id", "ts")
    m = tb.request_metrics(spark, SF_SMALL).join(ev, F.col("id") == F.col("event_id"))
    day = F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp")))
    want = {(r.d, r.model): (r.n, r.s) for r in
            m.groupBy(day.alias("d"), "model").agg(F.count(F.lit(1)).alias("n"), F.sum("saved").alias("s")).collect()}
    assert got == want


def test_stream_sessions_equal_batch(spark):
    from slimwire.plans.queries_stream import q_g2
    from slimwire.sources import tables as tb
    got = {r.session_id: (r.turns, r.total_tokens, r.last_active) for r in q_g2(spark, SF_SMALL).collect()}
    m = tb.request_metrics(spark, SF_SMALL)
    want = {r.session_id: (r.n, r.t, r.l) for r in m.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tokens_before").alias("t"), F.max("at_ms").alias("l")).collect()}
    assert got == want


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    from slimwire.plans.queries_stream import q_g3
    from slimwire.sources import tables as tb
    tb.read_table(spark, SF_SMALL, "documents").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    want = {tuple(r) for r in tb.context_puts(spark, SF_SMALL).select("session_id", F.md5("content")).collect()}
    got = [tuple(r) for r in q_g3(spark, str(tmp_path)).collect()]
    assert want and len(got) == len(want) and set(got) == want


T0 = 1_704_067_200_000
FILE_SCHEMA = "session_id string, path string, text string, request_id long, ts timestamp"


def in_batches(spark, schema, batches):
    """A stream that takes one batch of rows after the other."""
    import time

    from slimwire.streaming import jobs as sj
    src = sj.new_run_dir(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)   # files are taken in order of their times
    return sj.stream_dir(spark, src, spark.createDataFrame([], schema).schema, max_files=1)


def at(ms):
    import datetime
    return datetime.datetime.fromtimestamp((T0 + ms) / 1000, datetime.UTC).replace(tzinfo=None)


def test_stream_file_versions_equal_batch_lag(spark):
    from slimwire.plans.queries_stages import q_s8
    from slimwire.plans.queries_stream import q_g4
    s = {r.request_id: r.prev_request_id for r in q_g4(spark, SF_SMALL).collect()}
    b = {r.request_id: r.prev_request_id for r in q_s8(spark, SF_SMALL).collect()}
    assert s and all(b[k] == v for k, v in s.items())


def test_stream_file_versions_put_late_sends_in_order(spark):
    """Sends within the watermark land in order whatever order they came in, in pieces of small Arrow chunks; an idle file's state goes."""
    import random

    from slimwire.streaming import jobs as sj
    random.seed(4)
    sends = [("s", random.choice("pq"), f"text {i // 3}", i, at(i * 1000)) for i in range(60)]
    shaken = sorted(sends, key=lambda r: r[4].timestamp() + random.uniform(0, 9))
    batches = [shaken[i:i + 12] for i in range(0, 60, 12)] + [[("x", "x", "x", 900, at(100_000))], [("x", "x", "y", 901, at(400_000))], [("x", "x", "y", 902, at(800_000))]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        stream = sj.stream_file_versions(in_batches(spark, FILE_SCHEMA, batches), "30 seconds", ttl_ms=60_000)
        out = sj.new_run_dir(spark, "out")
        kept = []

        def sink(batch, n):
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={n}")
        q = stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", out + "._ckpt").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.request_id: (r.prev_request_id, r.differs) for r in spark.read.parquet(out).collect() if r.session_id == "s"}
    last, want = {}, {}
    for _, path, text, rid, _ in sends:
        prev = last.get(path)
        want[rid] = (prev and prev[0], prev is not None and prev[1] != text)
        last[path] = (rid, text)
    assert got == want
    assert max(kept) == 3 and kept[-1] == 1   # the two idle files are forgotten


METRIC_SCHEMA = "id long, ts timestamp, model string, tokens_before long, saved long"


def test_windows_come_out_once_and_late_rows_go_aside(spark):
    from slimwire.streaming import jobs as sj
    day = 86_400_000
    batches = [[(1, at(0), "m", 10, 1), (2, at(day), "m", 20, 2)], [(3, at(5 * day), "m", 30, 3)], [(4, at(5 * day), "m", 40, 4)],
               [(5, at(1000), "m", 50, 5), (6, at(5 * day + 1), "m", 60, 6)], [(7, at(9 * day), "m", 70, 7)]]
    for slide, missed in ((None, {5: (1, 1)}), ("6 hours", {5: (4, 4)})):
        stream = sj.stream_metrics(in_batches(spark, METRIC_SCHEMA, batches), "1 day", slide)
        got = spark.read.parquet(sj.run_append(stream, sj.new_run_dir(spark, "out"))).collect()
        assert len({(r.window_start_ms, r.model) for r in got}) == len(got)    # once each
        assert all(r.window_end_ms <= T0 + 8 * day for r in got)
        first = {r.window_start_ms - T0: r.requests for r in got}
        assert first[0] == 1 and first[day] == 1 and first[5 * day] == 3       # without the late row
        late = sj.stream_late_rows(in_batches(spark, METRIC_SCHEMA, batches), day, None if slide is None else day // 4)
        rows = spark.read.parquet(sj.run_append(late, sj.new_run_dir(spark, "late"))).collect()
        assert {r.id: (r.missed, r.windows) for r in rows} == missed


def test_complete_results_are_versions(spark):
    from slimwire.streaming import jobs as sj
    out = sj.new_run_dir(spark, "versions")
    for v in (0, 1, 2):
        spark.range(v + 1).write.parquet(f"{out}/version={v}")
    spark.range(9).write.parquet(f"{out}/version=10/unfinished")   # a version without _SUCCESS of its own
    assert sj.read_newest(spark, out).count() == 3


def test_g4_batches_are_as_many_as_slices_not_as_files(spark, monkeypatch):
    import os

    from slimwire.plans.queries_stream import SLICES, q_g4
    from slimwire.streaming import jobs as sj
    outs, run = set(), sj.run_append
    monkeypatch.setattr(sj, "run_append", lambda stream, out, **more: outs.add(out) or run(stream, out, **more))
    cut = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}   # dozens of files a slice
    before = {k: spark.conf.get(k) for k in cut}
    for k, v in cut.items():
        spark.conf.set(k, v)
    try:
        rows = q_g4(spark, SF_SMALL).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    batches = [b for out in outs for b in os.listdir(out) if b.startswith("batch_id=")]
    assert rows and SLICES <= len(batches) <= 2 * SLICES   # with the one without rows after each, in which timers run out
