"""Sequence numbering under skew, sessions, metrics, context store and snapshots."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from slimwire.operators import context as cx
from slimwire.operators import metrics as mx
from slimwire.operators import sessions as hs
from slimwire.plans.sequence import sequence
from slimwire.sources import snapshot as snap


def test_sequence_matches_row_number_with_a_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot" if i % 3 == 0 else f"g{rnd.randrange(40)}", i, rnd.randrange(1000)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, t long")
    got = sequence(df, ["t", "id"], "seq", group="g", num_partitions=7)
    want = df.withColumn("seq", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")) - 1)
    a = {(r.g, r.id): r.seq for r in got.collect()}
    b = {(r.g, r.id): r.seq for r in want.collect()}
    assert a == b
    glob = sequence(df, ["t", "id"], "seq", num_partitions=5).collect()
    assert sorted(r.seq for r in glob) == list(range(3000))


def turns_df(spark, rows):
    return spark.createDataFrame(
        [(s, at, rid, m, tok, []) for s, at, rid, m, tok in rows],
        "session_id string, at_ms long, request_id long, model string, tokens long, "
        "messages array<struct<msg_idx:long,block_idx:long,role:string,type:string,text:string>>")


def test_timeline_cap_keeps_newest_and_true_indexes(spark):
    t = turns_df(spark, [("a", i * 10, i, "m", 5, ) for i in range(4)])
    tl = hs.timeline(t, cap=2).orderBy("index").collect()
    assert [r["index"] for r in tl] == [2, 3]
    res = hs.resume_sessions(t, cap=2).first()
    assert res.turns == 2 and res.all_turns == 4 and res.total_tokens == 20
    assert res.first_seen == 0 and res.last_active == 30


def test_session_state_latest_model_and_unknown_resume(spark):
    t = turns_df(spark, [("a", 1, 1, "m1", 3), ("a", 5, 2, "m2", 4), ("b", 2, 3, "m3", 1)])
    st = {r.session_id: r for r in hs.session_state(t).collect()}
    assert st["a"].model == "m2" and st["a"].total_tokens == 7 and st["a"].turns == 2
    assert hs.resume_sessions(t).where(F.col("session_id") == "zzz").count() == 0
    listed = [r.session_id for r in hs.list_sessions(t).collect()]
    assert listed == ["a", "b"]


def test_metrics_rounding_ring_and_recent(spark):
    rows = [(i, i, "p", "m" if i % 2 else "n", "s", 100, 60, 40, 5.0) for i in range(1100)]
    m = spark.createDataFrame(rows, snap.METRICS_SCHEMA)
    tot = mx.metrics_total(mx.ring_buffer(m)).first()
    assert tot.requests == 1000 and tot.saved_pct == 40.0 and tot.avg_duration_ms == 5.0
    assert mx.recent_requests(m, 0).count() == 0
    assert [r.id for r in mx.recent_requests(m, 3).collect()] == [1099, 1098, 1097]
    empty = mx.metrics_total(m.limit(0)).first()
    assert empty.saved_pct == 0.0 and empty.avg_duration_ms == 0.0
    try:
        mx.recent_requests(m, -1)
        raise AssertionError("negative limit must fail")
    except ValueError:
        pass


def test_context_store_put_get_labels(spark):
    puts = spark.createDataFrame([("hello", "first", 1), ("hello", "", 2), ("hello", "second", 3),
                                  ("other", "", 4), ("", "x", 5)], "content string, label string, at_ms long")
    store, rejected = cx.context_put(puts)
    assert rejected.count() == 1
    rows = {r.content: r for r in store.collect()}
    assert rows["hello"].label == "second" and rows["hello"].bytes == 5 and rows["hello"].puts == 3
    assert rows["hello"].id.startswith("ctx_") and rows["other"].label is None
    ids = spark.createDataFrame([(rows["hello"].id,), ("ctx_nope",)], "id string")
    got = {r.id: r.status for r in cx.context_get(ids, store).collect()}
    assert got == {rows["hello"].id: "ok", "ctx_nope": "not_found"}


def test_snapshot_versions_and_missing_paths(spark, tmp_path):
    base = str(tmp_path / "snap")
    assert snap.read_snapshot(spark, base, snap.METRICS_SCHEMA).count() == 0
    m = spark.createDataFrame([(i, i, "p", "m", "s", 1, 1, 0, 1.0) for i in range(5)], snap.METRICS_SCHEMA)
    snap.write_snapshot(m, base)
    assert snap.read_snapshot(spark, base, snap.METRICS_SCHEMA).count() == 5
    snap.write_snapshot(m.limit(0), base)   # clear = an empty newer version
    assert snap.read_snapshot(spark, base, snap.METRICS_SCHEMA).count() == 0
    (tmp_path / "state").mkdir()
    (tmp_path / "state" / "a.json").write_text('{"id": 1, "model": "m"}\n{not json\n')
    got = snap.read_json_state(spark, str(tmp_path / "state"), snap.METRICS_SCHEMA)
    assert len(got.collect()) == 1
    assert snap.read_json_state(spark, str(tmp_path / "absent"), snap.METRICS_SCHEMA).count() == 0


def test_config_change_log_to_intervals_and_asof(spark):
    from slimwire.plans.config_asof import config_as_of, intervals_from_changes
    cols = "at_ms long, cache boolean, dedup boolean, strip boolean, filediff boolean, slice boolean, " \
           "intent boolean, min_savings long, store boolean"
    changes = spark.createDataFrame([(0, True, False, True, False, False, False, 32, True),
                                     (100, True, True, True, False, False, False, 10, False)], cols)
    reqs = spark.createDataFrame([(1, 5), (2, 100), (3, 250)], "request_id long, at_ms long")
    got = {r.request_id: (r.dedup, r.min_savings, r.store)
           for r in config_as_of(reqs, intervals_from_changes(changes)).collect()}
    assert got == {1: (False, 32, True), 2: (True, 10, False), 3: (True, 10, False)}


def test_config_asof_does_not_multiply_blocks(spark, monkeypatch):
    """More than 50,000 intervals and several blocks a request: the same totals as with one interval a day."""
    from conftest import blocks_df
    from slimwire.plans import config_asof as ca
    from slimwire.plans.reduce import Config, reduce_requests
    rows = [dict(request_id=i, session_id=f"s{i % 3}", at_ms=i * 1000, block_idx=k, text="a text of some length " * 9) for i in range(40) for k in range(4)]
    blocks = blocks_df(spark, rows)
    settings = ["true AS cache", "true AS dedup", "true AS strip", "false AS filediff", "false AS slice", "false AS intent", "32L AS min_savings", "true AS store"]
    many = spark.range(60_000).selectExpr("id * 1000 AS valid_from_ms", "(id + 1) * 1000 AS valid_to_ms", *settings)
    one = spark.range(1).selectExpr("0L AS valid_from_ms", f"{ca.OPEN_END}L AS valid_to_ms", *settings)
    got = [sorted((r.session_id, r.request_id, r.tokens_before, r.tokens_after, r.blocks_in) for r in reduce_requests(blocks, Config(), config_log=log).requests.collect())
           for log in (many, one)]
    assert got[0] == got[1] and len(got[0]) == 40 and all(r[4] == 4 for r in got[0])
    assert ca.config_as_of(blocks, many).count() == 160


SETTINGS = "cache boolean, dedup boolean, strip boolean, filediff boolean, slice boolean, intent boolean, min_savings long, store boolean"


def test_config_asof_both_ways_against_brute_force(spark, monkeypatch):
    """A log taken along and a log merged in ranges give the same; wrong timestamps, gaps, ties and nulls included."""
    import random
    from slimwire.plans import config_asof as ca
    random.seed(2)
    at = sorted(random.sample(range(1000), 60))
    log = [(a, b if i % 5 else a + (b - a) // 2, i % 2 == 0, i % 3 == 0, True, False, False, False, i, i % 7 == 0)
           for i, (a, b) in enumerate(zip(at, at[1:]))] + [(at[-1], ca.OPEN_END, True, True, True, True, True, True, 99, True), (at[3], at[3], None, None, None, None, None, None, -1, None)]
    cfg = spark.createDataFrame(log, "valid_from_ms long, valid_to_ms long, " + SETTINGS)
    times = [random.randrange(-50, 1100) for _ in range(300)] + [500] * 300 + [None, 1 << 60, -(1 << 60), *at]
    reqs = spark.createDataFrame(list(enumerate(times)), "request_id long, at_ms long").repartition(3)
    want = {}
    for i, t in enumerate(times):
        hit = [r[2:] for r in log if t is not None and r[0] <= t < r[1]]
        want[i] = hit[0] if hit else (None,) * 8
    for bound in (ca.TAKEN_ALONG, 10):
        monkeypatch.setattr(ca, "TAKEN_ALONG", bound)
        out = ca.config_as_of(reqs, cfg)
        assert out.columns == ["request_id", "at_ms", *ca.CONFIG_COLS]
        assert {r.request_id: tuple(r)[2:] for r in out.collect()} == want
        assert ca.config_as_of(reqs.limit(0), cfg).count() == 0
        none = ca.config_as_of(reqs, cfg.limit(0)).collect()
        assert len(none) == len(times) and all(r.store is None for r in none)


def test_a_config_taken_along_reads_rows_once_and_moves_none(spark):
    from slimwire.plans import config_asof as ca
    from slimwire.sources import tables as tb
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_id").alias("request_id"), (F.col("event_id") * 1000).alias("at_ms"))
    plan = ca.config_as_of(rows, tb.config_log(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan and "sequence" not in plan.lower()


def test_last_known_values_cross_the_borders(spark):
    import random
    from slimwire.plans.ordered import last_known, numbered
    random.seed(7)
    rows = [(random.choice(["a", "b", None, "hot", "hot", "hot"]), i, random.choice([None, None, None, i])) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, t long, v long").repartition(5)
    got = {r.t: r.o and r.o.v for r in last_known(df, ["t"], F.col("v").isNotNull(), ["v"], "o", ["g"]).collect()}
    last, want = {}, {}
    for g, t, v in rows:
        last[g] = v if v is not None else last.get(g)
        want[t] = last[g]
    assert got == want
    at = numbered(df.select("g"), ["g"], "at").collect()
    assert sorted(r.at for r in at) == list(range(900)) and [r.g for r in sorted(at, key=lambda r: r.at)] == sorted((g for g, *_ in rows), key=lambda g: (g is not None, g))


def test_change_log_over_many_days(spark):
    from slimwire.plans import config_asof as ca
    at = [5, 90_000_000, 90_000_001, 700_000_000]
    changes = spark.createDataFrame([(t, i) for i, t in enumerate(at)], "at_ms long, min_savings long")
    got = sorted((r.valid_from_ms, r.valid_to_ms) for r in ca.intervals_from_changes(changes).collect())
    assert got == list(zip(at, [*at[1:], ca.OPEN_END]))


def test_sequence_ids_outlive_a_clear(spark, tmp_path):
    from slimwire.operators import metrics as mx
    from slimwire.sources.snapshot import METRICS_SCHEMA
    rows = [(i, i, "p", "m", "s", 1, 1, 0, 1.0) for i in (3, 4, 8)]
    path = str(tmp_path / "metrics")
    assert mx.restore_sequence(spark, path) == 0
    mx.snapshot_metrics(spark.createDataFrame(rows, METRICS_SCHEMA), path)
    assert mx.restore_sequence(spark, path) == 9
    mx.snapshot_metrics(spark.createDataFrame(rows[:1], METRICS_SCHEMA), path, next_id=20)
    assert mx.restore_sequence(spark, path) == 20
    mx.clear_metrics(spark, path)
    assert mx.restore_sequence(spark, path) == 0


def test_store_gate_with_a_filter_on_the_setting(spark):
    from conftest import SF_SMALL
    from slimwire.plans.config_asof import config_as_of
    from slimwire.plans.queries_stages import q_h8
    from slimwire.sources import tables as tb
    blocks = tb.request_blocks(spark, SF_SMALL)
    log = [tuple(r) for r in tb.config_log(spark).select("valid_from_ms", "valid_to_ms", "store").collect()]

    def kept(at):
        return all(store for lo, hi, store in log if lo <= at < hi)

    met = config_as_of(blocks, tb.config_log(spark)).where(F.coalesce(F.col("store"), F.lit(True))).select("request_id", "at_ms")
    want = sorted((r.request_id, r.at_ms) for r in blocks.select("request_id", "at_ms").collect() if kept(r.at_ms))
    assert want and sorted(map(tuple, met.collect())) == want
    assert {r.session_id for r in q_h8(spark, SF_SMALL).collect()} == {r.session_id for r in blocks.collect() if kept(r.at_ms)}
