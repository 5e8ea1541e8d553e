"""More of the reference's own test vectors: summaries, log lines, registry, history."""

from pyspark.sql import functions as F

from slimwire.operators import context as cx
from slimwire.operators import metrics as mx
from slimwire.operators import sessions as hs
from slimwire.sources import snapshot as snap


def test_summary_rounding_and_log_line(spark):
    m = spark.createDataFrame([(0, 0, "p", "claude-opus-4-8", "s", 200, 150, 50, 12.345),
                               (1, 0, "p", "m", "s", 0, 0, 0, 1.0)], snap.METRICS_SCHEMA)
    s = {r.id: r for r in mx.request_summary(m).collect()}
    assert s[0].saved_pct == 25.0 and s[0].duration_ms == 12.35 and s[1].saved_pct == 0.0
    lines = {r.id: r.line for r in mx.log_line(m).collect()}
    for part in ("model=claude-opus-4-8", "before=200", "after=150", "saved=50", "(25.0%)", "12.3ms"):
        assert part in lines[0]
    assert "(0.0%)" in lines[1]


def test_registry_ids_are_stable_and_session_isolated(spark):
    seen = spark.createDataFrame([("s1", "h1", 1), ("s1", "h1", 2), ("s1", "h2", 3), ("s2", "h1", 4)]
                                 + [("s3", f"x{i}", 10 + i) for i in range(40)],
                                 "session_id string, hash string, at_ms long")
    reg = {(r.session_id, r.hash): r.ctx_id for r in cx.registry_register(seen, ["at_ms"]).collect()}
    assert reg[("s1", "h1")] == "ctx_0" and reg[("s1", "h2")] == "ctx_1" and reg[("s2", "h1")] == "ctx_2"
    assert reg[("s3", "x7")] == "ctx_a" and reg[("s3", "x33")] == "ctx_10"   # base 36
    look = spark.createDataFrame([("s1", "h1"), ("s2", "h2"), ("s9", "h1")], "session_id string, hash string")
    got = {(r.session_id, r.hash): r.ctx_id for r in
           cx.registry_lookup(look, cx.registry_register(seen, ["at_ms"])).collect()}
    assert got == {("s1", "h1"): "ctx_0", ("s2", "h2"): None, ("s9", "h1"): None}


def test_history_resume_and_list(spark):
    msgs = "array<struct<msg_idx:long,block_idx:long,role:string,type:string,text:string>>"
    t = spark.createDataFrame(
        [("s1", 1000, 1, "claude-opus-4-8", 10, [(0, 0, "user", "text", "hello")]),
         ("s1", 2000, 2, "claude-opus-4-8", 3, [(0, 0, "user", "text", "hello"), (1, 0, "assistant", "text", "hi")]),
         ("old", 10, 3, "m", 1, []), ("new", 5000, 4, "m", 1, [])],
        f"session_id string, at_ms long, request_id long, model string, tokens long, messages {msgs}")
    cp = hs.resume_sessions(t, cap=10).where(F.col("session_id") == "s1").first()
    assert cp.turns == 2 and cp.total_tokens == 13 and cp.first_seen == 1000 and cp.last_active == 2000
    assert len(cp.messages) == 2 and [x["index"] for x in cp.timeline] == [0, 1]
    assert [r.session_id for r in hs.list_sessions(t).collect()] == ["new", "s1", "old"]
    assert hs.resume_sessions(t).where(F.col("session_id") == "nope").count() == 0
    kept = hs.purge_sessions(t, spark.createDataFrame([("s1",)], "session_id string"))
    assert {r.session_id for r in kept.collect()} == {"old", "new"}
    assert hs.purge_sessions(t, None).count() == 0
