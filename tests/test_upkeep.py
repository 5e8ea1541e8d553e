"""Kept-up stores: pieces of a log give what the whole log gives, and untouched buckets go on as they are."""

import random

from pyspark.sql import functions as F

from slimwire.operators import context as cx
from slimwire.sources import upkeep as up


def pieces(rows, n):
    """The log in n pieces of its order, some of them empty."""
    cuts = sorted(random.randrange(len(rows) + 1) for _ in range(n - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


def test_contexts_in_pieces(spark, tmp_path):
    random.seed(1)
    rows = [(random.choice(["alpha", "beta", "", None, "gamma" * 9]) if i % 3 else f"text {i % 17}", random.choice(["", "l1", "l2", None]), i) for i in range(80)]
    store = up.context_store(spark, str(tmp_path / "c"), buckets=4)
    assert store.read().count() == 0
    for part in pieces(rows, 5):
        up.put_contexts(store, spark.createDataFrame(part, "content string, label string, at_ms long"))
    whole = cx.context_put(spark.createDataFrame(rows, "content string, label string, at_ms long"))[0]
    cols = ["id", "sha", "content", "bytes", "label", "last_put_ms", "puts"]
    assert sorted(map(tuple, store.read().select(cols).collect())) == sorted(map(tuple, whole.select(cols).collect()))


def test_contexts_are_hashed_once_a_content(spark):
    class Taken:
        def put(self, delta):
            return delta

    puts = spark.createDataFrame([("same", "", i) for i in range(50)], "content string, label string, at_ms long")
    delta = up.put_contexts(Taken(), puts)
    plan = delta._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Aggregate")   # above the grouping, not below it
    assert [(r["id"], r["bytes"], r["puts"]) for r in delta.collect()] == [("ctx_" + cx_fnv("same"), 4, 50)]


def cx_fnv(text):
    h = 0x811C9DC5
    for u in text.encode("utf-16-le")[::2]:
        h = (h ^ u) * 0x01000193 & 0xFFFFFFFF
    return format(h, "x")


def test_files_in_pieces(spark, tmp_path):
    random.seed(2)
    rows = [(random.choice("stu"), random.choice(["a.py", "b.py"]), f"text {i}", i // 2, i) for i in range(60)]
    schema = "session_id string, path string, text string, at_ms long, request_id long"
    store = up.file_store(spark, str(tmp_path / "f"), buckets=4)
    for part in pieces(rows, 4):
        up.put_files(store, spark.createDataFrame(part, schema))
    want = cx.latest_file_version(spark.createDataFrame(rows, schema))
    cols = ["session_id", "path", "text", "request_id", "puts"]
    assert sorted(map(tuple, store.read().select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_registry_numbers_go_on(spark, tmp_path):
    random.seed(3)
    rows = [(random.choice("stu"), random.choice("abcdefgh"), i) for i in range(90)]
    schema = "session_id string, hash string, at_ms long"
    store = up.registry_store(spark, str(tmp_path / "r"), buckets=4)
    for part in pieces(rows, 6):
        up.register_hashes(store, spark.createDataFrame(part, schema), ["at_ms"])
    got = {(r.session_id, r.hash): (r.seq, r.ctx_id) for r in up.registry_ids(store).collect()}
    want = {(r.session_id, r.hash): (r.seq, r.ctx_id) for r in cx.registry_register(spark.createDataFrame(rows, schema), ["at_ms"]).collect()}
    assert got == want and store.newest().next_id == len(want)
    store.clear()
    assert store.read().count() == 0
    up.register_hashes(store, spark.createDataFrame(rows[:1], schema), ["at_ms"])
    assert [r.seq for r in store.read().collect()] == [0]


def test_a_late_piece_changes_sessions_but_not_their_last_turn(spark, tmp_path):
    message = "array<struct<msg_idx:bigint,block_idx:bigint,role:string,type:string,text:string>>"
    schema = f"session_id string, request_id long, at_ms long, model string, tokens long, messages {message}"
    rows = [("s", i, i * 10, f"m{i}", 5, [(0, 0, "user", "text", f"t{i}")]) for i in (3, 1, 2)] + [("t", 9, 1, "m", 1, [])]
    turns = spark.createDataFrame(rows, schema)
    store = up.session_store(spark, str(tmp_path / "h"), turns, buckets=2)
    up.put_turns(store, turns.where("request_id <> 1"))
    up.put_turns(store, turns.where("request_id = 1"))
    r = {x.session_id: x for x in store.read().collect()}
    assert (r["s"].model, r["s"].turns, r["s"].total_tokens, r["s"].first_seen, r["s"].last_active, r["s"].messages[0].text) == ("m3", 3, 15, 10, 30, "t3")
    assert r["t"].turns == 1


def test_untouched_buckets_are_used_again_and_a_lost_writer_leaves_the_store(spark, tmp_path):
    store = up.context_store(spark, str(tmp_path / "c"), buckets=8)
    puts = spark.createDataFrame([(f"text {i}", "", i) for i in range(40)], "content string, label string, at_ms long")
    first = up.put_contexts(store, puts)
    second = up.put_contexts(store, puts.where("at_ms = 7"))
    changed = [b for b in second.written if second.written[b] != first.written[b]]
    assert len(changed) == 1 and len(second.written) == 8
    assert store.put(store.read().limit(0)) == second                 # nothing to merge, no new version
    assert {r.content: r.puts for r in store.read().collect()}["text 7"] == 2
    spark.range(1).write.parquet(f"{store.base}/version=99/bucket=0")    # files without a line in the manifest
    assert store.newest() == second and store.read().count() == 40
    # a bucket whose rows all go
    emptied = up.KeyedStore(spark, store.base, up.CONTEXT, ["sha"], lambda s: up.merge_contexts(s).where("content <> 'text 7'"), 8)
    emptied.put(store.read().where("content = 'text 7'"))
    assert store.read().where(F.col("content") == "text 7").count() == 0 and store.read().count() == 39
