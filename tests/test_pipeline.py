"""Stages, guardrail, ledger and pass-through on tiny requests (reference vectors)."""

import pytest
from pyspark.sql import functions as F

from conftest import blocks_df
from slimwire.functions import text as tx
from slimwire.operators.stages import custom_stage
from slimwire.plans.reduce import Config, reduce_requests

ALL = {k: True for k in ("cache", "dedup", "strip", "filediff", "slice", "intent")}


def texts(red, request_id=1):
    rows = (red.blocks.where((F.col("request_id") == request_id) & ~F.col("drop"))
                      .orderBy("section", "msg_idx", "block_idx").select("section", "text", "cache").collect())
    return [(r.section, r.text, r.cache) for r in rows]


def ledger(red):
    return {r.stage: r for r in red.ledger.collect()}


def test_strip_drops_blank_and_repeated_blocks_in_a_message(spark):
    header = "HEADER: read carefully"
    b = blocks_df(spark, [dict(block_idx=i, text=t) for i, t in
                          enumerate([header, "   ", header, "unique"])])
    red = reduce_requests(b, Config(stages={"cache": False}))
    assert [t for _, t, _ in texts(red)] == [header, "unique"]
    led = ledger(red)["strip"]
    assert led.saved == 6 + 1 - 0 and not led.reverted  # 6 (header) + 1 (blank "   ")


def test_strip_cleans_whitespace(spark):
    b = blocks_df(spark, [dict(text="line  \n\n\n\nmore   ")])
    red = reduce_requests(b, Config(stages={"cache": False}))
    assert texts(red)[0][1] == "line\n\nmore"


def test_system_repeats_ignore_the_cache_marker(spark):
    b = blocks_df(spark, [dict(section="system", block_idx=0, text="S"),
                          dict(section="system", block_idx=1, text="S")])
    red = reduce_requests(b, Config())
    # cache marks the last system block, strip then drops it as a repeat: the marker is lost
    assert texts(red) == [("system", "S", False)]


def test_cache_marks_last_system_block_only_for_anthropic(spark):
    rows = [dict(section="system", block_idx=0, text="a"), dict(section="system", block_idx=1, text="b")]
    red = reduce_requests(blocks_df(spark, rows), Config(stages={"strip": False}))
    assert texts(red) == [("system", "a", False), ("system", "b", True)]
    assert ledger(red)["cache"].notes == "cache_control on final system block"
    red = reduce_requests(blocks_df(spark, [dict(r, provider="openai") for r in rows]),
                          Config(stages={"strip": False}))
    assert all(not c for _, _, c in texts(red))
    assert ledger(red)["cache"].notes == "no cache breakpoint applied"
    marked = [rows[0] | {"cache_control": True}, rows[1]]
    red = reduce_requests(blocks_df(spark, marked), Config(stages={"strip": False}))
    assert ledger(red)["cache"].notes == "cache marker already present"
    assert red.requests.first().changed is False


def test_dedup_collapses_later_copy_and_keeps_first(spark):
    big = "X" * 300
    b = blocks_df(spark, [dict(msg_idx=0, text=big), dict(msg_idx=1, role="assistant", text="ok"),
                          dict(msg_idx=2, text=big)])
    red = reduce_requests(b, Config(stages={"dedup": True, "strip": False, "cache": False}))
    got = texts(red)
    assert got[0][1] == big and "omitted" in got[2][1] and got[2][1] == tx.OMIT_MARKER
    led = ledger(red)["dedup"]
    assert led.saved == 75 - 21 and not led.reverted and not led.reversible
    assert led.notes == "collapsed 1 duplicate block(s)"


def test_dedup_ignores_short_repeats_and_reverts(spark):
    b = blocks_df(spark, [dict(block_idx=0, text="short"), dict(block_idx=1, text="short")])
    red = reduce_requests(b, Config(stages={"dedup": True, "strip": False, "cache": False}))
    led = ledger(red)["dedup"]
    assert led.reverted and led.saved == 0 and led.notes == "reverted: saved 0 < min 32"


def test_guardrail_reverts_lossy_stage_below_min(spark):
    # a lossy custom stage that saves 10 tokens: reverted, request content unchanged
    trim = custom_stage("trim", lambda df: df.withColumn("n_text", F.substring("text", 41, 1 << 20)),
                        reversible=False)
    b = blocks_df(spark, [dict(text="y" * 400)])
    red = reduce_requests(b, Config(), stages=[trim])
    led = ledger(red)["trim"]
    assert led.reverted and led.measured == 10 and led.saved == 0
    assert led.notes == "reverted: saved 10 < min 32"
    assert texts(red)[0][1] == "y" * 400
    red = reduce_requests(b, Config(min_savings=5), stages=[trim])
    assert not ledger(red)["trim"].reverted and red.requests.first().tokens_after == 90


def test_stage_order_and_stubs(spark):
    red = reduce_requests(blocks_df(spark, [dict(text="hello")]), Config(stages=ALL))
    led = sorted(red.ledger.collect(), key=lambda r: r.ord)
    assert [r.stage for r in led] == ["cache", "dedup", "strip", "filediff", "slice", "intent"]
    stubs = {r.stage: r for r in led if r.stage in ("slice", "intent")}
    assert all(r.reverted and r.saved == 0 for r in stubs.values())


def test_unknown_and_non_boolean_toggles_are_ignored(spark):
    red = reduce_requests(blocks_df(spark, [dict(text="hello")]),
                          Config(stages={"strip": "no", "bogus": True, "cache": False}))
    assert [r.stage for r in red.ledger.collect()] == ["strip"]


def test_passthrough_flag(spark):
    b = blocks_df(spark, [dict(text="hello", provider="openai")])
    assert reduce_requests(b, Config(stages={"strip": False})).requests.first().changed is False
    assert reduce_requests(b, Config()).requests.first().changed is True


def test_filediff_sends_a_diff_of_a_changed_file(spark):
    def lines(marker):
        return "src/app.ts\n" + "\n".join(marker if i == 40 else f"const x{i} = {i};" for i in range(80))
    v1, v2 = lines("const target = 1;"), lines("const target = 2;")
    b = blocks_df(spark, [dict(request_id=1, at_ms=1, text=v1), dict(request_id=2, at_ms=2, text=v2),
                          dict(request_id=3, at_ms=3, text=v2)])
    red = reduce_requests(b, Config(stages={"filediff": True, "cache": False, "strip": False}, min_savings=0))
    assert texts(red, 1)[0][1] == v1
    t2 = texts(red, 2)[0][1]
    assert t2.startswith("src/app.ts — 81 lines, sent as a diff vs. the previous version:\n\n")
    assert "+const target = 2;" in t2 and "-const target = 1;" in t2 and len(t2) < len(v2)
    assert texts(red, 3)[0][1] == v2   # unchanged re-send is left to dedup
    red = reduce_requests(b, Config(stages={"filediff": True, "cache": False, "strip": False}, store=False))
    assert {r.notes for r in red.ledger.collect()} == {"reverted: saved 0 < min 32"}


def test_request_tokens_vector(spark):
    from slimwire.sources.ingest import normalize
    body = ('{"model":"m","system":[{"type":"text","text":"abcd"}],"messages":[{"role":"assistant","content":['
            '{"type":"text","text":"abcd"},{"type":"tool_use","id":"1","name":"ab","input":{"x":1}},'
            '{"type":"tool_result","tool_use_id":"1","content":"abcd"},{"a":1}]}],'
            '"tools":[{"name":"abcd","description":"","input_schema":{}}]}')
    nested = ('{"model":"m","messages":[{"role":"user","content":[{"type":"tool_result","tool_use_id":"1",'
              '"content":[{"type":"text","text":"abcdabcd"}]}]}]}')
    log = spark.createDataFrame([(1, body, "anthropic"), (2, nested, "anthropic")],
                                "request_id long, body string, provider string")
    _, blocks = normalize(log)
    red = reduce_requests(blocks, Config(stages={"cache": False, "strip": False}))
    got = {r.request_id: r.tokens_before for r in red.requests.collect()}
    assert got == {1: 10, 2: 2}


def test_single_exchange_plan(spark):
    """P5 keeps one hash exchange: every window is partitioned by a superset of the request. Filediff's lag
    over (session, path) brings one exchange there and one back."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        b = blocks_df(spark, [dict(text="x")])
        for stages, want in (({"dedup": True}, 1), ({"dedup": True, "filediff": True}, 3)):
            red = reduce_requests(b, Config(stages=stages))
            plan = red.requests._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == want, plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_requests_of_a_hot_session_are_spread(spark):
    red = reduce_requests(blocks_df(spark, [dict(request_id=i, session_id="default", text=f"x{i}") for i in range(200)]), Config())
    plan = red.requests._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [session_id" in plan and "request_id" in plan.split("RepartitionByExpression [")[1].split("]")[0]
    assert red.requests.count() == 200


def test_native_diff_equals_the_shortest_one_for_one_edited_region(spark):
    from slimwire.operators.diff import unified_diff, with_unified_diff

    def lines(marker, n=80, extra=""):
        return "src/app.ts\n" + "\n".join(marker if i == 40 else f"const x{i} = {i};" for i in range(n)) + extra
    pairs = [(lines("a = 1;"), lines("a = 2;")),                 # one changed line
             (lines("a"), lines("a", 83)),                       # lines appended at the end
             (lines("a", 10), lines("a", 10).replace("const x2 = 2;\n", "")),   # a line removed
             ("x\ny\n", "x\nz\n"),                               # trailing newline kept
             ("x\ny", "x\ny\n"), ("x\ny\n", "x\ny"), ("x\ny", "x\nz")]   # gained, lost, never there
    df = spark.createDataFrame([(i, "src/app.ts", a, b) for i, (a, b) in enumerate(pairs)],
                               "i long, path string, a string, b string")
    got = {r.i: r.d for r in with_unified_diff(df, "path", "a", "b", "d").collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == unified_diff("src/app.ts", a, b), i


def test_minimal_diff_option_agrees_on_one_edit(spark):
    def lines(marker):
        return "src/app.ts\n" + "\n".join(marker if i == 40 else f"const x{i} = {i};" for i in range(80))
    b = blocks_df(spark, [dict(request_id=1, at_ms=1, text=lines("t = 1;")), dict(request_id=2, at_ms=2, text=lines("t = 2;"))])
    cfg = dict(stages={"filediff": True, "cache": False, "strip": False}, min_savings=0)
    native = texts(reduce_requests(b, Config(**cfg, minimal_diff=False)), 2)[0][1]
    minimal = texts(reduce_requests(b, Config(**cfg)), 2)[0][1]
    assert native == minimal


def test_final_newline_is_a_change():
    from slimwire.operators.diff import unified_diff
    head = "--- f\tprevious\n+++ f\tcurrent\n@@ -1,2 +1,2 @@\n x\n"
    mark = "\n\\ No newline at end of file"
    assert unified_diff("f", "x\ny", "x\ny\n") == head + "-y" + mark + "\n+y"
    assert unified_diff("f", "x\ny\n", "x\ny") == head + "-y\n+y" + mark


def test_edit_script_is_shortest():
    import itertools
    from slimwire.operators.diff import edit_script
    words = [list(w) for n in range(5) for w in itertools.product("ab", repeat=n)]
    for a in words:
        for b in words:
            table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
            steps = edit_script(a, b)
            assert [a[i] for m, i, _ in steps if m != "+"] == a and [b[j] for m, _, j in steps if m != "-"] == b
            assert sum(m == " " for m, _, _ in steps) == table[-1][-1]


def test_diff_of_separate_edits_has_separate_hunks():
    from slimwire.operators.diff import unified_diff
    old = "\n".join(f"l{i}" for i in range(40)) + "\n"
    new = old.replace("l3\n", "L3\n").replace("l30\n", "l30\nnew\n")
    diff = unified_diff("f", old, new)
    assert diff.count("@@ -") == 2 and "@@ -1,8 +1,8 @@" in diff and "@@ -28,8 +28,9 @@" in diff


def test_custom_results_decide_their_own_reversibility_and_note(spark):
    def rewrite(df):
        safe = F.col("request_id") == 1
        return (df.withColumn("n_text", F.lit("x")).withColumn("n_reversible", safe)
                  .withColumn("n_note", F.when(safe, F.lit("kept a copy"))))
    stage = custom_stage("own", rewrite, reversible=False, note="lossy")
    b = blocks_df(spark, [dict(request_id=i, text="some words") for i in (1, 2)] + [dict(request_id=3, text="word " * 100)])
    led = {r.request_id: (r.reversible, r.reverted, r.notes) for r in reduce_requests(b, Config(), stages=[stage]).ledger.collect()}
    assert led == {1: (True, False, "kept a copy"), 2: (False, True, "reverted: saved 2 < min 32"), 3: (False, False, "lossy")}


def test_linear_space_script_is_as_short_as_brute_force(monkeypatch):
    import random
    from slimwire.operators import diff
    monkeypatch.setattr(diff, "GREEDY", -1)   # always by halving
    random.seed(5)
    for _ in range(300):
        a, b = ([random.choice("abcdef"[:random.randint(1, 6)]) for _ in range(random.randint(0, 40))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        steps = diff.edit_script(a, b)
        assert [a[i] for m, i, _ in steps if m != "+"] == a and [b[j] for m, _, j in steps if m != "-"] == b
        assert sum(m == " " for m, _, _ in steps) == table[-1][-1]


def test_many_differing_lines_need_little_memory():
    import random
    import time
    import tracemalloc
    from slimwire.operators.diff import apply_diff, edit_script, unified_diff
    n = 20_000
    old = [f"line {i}\n" for i in range(n)]
    moved = old[:]
    random.seed(1)
    random.shuffle(moved)
    for new in ([f"other {i}\n" for i in range(n)], moved, [random.choice("abc") + "\n" for _ in range(n)]):
        tracemalloc.start()
        begun = time.time()
        steps = edit_script(old, new)
        assert tracemalloc.get_traced_memory()[1] < 200e6 and time.time() - begun < 60
        tracemalloc.stop()
        assert sum(m != "+" for m, *_ in steps) == n and sum(m != "-" for m, *_ in steps) == n
        assert apply_diff("".join(old), unified_diff("f", "".join(old), "".join(new))) == "".join(new)


def test_diffs_turn_one_text_into_the_other():
    import random
    from slimwire.operators.diff import apply_diff, unified_diff
    random.seed(6)
    for _ in range(400):
        a, b = ("".join(random.choice(["x\n", "y\n", "\n", "  z\n", "x"]) for _ in range(random.randint(0, 30))) for _ in range(2))
        assert apply_diff(a, unified_diff("f", a, b)) == b, (a, b)
    assert apply_diff("", "--- f\tprevious\n+++ f\tcurrent") == ""
    with pytest.raises(ValueError):
        apply_diff("a\n", "--- f\n+++ f\n@@ -1,1 +1,1 @@\n-b\n+c")
    with pytest.raises(ValueError):
        apply_diff("a\n", "--- f\n+++ f\n@@ nonsense")


def test_blocks_sent_as_diffs_are_restored(spark):
    from slimwire.operators.stages import restored_text
    from slimwire.operators.diff import unified_diff
    old = "src/a.py\n" + "\n".join(f"x{i}" for i in range(60)) + "\n"
    new = old.replace("x7\n", "y7\nz7\n").replace("x50\n", "")
    sent = "src/a.py — 62 lines, sent as a diff vs. the previous version:\n\n" + unified_diff("src/a.py", old, new)
    df = spark.createDataFrame([(1, sent, old), (2, new, old), (3, "plain", None), (4, None, old), (5, "a lines, sent as a diff vs. the previous version:\n\nx", old)], "i long, sent string, prev string")
    got = {r.i: r.t for r in df.select("i", restored_text(F.col("sent"), F.col("prev")).alias("t")).collect()}
    assert got == {1: new, 2: new, 3: "plain", 4: None, 5: "a lines, sent as a diff vs. the previous version:\n\nx"}


def test_distinct_versions_are_never_diffed_against_themselves(spark):
    import random
    from slimwire.operators.stages import previous_distinct_versions

    def file(name, v):
        return f"src/{name}.py\n" + f"version {v} " * 30
    random.seed(9)
    sends = [("s", 1, 1, file("a", 1)), ("s", 2, 2, file("a", 2)), ("s", 3, 3, file("a", 1)), ("s", 4, 4, file("a", 2)), ("s", 5, 5, "no file"), ("s", 5, 6, "no file")]
    sends += [(random.choice("st"), 10 + i, 10 + i, file(random.choice("ab"), random.randrange(6))) for i in range(120)]
    df = spark.createDataFrame([(*r, 0, 0) for r in sends], "session_id string, request_id long, at_ms long, text string, msg_idx long, block_idx long")
    got = {r.at_ms: (r._prev, r._prev_request) for r in previous_distinct_versions(df.repartition(3), F.col("text")).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6)] == [None, file("a", 1), None, file("a", 1), None, None]
    seen, want = {}, {}
    for s, req, at, text in sends:
        known = seen.setdefault((s, text.split("\n")[0]), [])
        if "\n" in text and text not in [t for t, _ in known]:
            known.append((text, req))
        at_ = [t for t, _ in known].index(text) if "\n" in text else 0
        want[at] = known[at_ - 1] if at_ else (None, None)
    assert got == want


def test_filediff_against_distinct_versions(spark):
    def lines(v):
        return "src/app.ts\n" + "\n".join(f"const x{i} = {v if i == 7 else i};" for i in range(60))
    rows = [dict(request_id=1, at_ms=1, text=lines(1)), dict(request_id=2, at_ms=2, block_idx=0, text=lines(1)), dict(request_id=2, at_ms=2, block_idx=1, text=lines(2)),
            dict(request_id=3, at_ms=3, block_idx=0, text=lines(1)), dict(request_id=3, at_ms=3, block_idx=1, text=lines(2))]
    cfg = dict(stages={"filediff": True, "cache": False, "strip": False}, min_savings=0)
    b = blocks_df(spark, rows)
    sent = lambda **o: ["sent as a diff" in t for _, t, _ in texts(reduce_requests(b, Config(**cfg, **o)), 3)]
    assert sent() == [True, True] and sent(distinct_versions=True) == [False, True]


def test_a_marker_is_lost_with_its_block(spark):
    rows = [dict(request_id=1, section="system", block_idx=i, text=t) for i, t in enumerate(["be kind", "be brief", "be kind"])]
    rows += [dict(request_id=2, section="system", block_idx=i, text=t) for i, t in enumerate(["be kind", "be brief"])]
    got = {r.request_id: (r.markers_added, r.markers_lost) for r in reduce_requests(blocks_df(spark, rows), Config()).requests.collect()}
    assert got == {1: (0, 1), 2: (1, 0)}
