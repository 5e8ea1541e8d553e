"""Wire-format normalization: tolerant reads, params, headers, round trip."""

import json

from pyspark.sql import functions as F

from slimwire.sources import ingest as ig


def norm(spark, bodies, provider="anthropic"):
    log = spark.createDataFrame([(i, b, provider) for i, b in enumerate(bodies)],
                                "request_id long, body string, provider string")
    return ig.normalize(log)


def test_malformed_bodies_become_defaults(spark):
    reqs, blocks = norm(spark, ['{}', '{"messages":"nope"}', '[42,null]', '{"tools":[{}]}', '{"system":123}'])
    assert reqs.count() == 5
    b = blocks.collect()
    assert [(r.request_id, r.section, r.tool_name, r.payload) for r in b] == [(3, "tool", "", "{}")]
    assert {r.model for r in reqs.collect()} == {""}


def test_invalid_json_is_quarantined(spark):
    log = spark.createDataFrame([(1, "{bad"), (2, "{}")], "request_id long, body string")
    ok, bad = ig.quarantine(log)
    assert [r.request_id for r in bad.collect()] == [1] and ok.count() == 1


def test_valid_json_is_not_called_malformed(spark):
    deep = "[" * 1200 + "]" * 1200
    log = spark.createDataFrame([(1, '{"model":"a","model":"b"}'), (2, deep), (3, "{bad"), (4, None)], "request_id long, body string")
    ok, bad = ig.quarantine(log)
    assert [r.request_id for r in ok.collect()] == [1]
    assert {r.request_id: r.reason for r in bad.collect()} == {2: "unsupported", 3: "malformed", 4: "malformed"}
    reqs, _ = ig.normalize(log.where("request_id = 1").withColumn("provider", F.lit("openai")))
    assert reqs.first().model == "b"


def test_nested_tool_results_count_their_text(spark):
    inner = '{"type":"text","text":"abcd"}'
    for _ in range(5):
        inner = '{"type":"tool_result","tool_use_id":"t","content":[%s]}' % inner
    _, blocks = norm(spark, ['{"messages":[{"role":"user","content":[%s]}]}' % inner,
                             '{"messages":[{"role":"user","content":[{"type":"tool_result","content":[{"type":"tool_result","content":7}]}]}]}'])
    assert {r.request_id: r.text for r in blocks.collect()} == {0: "abcd", 1: ""}


def test_requests_and_messages_without_blocks_are_seen(spark):
    from slimwire.plans.reduce import Config, reduce_requests
    bodies = ['{"model":"m"}', '{"model":"m","messages":[]}', '{"model":"m","messages":[{"role":"assistant","content":[]}]}', '{"model":"m","messages":[{"content":"hi"}]}']
    log = spark.createDataFrame([(i, b, "anthropic") for i, b in enumerate(bodies)], "request_id long, body string, provider string")
    _, blocks = ig.normalize(log, keep_empty=True)
    got = {r.request_id: (r.tokens_before, r.blocks_in) for r in reduce_requests(blocks, Config()).requests.collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (1, 1)}
    empty = blocks.where("type = 'none' and section = 'message'").collect()
    assert [(r.request_id, r.msg_idx, r.role) for r in empty] == [(2, 0, "assistant")]


def bodies_of(spark, rows, **kw):
    import json
    log = spark.createDataFrame([(i, b, p) for i, (b, p) in enumerate(rows)], "request_id long, body string, provider string")
    return {r.request_id: (r.body, json.loads(r.body)) for r in ig.optimized_bodies(log, **kw).collect()}


def test_cache_marker_reaches_the_body(spark):
    out = bodies_of(spark, [('{"model":"m","system":"sys text","messages":[]}', "anthropic")])
    assert out[0][1]["system"] == [{"type": "text", "text": "sys text", "cache_control": {"type": "ephemeral"}}]


def test_untouched_requests_keep_their_raw_body(spark):
    from slimwire.plans.reduce import Config
    raw = '{ "messages" : [ {"content":"x","role":"user"} ],"model":"m" , "n":1.50}'
    out = bodies_of(spark, [(raw, "openai"), (raw, "anthropic")], config=Config(stages={"strip": False}))
    assert out[0][0] == raw and out[1][0] == raw


def test_stage_edits_of_tool_results_and_definitions_reach_the_body(spark):
    from slimwire.operators.stages import custom_stage
    body = ('{"model":"m","tools":[{"name":"f","description":"a long description","input_schema":{"type":"object"},"cache_control":{"type":"ephemeral"}},{"name":"g","input_schema":{}}],'
            '"messages":[{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":[{"type":"text","text":"long result"}]},'
            '{"type":"tool_result","tool_use_id":"u","content":[{"type":"text","text":"kept"}],"is_error":true}]}]}')

    def short(df):
        cut = F.when((F.col("type") == "tool_result") & (F.col("tool_id") == "t"), F.lit("cut")).when(F.col("tool_name") == "f", F.lit("d")).otherwise(F.col("text"))
        return df.withColumn("n_text", cut)
    out = bodies_of(spark, [(body, "anthropic")], stages=[custom_stage("cut", short, reversible=True)])[0][1]
    results = out["messages"][0]["content"]
    assert results[0]["content"] == "cut" and results[1] == {"type": "tool_result", "tool_use_id": "u", "content": [{"type": "text", "text": "kept"}], "is_error": True}
    assert out["tools"] == [{"name": "f", "description": "d", "input_schema": {"type": "object"}}, {"name": "g", "input_schema": {}}]


def test_equal_request_ids_of_two_sessions_stay_apart(spark):
    log = spark.createDataFrame([("a", '{"model":"m","messages":[{"role":"user","content":"A"}]}'), ("b", '{"model":"m","messages":[{"role":"user","content":"B"}]}')],
                                "session_id string, body string").withColumn("request_id", F.lit(1)).withColumn("provider", F.lit("openai"))
    got = {r.session_id: r.body for r in ig.optimized_bodies(log).collect()}
    assert '"A"' in got["a"] and '"B"' in got["b"] and '"B"' not in got["a"]


def test_audit_reports_what_is_lost(spark):
    bodies = ['{"system":[{"type":"text","text":"a"},{"type":"image"}],"messages":[]}', '{"messages":[{"role":"user","content":[{"type":"text","text":"a","citations":[]}]}]}',
              '{"messages":[{"role":"user","content":[{"type":"tool_result","tool_use_id":"1","content":"x","cache_control":{"type":"ephemeral"}}]}]}',
              '{"system":"s","messages":[{"role":"user","content":"x","name":"kept"}]}']
    log = spark.createDataFrame([(i, b, "anthropic") for i, b in enumerate(bodies)], "request_id long, body string, provider string")
    got = {r.request_id: (r.messages_differ, r.system_differ, r.dropped_system_blocks) for r in ig.roundtrip_audit(log).collect()}
    assert got == {0: (False, True, 1), 1: (True, False, 0), 2: (True, False, 0)}


def test_openai_params_and_inline_system(spark):
    body = ('{"model":"gpt-4o","messages":[{"role":"system","content":"be brief"},'
            '{"role":"user","content":[{"type":"text","text":"hi"},{"type":"image_url","image_url":{"url":"u"}}]},'
            '{"role":"assistant","content":null,"tool_calls":[]}],'
            '"max_completion_tokens":77,"temperature":"0.7","top_p":0.9,"stop":["x"]}')
    reqs, blocks = norm(spark, [body], "openai")
    p = reqs.first().params
    assert p.max_tokens == 77 and p.temperature is None and p.top_p == 0.9 and p.stop == ["x"]
    got = [(r.section, r.msg_idx, r.block_idx, r.role, r.type) for r in blocks.orderBy("msg_idx", "block_idx").collect()]
    assert got == [("message", 0, 0, "system", "text"), ("message", 1, 0, "user", "text"),
                   ("message", 1, 1, "user", "raw")]


def test_anthropic_system_forms_and_missing_role(spark):
    reqs, blocks = norm(spark, ['{"system":"S","messages":[{"content":"x"}]}',
                                '{"system":[{"type":"text","text":"A","cache_control":{"type":"ephemeral"}},'
                                '{"type":"image"}],"messages":[]}'])
    rows = [(r.request_id, r.section, r.role, r.text, r.cache_control) for r in
            blocks.orderBy("request_id", "section").collect()]
    assert rows == [(0, "message", "user", "x", False), (0, "system", "system", "S", False),
                    (1, "system", "system", "A", True)]


def test_headers_session_and_redaction(spark):
    df = spark.createDataFrame([({"X-Session-Id": "abc", "Authorization": "k", "accept": "a"},), ({},)],
                               "h map<string,string>")
    got = df.select(ig.session_key(F.col("h")).alias("s"), ig.redact_headers(F.col("h")).alias("r")).collect()
    assert got[0].s == "abc" and got[1].s == "default"
    assert got[0].r["Authorization"] == "***redacted***" and got[0].r["accept"] == "a"


def test_roundtrip_is_lossless_on_clean_input(spark):
    bodies = ['{"model":"m","system":"S","max_tokens":5,"messages":[{"role":"user","content":"hi"},'
              '{"role":"assistant","content":[{"type":"text","text":"ok"},'
              '{"type":"tool_use","id":"t1","name":"f","input":{"q":1}}]}],'
              '"tools":[{"name":"f","description":"d","input_schema":{"type":"object"}}]}']
    log = spark.createDataFrame([(1, bodies[0], "anthropic")], "request_id long, body string, provider string")
    assert ig.roundtrip_audit(log).count() == 0


def test_flags_require_json_true(spark):
    reqs, blocks = norm(spark, ['{"stream":"true","messages":[{"role":"user","content":[{"type":"tool_result",'
                                '"tool_use_id":"1","content":"x","is_error":"true"}]}]}',
                                '{"stream":true,"messages":[{"role":"user","content":[{"type":"tool_result",'
                                '"tool_use_id":"1","content":"x","is_error":true}]}]}'])
    assert {r.request_id: r.stream for r in reqs.collect()} == {0: False, 1: True}
    assert {r.request_id: r.is_error for r in blocks.collect()} == {0: False, 1: True}


def test_transcript_preview_shows_block_kinds(spark):
    from slimwire.operators.sessions import transcript_preview
    df = spark.createDataFrame([("s", 0, 0, "user", "text", "hi"), ("s", 0, 1, "user", "tool_result", "out"),
                                ("s", 1, 0, "assistant", "text", "")],
                               "session_id string, msg_idx long, block_idx long, role string, type string, text string")
    got = {r.msg_idx: r.preview for r in transcript_preview(df).collect()}
    assert got == {0: "hi [tool_result]", 1: "—"}


def test_denormalize_after_strip_drops_blocks(spark):
    import json
    from slimwire.plans.reduce import Config, reduce_requests
    bodies = ['{"model":"m","system":"  ","messages":[{"role":"user","content":"   "},{"role":"user","content":"hi"}]}',
              '{"model":"m","system":"keep me","messages":[{"role":"assistant","content":"   ","tool_calls":[1]}]}']
    log = spark.createDataFrame([(0, bodies[0], "anthropic"), (1, bodies[1], "openai")],
                                "request_id long, body string, provider string")
    reqs, blocks = ig.normalize(log)
    red = reduce_requests(blocks, Config(stages={"cache": False}))
    out = {r.request_id: json.loads(r.body) for r in ig.denormalize(reqs, red.blocks).collect()}
    assert "system" not in out[0] and out[0]["messages"][0]["content"] == []
    assert out[0]["messages"][1]["content"] == [{"type": "text", "text": "hi"}]
    # openai: all blocks stripped -> original content kept; extra keys and top-level keys survive
    assert out[1]["messages"][0] == {"role": "assistant", "content": "   ", "tool_calls": [1]}
    assert out[1]["system"] == "keep me"


def test_nested_tool_results_of_any_depth(spark):
    import json

    def text_of(b):
        if isinstance(b, dict) and b.get("type") == "text":
            return b.get("text") or ""
        if isinstance(b, dict) and b.get("type") == "tool_use":
            return b.get("name", "") + json.dumps(b.get("input"), separators=(",", ":"), sort_keys=True)
        if isinstance(b, dict) and b.get("type") == "tool_result":
            c = b.get("content")
            return c if isinstance(c, str) else "".join(map(text_of, c)) if isinstance(c, list) else ""
        return json.dumps(b, separators=(",", ":"), sort_keys=True)

    import random
    random.seed(1)

    def some(depth):
        kind = random.randrange(6)
        if depth and kind < 4:
            return {"type": "tool_result", "content": [some(depth - 1) for _ in range(random.randint(0, 3))]}
        return random.choice([{"type": "text", "text": "ab{c"}, {"type": "tool_use", "name": "f", "input": {"q": [1, {"r": 2}]}}, {"type": "tool_result", "content": "s,[t"},
                              {"type": "image", "source": {"a": 1}}, "plain", 7, {"type": "text"}, {"type": "tool_result", "content": 5}])
    deep = {"type": "text", "text": "bottom"}
    for k in range(50):
        deep = {"type": "tool_result", "content": [{"type": "text", "text": f"{k} "}, deep]}
    wide = {"type": "tool_result", "content": [{"type": "tool_result", "content": "x"}] * 300}
    tops = [{"type": "tool_result", "content": [some(9) for _ in range(3)]} for _ in range(40)] + [deep, wide]
    bodies = [json.dumps({"messages": [{"role": "user", "content": [t]}]}) for t in tops]
    _, blocks = norm(spark, bodies)
    assert {r.request_id: r.text for r in blocks.collect()} == {i: text_of(t) for i, t in enumerate(tops)}


def test_audit_sees_a_broken_denormalize(spark, monkeypatch):
    bodies = ['{"model":"m","system":"S","max_tokens":5,"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":[{"type":"text","text":"ok"},{"type":"tool_use","id":"t1","name":"f","input":{"q":1}}]}]}',
              '{"messages":[{"content":[{"type":"text","text":"x","cache_control":null}]}],"temperature":1e3,"top_p":0.10,"n":12345678901234567890,"z":-0.5,"w":1.0}', '{"a":1}']
    log = spark.createDataFrame([(i, b, p) for i, (b, p) in enumerate([(b, p) for b in bodies for p in ("anthropic", "openai")])], "request_id long, body string, provider string")
    got = {r.request_id: [c for c in ("messages", "system", "tools", "others") if r[f"{c}_differ"]] for r in ig.roundtrip_audit(log).collect()}
    assert got in ({}, {3: ["messages"]})    # an openai text block's null key is no part of the model
    whole = ig._block_json
    monkeypatch.setattr(ig, "_block_json", lambda anthropic: F.regexp_replace(whole(anthropic), "ok", "KO"))
    broken = {r.request_id for r in ig.roundtrip_audit(log).collect()}
    assert {0, 1} <= broken


def test_bodies_take_one_exchange_and_one_scan(spark, tmp_path):
    log = spark.createDataFrame([(1, "s", '{"model":"m","messages":[{"role":"user","content":"hi"}]}', "anthropic")], "request_id long, session_id string, body string, provider string")
    log.write.parquet(str(tmp_path / "log"))
    plan = ig.optimized_bodies(spark.read.parquet(str(tmp_path / "log")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_audit_tests_what_it_found_not_the_bodies_again(spark):
    text = json.dumps([{"role": "user" if i % 2 else "assistant", "content": f"turn {i}"} for i in range(30) if i != 7] + [{"role": "user", "content": []}, {"role": "user", "content": "last"}])
    rows = [(1, "s", 0, "anthropic", '{"model":"m","messages":' + text + "}"), (2, "s", 0, "openai", '{"model":"m","messages":' + text + "}"),
            (3, "s", 0, "anthropic", '{"system":[{"type":"image"}],"messages":' + text + "}")]
    audit = ig.roundtrip_audit(spark.createDataFrame(rows, "request_id long, session_id string, at_ms long, provider string, body string"))
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert not [line[:200] for line in plan.split("\n") if "Filter" in line[:200] and "array_join" in line]   # both bodies, at each use
    assert [(r["request_id"], r["messages_differ"], r["system_differ"]) for r in audit.collect()] == [(3, False, True)]
