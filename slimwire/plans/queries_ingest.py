"""Registered queries for ingest and codecs (I*) and block rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.plans import oracle_views as ov
from slimwire.plans.queries_state import _scratch
from slimwire.registry import register
from slimwire.sources import ingest as ig
from slimwire.sources import snapshot as snap
from slimwire.sources import tables as tb
from slimwire.functions import text as tx

BLOCK_OUT = ["request_id", "section", "msg_idx", "block_idx", "role", "type", "text", "cache_control"]

NORMALIZED_SQL = ov.with_views("request_blocks") + """,
 rb AS (SELECT b.*, r.conv_id FROM request_blocks b JOIN requests r USING (request_id)),
 msgs AS (SELECT request_id, 'message' AS section,
                 CAST(row_number() OVER (PARTITION BY request_id ORDER BY msg_idx) - 1 AS BIGINT) AS msg_idx,
                 CAST(0 AS BIGINT) AS block_idx, role, 'text' AS type, text, false AS cache_control, provider,
                 (provider = 'openai' OR role <> 'assistant') AS string_form
          FROM rb WHERE section = 'message'),
 sys AS (SELECT request_id, 'system' AS section, CAST(0 AS BIGINT) AS msg_idx,
                CAST(row_number() OVER (PARTITION BY request_id ORDER BY msg_idx) - 1 AS BIGINT) AS block_idx,
                'system' AS role, 'text' AS type, text, conv_id % 3 = 0 AS cache_control, provider,
                conv_id % 3 <> 0 AS string_form
         FROM rb WHERE section = 'system'),
 norm AS (SELECT * FROM msgs UNION ALL SELECT * FROM sys)"""


def _normalized(spark: SparkSession, d: str, provider: str | None = None):
    log = tb.request_json(spark, d)
    if provider:
        log = log.where(F.col("provider") == provider)
    return ig.normalize(log)


@register("i1_anthropic_normalize", NORMALIZED_SQL + """
SELECT request_id, section, msg_idx, block_idx, role, type, text, cache_control FROM norm
WHERE provider = 'anthropic' AND NOT (string_form AND text = '')""")
def q_i1(spark, d):
    _, blocks = _normalized(spark, d, "anthropic")
    return blocks.select(*BLOCK_OUT)


@register("i2_openai_normalize", NORMALIZED_SQL + """
SELECT request_id, section, msg_idx, block_idx, role, type, text, cache_control FROM norm
WHERE provider = 'openai' AND NOT (string_form AND text = '')""")
def q_i2(spark, d):
    _, blocks = _normalized(spark, d, "openai")
    return blocks.select(*BLOCK_OUT)


@register("i3_i4_denormalize_shape", ov.with_views("request_blocks") + """
SELECT request_id, any_value(model) AS model,
       CAST(count(*) FILTER (WHERE section = 'message') AS BIGINT) AS n_messages,
       bool_or(section = 'system') AS has_system,
       CAST(sum(length(text)) FILTER (WHERE section = 'message') AS BIGINT) AS message_chars
FROM request_blocks GROUP BY request_id""")
def q_i3_shape(spark, d):
    reqs, blocks = _normalized(spark, d)
    body = ig.denormalize(reqs, blocks)
    back_reqs, back_blocks = ig.normalize(body.join(reqs.select("request_id", "provider"), "request_id"))
    msg = back_blocks.where(F.col("section") == "message").groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_messages"), F.sum(tx.utf16_len("text")).cast("bigint").alias("message_chars"))
    sysr = back_blocks.where(F.col("section") == "system").select("request_id").distinct() \
                      .withColumn("has_system", F.lit(True))
    return (back_reqs.select("request_id", "model").join(msg, "request_id", "left").join(sysr, "request_id", "left")
                     .select("request_id", "model", F.coalesce("n_messages", F.lit(0)).cast("bigint").alias("n_messages"),
                             F.coalesce("has_system", F.lit(False)).alias("has_system"), "message_chars"))


@register("i5_roundtrip_audit", ov.with_views("requests") + """
SELECT session_id, request_id, conv_id % 6 IN (1, 2) AS messages_differ, conv_id % 6 IN (0, 3) AS system_differ,
       conv_id % 6 = 4 AS tools_differ, false AS others_differ, CAST(CASE WHEN conv_id % 6 = 0 THEN 2 ELSE 0 END AS BIGINT) AS dropped_system_blocks
FROM requests WHERE conv_id % 6 <> 5""")
def q_i5(spark, d):
    return ig.roundtrip_audit(tb.lossy_json(spark, d))


@register("i5_roundtrip_audit_clean", ov.with_views("requests") + """
SELECT session_id, request_id, true AS messages_differ, true AS system_differ, true AS tools_differ, true AS others_differ,
       CAST(0 AS BIGINT) AS dropped_system_blocks FROM requests WHERE false""")
def q_i5_clean(spark, d):
    return ig.roundtrip_audit(tb.request_json(spark, d, broken=False))


# --------------------------------------------------------------------------- P6: the body that is sent on
def _body_sql(strip: bool, mark: bool = True) -> str:
    """The bodies of ``request_json`` after cache (if ``mark``) and strip, spelled out for both providers. The keys of a body
    come back in order of their names, then model, messages and system; one unmarked system block is a string."""
    system = """concat('[{"type":"text","text":', CAST(to_json(sy.c) AS VARCHAR), ',"cache_control":{"type":"ephemeral"}}]')"""
    if not mark:  # every third conversation comes with its marker
        system = f"CASE WHEN conv_id % 3 = 0 THEN {system} ELSE CAST(to_json(sy.c) AS VARCHAR) END"
    clean = ov.clean_sql("text") if strip else "text"
    blank = f"regexp_matches({clean}, '{ov.RE_BLANK}')" if strip else "false"
    return NORMALIZED_SQL + f""",
 cl AS (SELECT n.*, r.session_id, r.conv_id, r.model, {clean} AS c, ({blank} OR (string_form AND text = '')) AS gone
        FROM norm n JOIN requests r USING (request_id)),
 sy AS (SELECT request_id, bool_or(NOT gone) AS kept, any_value(c) AS c FROM cl WHERE section = 'system' GROUP BY request_id),
 ms AS (SELECT request_id, string_agg(concat('{{"role":', CAST(to_json(role) AS VARCHAR), ',"content":',
              CASE WHEN provider = 'anthropic' AND gone THEN '[]'
                   WHEN provider = 'anthropic' THEN concat('[{{"type":"text","text":', CAST(to_json(c) AS VARCHAR), '}}]')
                   WHEN gone THEN CAST(to_json(text) AS VARCHAR) ELSE CAST(to_json(c) AS VARCHAR) END, '}}'), ',' ORDER BY msg_idx) AS m
        FROM cl WHERE section = 'message' GROUP BY request_id),
 sent AS (SELECT r.session_id, r.request_id, r.provider, r.conv_id, CASE WHEN r.provider = 'anthropic' THEN
   concat('{{"max_tokens":', CAST(1024 + conv_id % 7 AS VARCHAR), ',"stream":', CASE WHEN conv_id % 4 = 0 THEN 'true' ELSE 'false' END,
          ',"model":"', r.model, '","messages":[', coalesce(ms.m, ''), ']',
          CASE WHEN sy.kept THEN concat(',"system":', {system}) ELSE '' END, '}}')
   ELSE concat('{{', CASE WHEN conv_id % 3 = 1 THEN concat('"max_completion_tokens":', CAST(512 + conv_id % 5 AS VARCHAR))
                          ELSE concat('"max_tokens":', CAST(256 + conv_id % 5 AS VARCHAR)) END,
          ',"stop":["\\n\\n"],"temperature":', CASE WHEN conv_id % 5 = 0 THEN '"0.7"' ELSE '0.5' END,
          ',"model":"', r.model, '","messages":[', coalesce(ms.m, ''), ']}}') END AS body, sy.kept AS has_system
   FROM requests r LEFT JOIN ms USING (request_id) LEFT JOIN sy USING (request_id))"""


@register("i3_i4_denormalize", _body_sql(False, False) + " SELECT session_id, request_id, body FROM sent")
def q_i3(spark, d):
    reqs, blocks = _normalized(spark, d)
    return ig.denormalize(reqs, blocks)


@register("p6_optimized_body", _body_sql(True) + " SELECT session_id, request_id, body FROM sent")
def q_p6_body(spark, d):
    return ig.optimized_bodies(tb.request_json(spark, d))


# Only the cache stage on: whatever it can't mark keeps its raw body, whose keys are in the order they were sent in.
@register("p6_body_passthrough", _body_sql(False) + """
SELECT session_id, request_id, CASE WHEN provider = 'anthropic' AND has_system AND conv_id % 3 <> 0 THEN body END AS body,
       provider = 'anthropic' AND coalesce(has_system, false) AND conv_id % 3 <> 0 AS changed
FROM sent""")
def q_p6_passthrough(spark, d):
    from slimwire.plans.reduce import Config
    log = tb.request_json(spark, d, broken=False)
    out = ig.optimized_bodies(log, Config(stages={"strip": False}))
    raw = log.select("session_id", "request_id", F.col("body").alias("raw"))
    both = out.join(raw, ["session_id", "request_id"])
    return both.select("session_id", "request_id", F.when(F.col("body") != F.col("raw"), F.col("body")).alias("body"),
                       (F.col("body") != F.col("raw")).alias("changed"))


@register("i6_quarantine_malformed", "SELECT page_id + 1000000000 AS request_id FROM pages")
def q_i6(spark, d):
    _, bad = ig.quarantine(tb.request_json(spark, d))
    return bad.select("request_id")


@register("i7_session_key", ov.with_views("requests") + """
SELECT request_id, CASE WHEN conv_id % 5 = 0 THEN 'default' ELSE session_id END AS session_id FROM requests""")
def q_i7(spark, d):
    h = tb.header_log(spark, d)
    return h.select("request_id", ig.session_key(F.col("headers")).alias("session_id"))


@register("i8_redact_headers", ov.with_views("requests") + """,
 h AS (SELECT request_id, conv_id, session_id FROM requests)
SELECT request_id, name, value FROM (
  SELECT request_id, 'Authorization' AS name, '***redacted***' AS value FROM h WHERE conv_id % 5 <> 0
  UNION ALL SELECT request_id, 'X-Api-Key', '***redacted***' FROM h WHERE conv_id % 5 <> 0
  UNION ALL SELECT request_id, 'User-Agent', 'agent/1.0' FROM h WHERE conv_id % 5 <> 0
  UNION ALL SELECT request_id, 'x-session-id', session_id FROM h WHERE conv_id % 5 <> 0
  UNION ALL SELECT request_id, 'authorization', '***redacted***' FROM h WHERE conv_id % 5 = 0
  UNION ALL SELECT request_id, 'Anthropic-Api-Key', '***redacted***' FROM h WHERE conv_id % 5 = 0
  UNION ALL SELECT request_id, 'accept', 'application/json' FROM h WHERE conv_id % 5 = 0)""")
def q_i8(spark, d):
    h = tb.header_log(spark, d)
    return h.select("request_id", F.explode(ig.redact_headers(F.col("headers"))).alias("name", "value"))


@register("i9_sampling_params", ov.with_views("requests") + """
SELECT request_id,
       CAST(CASE WHEN provider = 'anthropic' THEN 1024 + conv_id % 7
                 WHEN conv_id % 3 = 1 THEN 512 + conv_id % 5 ELSE 256 + conv_id % 5 END AS BIGINT) AS max_tokens,
       CASE WHEN provider = 'openai' AND conv_id % 5 <> 0 THEN CAST(0.5 AS DOUBLE) END AS temperature,
       CAST(NULL AS DOUBLE) AS top_p,
       CAST(CASE WHEN provider = 'openai' THEN 1 ELSE 0 END AS BIGINT) AS n_stop,
       provider = 'anthropic' AND conv_id % 4 = 0 AS stream
FROM requests""")
def q_i9(spark, d):
    reqs, _ = _normalized(spark, d)
    return reqs.select("request_id", "params.max_tokens", "params.temperature", "params.top_p",
                       F.when(F.col("params.stop").isNull(), F.lit(0))
                        .otherwise(F.size("params.stop")).cast("bigint").alias("n_stop"), "stream")


@register("i10_block_explode", NORMALIZED_SQL + """
SELECT request_id, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars,
       CAST(max(msg_idx) AS BIGINT) AS last_msg_idx
FROM norm WHERE NOT (string_form AND text = '') GROUP BY request_id""")
def q_i10(spark, d):
    _, blocks = _normalized(spark, d)
    return blocks.groupBy("request_id").agg(F.count(F.lit(1)).alias("blocks"),
                                            F.sum(tx.utf16_len("text")).cast("bigint").alias("chars"),
                                            F.max("msg_idx").cast("bigint").alias("last_msg_idx"))


@register("i11_snapshot_write_read", NORMALIZED_SQL + """
SELECT request_id, section, msg_idx, block_idx, role, type, text, cache_control FROM norm
WHERE NOT (string_form AND text = '')""")
def q_i11(spark, d):
    _, blocks = _normalized(spark, d)
    schema = blocks.schema
    path = _scratch(spark, "blocks")
    snap.write_snapshot(blocks, path)
    return snap.read_snapshot(spark, path, schema).select(*BLOCK_OUT)


@register("i12_json_state_read", ov.with_views("request_metrics") + """
SELECT id, at_ms, provider, model, session_id, tokens_before, tokens_after, saved, duration_ms FROM request_metrics""")
def q_i12(spark, d):
    path = _scratch(spark, "metrics-json")
    rm = tb.request_metrics(spark, d)
    rm.write.json(path + "/good")
    # corrupt lines: document texts are not JSON records
    tb.read_table(spark, d, "documents").select(F.col("text").alias("value")).write.text(path + "/bad")
    return snap.read_json_state(spark, path + "/*", snap.METRICS_SCHEMA)


TOOL_BLOCKS_SQL = ov.with_views("requests") + """,
 c AS (SELECT conv_id, turn, role, text,
              CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS msg_idx
       FROM conversations WHERE role <> 'system'),
 b AS (
   SELECT conv_id, msg_idx, 0 AS block_idx, 'text' AS type, text AS t FROM c WHERE role = 'assistant'
   UNION ALL SELECT conv_id, msg_idx, 1, 'tool_use', concat('search{"n":', CAST(turn AS VARCHAR), '}') FROM c
     WHERE role = 'assistant'
   UNION ALL SELECT conv_id, msg_idx, 0, 'text', text FROM c WHERE role <> 'assistant' AND turn = 0 AND text <> ''
   UNION ALL SELECT conv_id, msg_idx, 0, 'tool_result', concat(text, 'deep') FROM c WHERE role <> 'assistant' AND turn > 0
   UNION ALL SELECT conv_id, msg_idx, 1, 'raw', concat('{"n":', CAST(turn AS VARCHAR), ',"type":"image"}') FROM c
     WHERE role <> 'assistant' AND turn > 0)"""


@register("t2_block_text", TOOL_BLOCKS_SQL + """
SELECT conv_id + 2000000000 AS request_id, 'message' AS section, msg_idx, CAST(block_idx AS BIGINT) AS block_idx,
       type, """ + ov.tok_sql("t") + """ AS tokens FROM b
UNION ALL
SELECT conv_id + 2000000000, 'tool', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 'tool', CAST(8 AS BIGINT)
FROM (SELECT DISTINCT conv_id FROM conversations WHERE role <> 'system')
UNION ALL
SELECT conv_id + 2000000000, 'tool', CAST(0 AS BIGINT), CAST(1 AS BIGINT), 'tool', CAST(2 AS BIGINT)
FROM (SELECT DISTINCT conv_id FROM conversations WHERE role <> 'system')""")
def q_t2(spark, d):
    _, blocks = ig.normalize(tb.tool_json(spark, d))
    rendered = tx.render_block("type", "text", "tool_name", "payload", "rendered")
    return blocks.select("request_id", "section", "msg_idx", "block_idx", "type",
                         tx.approx_tokens(rendered).alias("tokens"))


@register("t3_tool_requests", TOOL_BLOCKS_SQL + f"""
SELECT conv_id + 2000000000 AS request_id, concat('t', CAST(conv_id AS VARCHAR)) AS session_id,
       CAST(sum({ov.tok_sql('t')}) + 10 AS BIGINT) AS tokens, CAST(count(*) + 2 AS BIGINT) AS blocks FROM b GROUP BY conv_id""")
def q_t3_tools(spark, d):
    from slimwire.operators.tokens import request_tokens
    return request_tokens(ig.normalize(tb.tool_json(spark, d))[1])


@register("t10_resend_cost_of_all_kinds", TOOL_BLOCKS_SQL + f""",
 keyed AS (SELECT conv_id, {ov.tok_sql('t')} AS tok,
                  CASE WHEN type = 'tool_use' THEN concat('u', CAST(msg_idx AS VARCHAR)) WHEN type = 'tool_result' THEN concat('r', CAST(msg_idx AS VARCHAR))
                       WHEN type = 'raw' THEN concat('x', CAST(msg_idx AS VARCHAR)) ELSE concat('t', t) END AS k FROM b),
 per AS (SELECT conv_id, k, any_value(tok) AS tok, count(*) AS n FROM keyed GROUP BY conv_id, k)
SELECT concat('t', CAST(conv_id AS VARCHAR)) AS session_id, CAST(count(*) + 2 AS BIGINT) AS distinct_texts,
       CAST(sum(tok * n) + 10 AS BIGINT) AS billed_tokens, CAST(sum(tok * (n - 1)) AS BIGINT) AS resent_tokens
FROM per GROUP BY conv_id""")
def q_t10_tools(spark, d):
    from slimwire.operators.tokens import resend_cost
    return resend_cost(ig.normalize(tb.tool_json(spark, d))[1])


EDGE_SQL = ov.with_views("requests") + f""",
 e AS (SELECT r.request_id, r.session_id, r.model, r.conv_id, CASE WHEN r.conv_id % 5 IN (2, 4) THEN c.text ELSE '' END AS t
       FROM requests r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn AND c.role = 'user'),
 x AS (SELECT *, {ov.clean_sql('t')} AS clean FROM e)"""


@register("p5_requests_without_blocks", EDGE_SQL + f"""
SELECT request_id, session_id, model, {ov.tok_sql('t')} AS tokens_before,
       CASE WHEN regexp_matches(clean, '{ov.RE_BLANK}') THEN CAST(0 AS BIGINT) ELSE {ov.tok_sql('clean')} END AS tokens_after,
       CAST(CASE WHEN t <> '' THEN 1 ELSE 0 END AS BIGINT) AS blocks_in,
       CAST(CASE WHEN regexp_matches(clean, '{ov.RE_BLANK}') THEN 0 ELSE 1 END AS BIGINT) AS blocks_out FROM x""")
def q_p5_empty(spark, d):
    from slimwire.plans.reduce import Config, reduce_requests
    red = reduce_requests(ig.normalize(tb.edge_json(spark, d), keep_empty=True)[1], Config())
    return red.requests.select("request_id", "session_id", "model", "tokens_before", "tokens_after", "blocks_in", "blocks_out")


@register("t3_requests_without_blocks", EDGE_SQL + f"""
SELECT request_id, session_id, {ov.tok_sql('t')} AS tokens, CAST(CASE WHEN t <> '' THEN 1 ELSE 0 END AS BIGINT) AS blocks FROM x""")
def q_t3_empty(spark, d):
    from slimwire.operators.tokens import request_tokens
    return request_tokens(ig.normalize(tb.edge_json(spark, d), keep_empty=True)[1])
