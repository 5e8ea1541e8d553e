"""Registered queries for metrics (M*) and sessions (H*)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.operators import metrics as mx
from slimwire.operators import sessions as hs
from slimwire.plans import oracle_views as ov
from slimwire.registry import register
from slimwire.session import checkpoint_dir
from slimwire.sources import snapshot as snap
from slimwire.sources import tables as tb

RM = ov.with_views("request_metrics")
M_COLS = "id, at_ms, provider, model, session_id, tokens_before, tokens_after, saved, duration_ms"


def _rm(spark: SparkSession, d: str) -> DataFrame:
    return tb.request_metrics(spark, d)


def _scratch(spark: SparkSession, name: str) -> str:
    import uuid
    return os.path.join(checkpoint_dir(spark).replace("file:", ""), f"{name}-{uuid.uuid4().hex[:12]}")


# --------------------------------------------------------------------------- metrics
@register("m1_metric_record", ov.with_views("requests") + """
SELECT CAST(row_number() OVER (ORDER BY at_ms, request_id) - 1 AS BIGINT) AS id,
       request_id, session_id, at_ms FROM requests""")
def q_m1(spark, d):
    r = tb.requests(spark, d).select("request_id", "session_id", "at_ms")
    return mx.assign_sequential_ids(r, ["at_ms", "request_id"]).select("id", "request_id", "session_id", "at_ms")


@register("m2_ring_buffer", RM + f"\nSELECT {M_COLS} FROM request_metrics ORDER BY id DESC LIMIT 1000")
def q_m2(spark, d):
    return mx.ring_buffer(_rm(spark, d))


TOTAL_SQL = """SELECT CAST(count(*) AS BIGINT) AS requests,
       CAST(coalesce(sum(tokens_before), 0) AS BIGINT) AS tokens_before,
       CAST(coalesce(sum(tokens_after), 0) AS BIGINT) AS tokens_after,
       CAST(coalesce(sum(saved), 0) AS BIGINT) AS saved,
       CASE WHEN sum(tokens_before) > 0 THEN floor(sum(saved) / sum(tokens_before) * 100 * 10 + 0.5) / 10
            ELSE 0.0 END AS saved_pct,
       CASE WHEN count(*) > 0 THEN floor(sum(duration_ms) / count(*) * 10 + 0.5) / 10 ELSE 0.0 END
         AS avg_duration_ms
FROM {src}"""


@register("m3_metrics_total", RM + "\n" + TOTAL_SQL.format(src="request_metrics"))
def q_m3(spark, d):
    return mx.metrics_total(_rm(spark, d))


@register("m3_metrics_total_ring", RM + ",\n ring AS (SELECT * FROM request_metrics ORDER BY id DESC LIMIT 1000)\n"
          + TOTAL_SQL.format(src="ring"))
def q_m3_ring(spark, d):
    return mx.metrics_total(mx.ring_buffer(_rm(spark, d)))


@register("m4_metrics_by_model", RM + """
SELECT model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens_before) AS BIGINT) AS tokens_before,
       CAST(sum(saved) AS BIGINT) AS saved,
       CAST(row_number() OVER (ORDER BY sum(tokens_before) DESC, min(id)) - 1 AS BIGINT) AS rank
FROM request_metrics GROUP BY model""")
def q_m4(spark, d):
    return mx.metrics_by_model(_rm(spark, d))


@register("m5_recent_requests", RM + f"\nSELECT {M_COLS} FROM request_metrics ORDER BY id DESC LIMIT 50")
def q_m5(spark, d):
    return mx.recent_requests(_rm(spark, d))


@register("m6_request_summary", RM + """
SELECT id, tokens_before, tokens_after, saved,
       CASE WHEN tokens_before > 0 THEN floor(saved / tokens_before * 100 * 10 + 0.5) / 10 ELSE 0.0 END
         AS saved_pct,
       floor(duration_ms * 100 + 0.5) / 100 AS duration_ms
FROM request_metrics""")
def q_m6(spark, d):
    return mx.request_summary(_rm(spark, d))


def _fixed1(x: str) -> str:
    """The exact binary value to one decimal, halves away from zero."""
    v = f"abs(CAST({x} AS DOUBLE))"
    u = f"(({v} - floor({v})) * 4503599627370496)"
    n = (f"(CAST(floor({v}) AS BIGINT) * 10 + ((CAST(floor({u}) AS BIGINT) * 10 + CAST(floor(({u} - floor({u})) * 10) AS BIGINT)"
         f" + 2251799813685248) >> 52))")
    return f"concat(CASE WHEN {x} < 0 AND {n} > 0 THEN '-' ELSE '' END, CAST({n} // 10 AS VARCHAR), '.', CAST({n} % 10 AS VARCHAR))"


@register("m7_log_line", RM + f"""
SELECT id, concat('{mx.LOG_PREFIX} model=', model, ' before=', tokens_before, ' after=', tokens_after, ' saved=', saved, ' (',
                  {_fixed1("CASE WHEN tokens_before > 0 THEN saved / tokens_before * 100 ELSE 0.0 END")}, '%) ', {_fixed1("duration_ms")}, 'ms') AS line
FROM request_metrics""")
def q_m7(spark, d):
    return mx.log_line(_rm(spark, d))


@register("m8_savings_share", RM + """,
 bm AS (SELECT model, sum(tokens_before) AS tb, sum(saved) AS sv FROM request_metrics GROUP BY model)
SELECT model, tb / greatest(max(tb) OVER (), 1) * 100 AS width_pct,
       least(greatest(CASE WHEN tb > 0 THEN sv / tb * 100 ELSE 0.0 END, 0.0), 100.0) AS saved_pct_clamped
FROM bm""")
def q_m8(spark, d):
    return mx.savings_share(mx.metrics_by_model(_rm(spark, d)))


@register("m9_metrics_snapshot", RM + f"\nSELECT {M_COLS} FROM request_metrics ORDER BY id DESC LIMIT 1000")
def q_m9(spark, d):
    path = _scratch(spark, "metrics")
    mx.snapshot_metrics(_rm(spark, d), path)
    return mx.restore_metrics(spark, path)


@register("m9_metrics_sequence", RM + "\nSELECT CAST(max(id) + 1 AS BIGINT) AS next_id, CAST(0 AS BIGINT) AS after_clear FROM request_metrics")
def q_m9_sequence(spark, d):
    path = _scratch(spark, "metrics")
    mx.snapshot_metrics(_rm(spark, d), path)
    kept = mx.restore_sequence(spark, path)
    mx.clear_metrics(spark, path)
    return spark.createDataFrame([(kept, mx.restore_sequence(spark, path))], "next_id long, after_clear long")


@register("m10_clear_metrics", RM + f"\nSELECT {M_COLS} FROM request_metrics WHERE false")
def q_m10(spark, d):
    path = _scratch(spark, "metrics")
    mx.snapshot_metrics(_rm(spark, d), path)
    mx.clear_metrics(spark, path)
    return snap.read_snapshot(spark, path, snap.METRICS_SCHEMA)


@register("m11_session_spend", RM + """
SELECT provider, session_id, CAST(count(*) AS BIGINT) AS requests,
       CAST(sum(tokens_before) AS BIGINT) AS tokens_before, CAST(sum(tokens_after) AS BIGINT) AS tokens_after,
       CAST(sum(saved) AS BIGINT) AS saved
FROM request_metrics GROUP BY provider, session_id""")
def q_m11(spark, d):
    return mx.session_spend(_rm(spark, d))


@register("m11_spend_rollup", RM + """
SELECT provider, model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens_before) AS BIGINT) AS tokens_before,
       CAST(sum(saved) AS BIGINT) AS saved, CAST(grouping(provider, model) AS BIGINT) AS level
FROM request_metrics GROUP BY ROLLUP (provider, model)""")
def q_m11_rollup(spark, d):
    return mx.spend_rollup(_rm(spark, d))


# --------------------------------------------------------------------------- sessions
def _turns(spark: SparkSession, d: str) -> DataFrame:
    return hs.build_turns(tb.request_blocks(spark, d))


TURNS = ov.with_views("request_blocks") + f""",
 turns AS (SELECT session_id, request_id, any_value(at_ms) AS at_ms, any_value(model) AS model,
                  CAST(sum({ov.tok_sql('text')}) AS BIGINT) AS tokens,
                  CAST(count(*) FILTER (WHERE section='message') AS BIGINT) AS n_blocks
           FROM request_blocks GROUP BY session_id, request_id),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, request_id) - 1 AS idx,
                   row_number() OVER (PARTITION BY session_id ORDER BY at_ms DESC, request_id DESC) AS rev
            FROM turns),
 state AS (SELECT session_id, max(CASE WHEN rev=1 THEN model END) AS model,
                  CAST(count(*) AS BIGINT) AS turns, min(at_ms) AS first_seen,
                  max(CASE WHEN rev=1 THEN at_ms END) AS last_active,
                  CAST(sum(tokens) AS BIGINT) AS total_tokens,
                  max(CASE WHEN rev=1 THEN n_blocks END) AS n_blocks
           FROM ranked GROUP BY session_id)"""


@register("h1_session_append", TURNS + """
SELECT session_id, model, turns, first_seen, last_active, total_tokens, n_blocks FROM state""")
def q_h1(spark, d):
    st = hs.session_state(_turns(spark, d))
    return st.select("session_id", "model", "turns", "first_seen", "last_active", "total_tokens",
                     F.size("messages").cast("bigint").alias("n_blocks"))


@register("h2_turn_index", TURNS + "\nSELECT session_id, request_id, CAST(idx AS BIGINT) AS turn_index FROM ranked")
def q_h2(spark, d):
    from slimwire.plans.sequence import sequence
    t = _turns(spark, d).select("session_id", "request_id", "at_ms")
    return sequence(t, ["at_ms", "request_id"], "turn_index", group="session_id").select(
        "session_id", "request_id", "turn_index")


@register("h3_timeline_cap", TURNS + """
SELECT session_id, request_id, CAST(idx AS BIGINT) AS "index", model, tokens, at_ms FROM ranked WHERE rev <= 2""")
def q_h3(spark, d):
    return hs.timeline(_turns(spark, d), cap=2)


@register("h4_resume_session", TURNS + """
SELECT s.session_id, s.model, CAST(least(s.turns, 3) AS BIGINT) AS turns, s.turns AS all_turns,
       s.first_seen, s.last_active, s.total_tokens, s.n_blocks,
       CAST(r.idx AS BIGINT) AS first_kept_index
FROM state s JOIN ranked r ON r.session_id = s.session_id AND r.rev = least(s.turns, 3)""")
def q_h4(spark, d):
    res = hs.resume_sessions(_turns(spark, d), cap=3)
    return res.select("session_id", "model", "turns", "all_turns", "first_seen", "last_active", "total_tokens",
                      F.size("messages").cast("bigint").alias("n_blocks"),
                      F.col("timeline")[0]["index"].alias("first_kept_index"))


@register("h5_list_sessions", TURNS + """
SELECT session_id, model, turns, last_active, total_tokens, first_seen FROM state""")
def q_h5(spark, d):
    return hs.list_sessions(_turns(spark, d))


def _toxic_sessions(spark: SparkSession, d: str) -> DataFrame:
    lab = tb.read_table(spark, d, "labels")
    return lab.where(F.col("toxic") == 1).select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("session_id"))


@register("h6_purge_sessions", TURNS + """
SELECT t.session_id, t.request_id, t.tokens FROM turns t
WHERE t.session_id NOT IN (SELECT concat('s', CAST(doc_id AS VARCHAR)) FROM labels WHERE toxic = 1)""")
def q_h6(spark, d):
    kept = hs.purge_sessions(_turns(spark, d), _toxic_sessions(spark, d))
    return kept.select("session_id", "request_id", "tokens")


@register("h7_ttl_purge", TURNS + """
SELECT session_id, model, turns, last_active, total_tokens FROM state
WHERE last_active >= (SELECT max(last_active) FROM state) - 30000000""")
def q_h7(spark, d):
    kept = hs.ttl_purge(_turns(spark, d), ttl_ms=30_000_000)
    return kept.select("session_id", "model", "turns", "last_active", "total_tokens")


@register("h9_history_snapshot", TURNS + """
SELECT session_id, model, first_seen, last_active, total_tokens, n_blocks, turns FROM state""")
def q_h9(spark, d):
    turns = _turns(spark, d)
    res = hs.resume_sessions(turns, cap=0).select(
        "session_id", "model", "messages", "first_seen", "last_active", "total_tokens")
    path = _scratch(spark, "sessions")
    snap.write_snapshot(res, path)
    snap.write_snapshot(hs.timeline(turns), path + "-timeline")
    state = snap.read_snapshot(spark, path, snap.SESSION_SCHEMA)
    tl = snap.read_snapshot(spark, path + "-timeline", snap.TIMELINE_SCHEMA)
    state = state.select("session_id", "model", "first_seen", "last_active", "total_tokens",
                         F.size("messages").cast("bigint").alias("n_blocks"))
    return state.join(tl.groupBy("session_id").agg(F.count(F.lit(1)).alias("turns")), "session_id", "left")


@register("h10_transcript_preview", TURNS + """,
 latest AS (SELECT session_id, request_id FROM ranked WHERE rev = 1)
SELECT b.session_id, b.msg_idx, any_value(b.role) AS role,
       coalesce(nullif(string_agg(coalesce(b.text, concat('[', 'text', ']')), ' ' ORDER BY b.block_idx), ''), '—')
         AS preview
FROM request_blocks b JOIN latest l ON l.request_id = b.request_id
WHERE b.section = 'message'
GROUP BY b.session_id, b.msg_idx""")
def q_h10(spark, d):
    return hs.transcript_preview(hs.latest_messages(_turns(spark, d)))


@register("h11_user_form_snapshot", TURNS + """
SELECT session_id, request_id, model, tokens, n_blocks FROM turns""")
def q_h11(spark, d):
    t = _turns(spark, d)
    return t.select("session_id", "request_id", "model", "tokens",
                    F.size("messages").cast("bigint").alias("n_blocks"))


EDGE_TURNS = ov.with_views("requests") + f""",
 e AS (SELECT r.*, CASE WHEN r.conv_id % 5 IN (2, 4) THEN c.text ELSE '' END AS t
       FROM requests r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn AND c.role = 'user'),
 last AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY at_ms DESC, request_id DESC) AS rev FROM e)"""


def _edge_turns(spark: SparkSession, d: str) -> DataFrame:
    from slimwire.sources import ingest as ig
    return hs.build_turns(ig.normalize(tb.edge_json(spark, d), keep_empty=True)[1])


@register("h1_requests_without_blocks", EDGE_TURNS + f"""
SELECT session_id, max(CASE WHEN rev = 1 THEN model END) AS model, CAST(count(*) AS BIGINT) AS turns, min(at_ms) AS first_seen, max(at_ms) AS last_active,
       CAST(sum({ov.tok_sql('t')}) AS BIGINT) AS total_tokens, CAST(max(CASE WHEN rev = 1 AND t <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blocks
FROM last GROUP BY session_id""")
def q_h1_edge(spark, d):
    st = hs.session_state(_edge_turns(spark, d))
    return st.select("session_id", "model", "turns", "first_seen", "last_active", "total_tokens",
                     F.size(F.filter("messages", lambda m: m["type"] != "none")).cast("bigint").alias("n_blocks"))


@register("h10_messages_without_blocks", EDGE_TURNS + """
SELECT session_id, CAST(0 AS BIGINT) AS msg_idx, 'user' AS role, CASE WHEN conv_id % 5 = 4 AND t <> '' THEN t ELSE '—' END AS preview
FROM last WHERE rev = 1 AND conv_id % 5 IN (1, 2, 4)
UNION ALL
SELECT session_id, CAST(1 AS BIGINT), 'assistant', CASE WHEN t <> '' THEN t ELSE '—' END FROM last WHERE rev = 1 AND conv_id % 5 = 2""")
def q_h10_edge(spark, d):
    return hs.transcript_preview(hs.latest_messages(_edge_turns(spark, d)))
