"""Registered queries for the reduction pipeline (S*, P*) and the minimum slice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.functions import text as tx
from slimwire.plans import oracle_views as ov
from slimwire.plans.reduce import Config, reduce_requests, savings_by_model, savings_by_stage
from slimwire.registry import register
from slimwire.sources import tables as tb

OMIT = tx.OMIT_MARKER


def pipeline_sql(view: str, min_savings: int, dedup: bool = True, strip: bool = True,
                 cache: bool = True) -> str:
    """DuckDB form of cache -> dedup -> strip with measured savings and the guardrail.

    Produces CTE ``fin`` (one row per block: request keys, tok0, tok_final, dropped,
    marked) and ``req`` (one row per request).
    """
    dedup_sql = f"""
  d0 AS (SELECT *, (section='message' AND length(text)>={tx.MIN_DUP_CHARS}) AS elig FROM b0),
  d1 AS (SELECT *, elig AND row_number() OVER (PARTITION BY session_id, request_id, elig, text
                                               ORDER BY msg_idx, block_idx) > 1 AS dup FROM d0),
  d2 AS (SELECT *, CASE WHEN dup THEN '{OMIT}' ELSE text END AS text_d FROM d1),
  d3 AS (SELECT *, sum(tok0) OVER (PARTITION BY session_id, request_id)
                   - sum({ov.tok_sql('text_d')}) OVER (PARTITION BY session_id, request_id) AS saved_dedup,
                   sum(CASE WHEN dup THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, request_id) AS hits FROM d2),
  b1 AS (SELECT * REPLACE (CASE WHEN saved_dedup < {min_savings} THEN text ELSE text_d END AS text),
                CASE WHEN saved_dedup < {min_savings} THEN tok0 ELSE {ov.tok_sql('text_d')} END AS tok1 FROM d3),
""" if dedup else "  b1 AS (SELECT *, tok0 AS tok1, 0 AS saved_dedup, 0 AS hits FROM b0),\n"
    strip_sql = f"""
  s0 AS (SELECT *, {ov.clean_sql('text')} AS clean FROM b1),
  s1 AS (SELECT *, regexp_matches(clean, '{ov.RE_BLANK}') AS blank FROM s0),
  s2 AS (SELECT *, NOT blank AND row_number() OVER (
            PARTITION BY session_id, request_id, section, CASE WHEN section='system' THEN -1 ELSE msg_idx END, blank, clean
            ORDER BY msg_idx, block_idx) > 1 AS rep FROM s1),
  fin AS (SELECT *, (blank OR rep) AS dropped,
                 CASE WHEN blank OR rep THEN 0 ELSE {ov.tok_sql('clean')} END AS tok_final FROM s2),
""" if strip else f"  fin AS (SELECT *, false AS dropped, {ov.tok_sql('text')} AS tok_final FROM b1),\n"
    cache_sql = ("provider='anthropic' AND section='system' AND NOT dropped AND "
                 "(msg_idx, block_idx) = max_sys") if cache else "false"
    return f"""{ov.with_views(view)},
  b0 AS (SELECT *, {ov.tok_sql('text')} AS tok0 FROM {view}),
{dedup_sql}{strip_sql}
  sysmax AS (SELECT session_id AS ss, request_id AS sr, max((msg_idx, block_idx)) AS max_sys FROM {view}
             WHERE section='system' GROUP BY session_id, request_id),
  marked AS (SELECT fin.*, coalesce({cache_sql}, false) AS marker FROM fin
             LEFT JOIN sysmax ON sysmax.sr = fin.request_id AND sysmax.ss = fin.session_id),
  req AS (SELECT request_id, session_id, any_value(model) AS model,
                 CAST(sum(tok0) AS BIGINT) AS tokens_before, CAST(sum(tok_final) AS BIGINT) AS tokens_after,
                 CAST(sum(tok0) - sum(tok_final) AS BIGINT) AS saved,
                 CAST(count(*) AS BIGINT) AS blocks_in,
                 CAST(sum(CASE WHEN dropped THEN 0 ELSE 1 END) AS BIGINT) AS blocks_out,
                 CAST(sum(CASE WHEN marker THEN 1 ELSE 0 END) AS BIGINT) AS markers_added,
                 CAST(sum(tok1) AS BIGINT) AS tokens_dedup, any_value(saved_dedup) AS saved_dedup,
                 any_value(hits) AS hits, any_value(provider) AS provider,
                 bool_or(section = 'system') AS has_sys
          FROM marked GROUP BY session_id, request_id)"""


def _req_cols(df: DataFrame) -> DataFrame:
    return df.select("request_id", "session_id", "model", "tokens_before", "tokens_after", "saved",
                     "blocks_in", "blocks_out", "markers_added")


REQ_SELECT = ("SELECT request_id, session_id, model, tokens_before, tokens_after, saved, "
              "blocks_in, blocks_out, markers_added FROM req")


# --------------------------------------------------------------------------- minimum slice
def q_savings_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = reduce_requests(tb.request_blocks(spark, sf_dir), Config(stages={"dedup": True}))
    return savings_by_model(red)


register("m4_savings_by_model", pipeline_sql("request_blocks", 32) + """
SELECT model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens_before) AS BIGINT) AS tokens_before,
       CAST(sum(tokens_after) AS BIGINT) AS tokens_after, CAST(sum(saved) AS BIGINT) AS saved,
       CASE WHEN sum(tokens_before) > 0 THEN floor(sum(saved) / sum(tokens_before) * 100 * 10 + 0.5) / 10
            ELSE 0.0 END AS saved_pct
FROM req GROUP BY model""")(q_savings_by_model)


def q_savings_by_model_full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = reduce_requests(tb.all_blocks(spark, sf_dir), Config(stages={"dedup": True}))
    return savings_by_model(red)


register("p5_savings_by_model_full_log", pipeline_sql("all_blocks", 32) + """
SELECT model, CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens_before) AS BIGINT) AS tokens_before,
       CAST(sum(tokens_after) AS BIGINT) AS tokens_after, CAST(sum(saved) AS BIGINT) AS saved,
       CASE WHEN sum(tokens_before) > 0 THEN floor(sum(saved) / sum(tokens_before) * 100 * 10 + 0.5) / 10
            ELSE 0.0 END AS saved_pct
FROM req GROUP BY model""")(q_savings_by_model_full_log)


@register("p5_reduce_requests", pipeline_sql("request_blocks", 32) + "\n" + REQ_SELECT)
def q_reduce_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = reduce_requests(tb.request_blocks(spark, sf_dir), Config(stages={"dedup": True}))
    return _req_cols(red.requests)


@register("s6_dedup_across_messages", pipeline_sql("dup_blocks", 32, strip=False) + "\n" + REQ_SELECT)
def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = reduce_requests(tb.dup_blocks(spark, sf_dir), Config(stages={"dedup": True, "strip": False}))
    return _req_cols(red.requests)


@register("p4_guardrail_revert", pipeline_sql("dup_blocks", 500, strip=False) + "\n" + REQ_SELECT)
def q_guardrail(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = reduce_requests(tb.dup_blocks(spark, sf_dir),
                          Config(stages={"dedup": True, "strip": False}, min_savings=500))
    return _req_cols(red.requests)


@register("s4_drop_repeats_in_message", pipeline_sql("line_blocks", 32, dedup=False) + "\n" + REQ_SELECT)
def q_line_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = reduce_requests(tb.line_blocks(spark, sf_dir), Config())
    return _req_cols(red.requests)


@register("s2_clean_text", pipeline_sql("noisy_blocks", 32, dedup=False) + "\n" + REQ_SELECT)
def q_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = reduce_requests(tb.noisy_blocks(spark, sf_dir), Config())
    return _req_cols(red.requests)
