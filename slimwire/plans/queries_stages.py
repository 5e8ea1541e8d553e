"""Registered queries for token accounting (T*), single stages (S*) and the ledger (P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slimwire.functions import text as tx
from slimwire.operators import diff as df_
from slimwire.operators import tokens as tk
from slimwire.operators.stages import custom_stage
from slimwire.plans import oracle_views as ov
from slimwire.plans.queries_core import pipeline_sql
from slimwire.plans.reduce import Config, reduce_requests, savings_by_stage
from slimwire.registry import register
from slimwire.sources import tables as tb

PATH_RE2 = tx.PATH_LINE_JAVA.replace(r"\/", "/")   # RE2 spells the same classes


# --------------------------------------------------------------------------- tokens
@register("t1_approx_tokens", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS characters, {ov.tok_sql('text')} AS tokens FROM documents""")
def q_t1(spark, d):
    docs = tb.read_table(spark, d, "documents")
    return docs.select("doc_id", tx.utf16_len("text").alias("characters"), tx.approx_tokens("text").alias("tokens"))


@register("t3_request_tokens", ov.with_views("request_blocks") + f"""
SELECT session_id, request_id, CAST(sum({ov.tok_sql('text')}) AS BIGINT) AS tokens,
       CAST(count(*) AS BIGINT) AS blocks
FROM request_blocks GROUP BY session_id, request_id""")
def q_t3(spark, d):
    return tk.request_tokens(tb.request_blocks(spark, d))


EXACT_RE2 = tx.EXACT_MODEL_PATTERN.replace(r"\d", "[0-9]")


@register("t6_exact_for_model", ov.with_views("requests") + f""",
 models AS (SELECT DISTINCT model FROM requests UNION
            SELECT * FROM (VALUES ('claude-opus-4-8'), ('claude-sonnet-4-6'), ('claude-haiku-4-5'),
                                  ('gpt-4o'), ('gpt-4o-mini'), ('o3'), ('generic'),
                                  ('model_0'), ('model_1'), ('model_2')) v(model))
SELECT model, regexp_matches(model, '{EXACT_RE2}') AS exact FROM models""")
def q_t6(spark, d):
    models = tb.requests(spark, d).select("model").union(tb.prices(spark).select("model")).distinct()
    return models.select("model", tx.exact_for_model("model").alias("exact"))


@register("t7_token_report", ov.with_views("requests") + f""",
 texts AS (SELECT c.conv_id, c.turn, coalesce(c.text, '') AS text, r.model
           FROM conversations c LEFT JOIN requests r ON r.conv_id = c.conv_id AND r.turn = c.turn)
SELECT conv_id, turn, coalesce(model, 'generic') AS model, {ov.tok_sql('text')} AS tokens,
       CAST(length(text) AS BIGINT) AS characters,
       NOT regexp_matches(coalesce(model, 'generic'), '{EXACT_RE2}') AS approximate
FROM texts""")
def q_t7(spark, d):
    conv = tb.read_table(spark, d, "conversations")
    r = tb.requests(spark, d).select("conv_id", "turn", "model")
    texts = conv.join(r, ["conv_id", "turn"], "left").select("conv_id", "turn", "text", "model")
    return tk.token_report(texts)


@register("t8_chars_per_token", f"""
SELECT doc_id, CASE WHEN {ov.tok_sql('text')} > 0
                    THEN floor(length(text) / {ov.tok_sql('text')} * 100 + 0.5) / 100 END AS chars_per_token
FROM documents""")
def q_t8(spark, d):
    docs = tb.read_table(spark, d, "documents").select("doc_id", "text")
    rep = tk.token_report(docs, model_col=None)
    return tk.chars_per_token(rep).select("doc_id", "chars_per_token")


PRICES_SQL = ("prices AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', {usd})" for m, usd in tb.REFERENCE_PRICES + tb.FIXTURE_PRICES)
              + ") v(model, usd_per_mtok))")


@register("t9_input_cost", ov.with_views("request_blocks") + f""",
 {PRICES_SQL},
 rt AS (SELECT request_id, any_value(model) AS model, CAST(sum({ov.tok_sql('text')}) AS BIGINT) AS tokens
        FROM request_blocks GROUP BY request_id)
SELECT rt.request_id, rt.model, rt.tokens,
       rt.tokens / 1000000.0 * coalesce(p.usd_per_mtok, (SELECT usd_per_mtok FROM prices WHERE model='generic'))
         AS usd
FROM rt LEFT JOIN prices p ON p.model = rt.model""")
def q_t9(spark, d):
    blocks = tb.request_blocks(spark, d)
    return tk.input_cost(tk.request_tokens(blocks, keep=("model",)).select("request_id", "model", "tokens"), tb.prices(spark))


@register("t10_resend_cost", ov.with_views("request_blocks") + f""",
 per_text AS (SELECT session_id, text, count(*) AS times_sent, any_value({ov.tok_sql('text')}) AS tok
              FROM request_blocks GROUP BY session_id, text)
SELECT session_id, CAST(count(*) AS BIGINT) AS distinct_texts,
       CAST(sum(tok * times_sent) AS BIGINT) AS billed_tokens,
       CAST(sum(tok * (times_sent - 1)) AS BIGINT) AS resent_tokens
FROM per_text GROUP BY session_id""")
def q_t10(spark, d):
    return tk.resend_cost(tb.request_blocks(spark, d))


# --------------------------------------------------------------------------- single stages
def _final_blocks(red, extra=()) -> DataFrame:
    return red.blocks.select("request_id", "msg_idx", "block_idx", F.col("drop").alias("dropped"),
                             F.col("cache").alias("cache"), *extra)


@register("s1_cache_mark", ov.with_views("request_blocks") + """,
 sysmax AS (SELECT request_id AS sr, max((msg_idx, block_idx)) AS max_sys FROM request_blocks
            WHERE section='system' GROUP BY request_id)
SELECT request_id, msg_idx, block_idx, false AS dropped,
       coalesce(provider='anthropic' AND section='system' AND (msg_idx, block_idx) = max_sys, false) AS cache
FROM request_blocks LEFT JOIN sysmax ON sysmax.sr = request_blocks.request_id""")
def q_s1(spark, d):
    red = reduce_requests(tb.request_blocks(spark, d), Config(stages={"strip": False}))
    return _final_blocks(red)


@register("s3_drop_blank_blocks", pipeline_sql("line_blocks", 32, dedup=False) + """
SELECT request_id, msg_idx, block_idx, dropped, blank FROM fin""")
def q_s3(spark, d):
    red = reduce_requests(tb.line_blocks(spark, d), Config(stages={"cache": False}))
    b = red.blocks.withColumn("blank", tx.is_blank(F.col("text")))
    return b.select("request_id", "msg_idx", "block_idx", F.col("drop").alias("dropped"), "blank")


@register("s5_drop_repeats_in_system", pipeline_sql("system_blocks", 32, dedup=False) + """
SELECT request_id, session_id, model, tokens_before, tokens_after, saved, blocks_in, blocks_out, markers_added
FROM req""")
def q_s5(spark, d):
    red = reduce_requests(tb.system_blocks(spark, d), Config())
    return red.requests.select("request_id", "session_id", "model", "tokens_before", "tokens_after", "saved",
                               "blocks_in", "blocks_out", "markers_added")


# The cache marks the last system block; the marker is lost where strip drops that as a repeat or blank.
@register("s5_lost_cache_markers", pipeline_sql("system_blocks", 32, dedup=False) + """
SELECT request_id, CAST(CASE WHEN max_by(dropped, block_idx) THEN 1 ELSE 0 END AS BIGINT) AS markers_lost FROM fin GROUP BY request_id""")
def q_s5_markers(spark, d):
    return reduce_requests(tb.system_blocks(spark, d), Config()).requests.select("request_id", "markers_lost")


@register("s7_detect_path", ov.with_views("file_versions") + f""",
 texts AS (SELECT request_id AS id, 'file' AS src, text FROM file_versions
           UNION ALL SELECT doc_id, 'doc', text FROM documents)
SELECT id, src, nullif(regexp_extract(split_part(text, chr(10), 1), '{PATH_RE2}', 1), '') AS path FROM texts""")
def q_s7(spark, d):
    fv = tb.file_versions(spark, d).select(F.col("request_id").alias("id"), F.lit("file").alias("src"), "text")
    docs = tb.read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("src"), "text")
    return fv.unionByName(docs).select("id", "src", tx.detect_path("text").alias("path"))


PREV_SQL = ov.with_views("file_versions") + f""",
 q AS (SELECT *, nullif(regexp_extract(split_part(text, chr(10), 1), '{PATH_RE2}', 1), '') AS p
       FROM file_versions WHERE length(text) >= 200),
 lagged AS (SELECT session_id, request_id, p AS path, text,
                   lag(text) OVER (PARTITION BY session_id, p ORDER BY at_ms, request_id) AS prev,
                   lag(request_id) OVER (PARTITION BY session_id, p ORDER BY at_ms, request_id) AS prev_request_id
            FROM q WHERE p IS NOT NULL)"""


def _lagged(spark, d) -> DataFrame:
    fv = tb.file_versions(spark, d)
    q = fv.where(tx.utf16_len("text") >= tx.MIN_FILE_CHARS).withColumn("p", tx.detect_path("text")) \
          .where(F.col("p").isNotNull())
    w = Window.partitionBy("session_id", "p").orderBy("at_ms", "request_id")
    return q.select("session_id", "request_id", F.col("p").alias("path"), "text",
                    F.lag("text").over(w).alias("prev"), F.lag("request_id").over(w).alias("prev_request_id"))


@register("s8_previous_version", PREV_SQL + """
SELECT session_id, request_id, path, prev_request_id, prev IS NOT NULL AND prev <> text AS differs FROM lagged""")
def q_s8(spark, d):
    from slimwire.operators.stages import previous_versions
    files = tb.file_versions(spark, d)
    lg = previous_versions(files, files["text"]).where(F.col("_path").isNotNull()).withColumnRenamed("_prev", "prev")
    lg = lg.drop("path").withColumnRenamed("_path", "path").withColumnRenamed("_prev_request", "prev_request_id")
    return lg.select("session_id", "request_id", "path", "prev_request_id",
                     (F.col("prev").isNotNull() & (F.col("prev") != F.col("text"))).alias("differs"))


# Every request sends all versions of its file again: a version's sends meet the version that came before its first send.
@register("s8_distinct_versions", ov.with_views("file_versions") + f""",
 sends AS (SELECT n.session_id, n.request_id, n.at_ms, t.at_ms AS block_idx, t.text FROM file_versions n JOIN file_versions t ON t.session_id = n.session_id AND t.at_ms <= n.at_ms),
 p AS (SELECT *, nullif(regexp_extract(split_part(text, chr(10), 1), '{PATH_RE2}', 1), '') AS path FROM sends),
 q AS (SELECT * REPLACE (CASE WHEN length(text) >= 200 THEN path END AS path) FROM p),
 v AS (SELECT session_id, path, text, min((at_ms, request_id, block_idx)) AS sent FROM q WHERE path IS NOT NULL GROUP BY session_id, path, text),
 w AS (SELECT *, lag(text) OVER k AS prev, lag(sent[2]) OVER k AS prev_request_id FROM v WINDOW k AS (PARTITION BY session_id, path ORDER BY sent))
SELECT q.request_id, q.block_idx, md5(w.prev) AS prev_md5, CAST(w.prev_request_id AS BIGINT) AS prev_request_id
FROM q LEFT JOIN w ON w.session_id = q.session_id AND w.path = q.path AND w.text = q.text""")
def q_s8_distinct(spark, d):
    from slimwire.operators.stages import previous_distinct_versions
    sends = tb.resent_files(spark, d)
    found = previous_distinct_versions(sends, sends["text"])
    return found.select("request_id", "block_idx", F.md5("_prev").alias("prev_md5"), F.col("_prev_request").alias("prev_request_id"))


@register("s9_line_diff", PREV_SQL + """,
 arr AS (SELECT request_id, string_split(prev, chr(10)) AS a, string_split(text, chr(10)) AS b FROM lagged
         WHERE prev IS NOT NULL),
 m AS (SELECT request_id, a, b, len(a) AS na, len(b) AS nb, least(len(a), len(b)) AS mn FROM arr),
 p AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, mn + 1), lambda i: a[i] = b[i]), false), 0),
                          mn + 1) - 1 AS prefix FROM m),
 s AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, mn - prefix + 1),
                                                              lambda i: a[na - i + 1] = b[nb - i + 1]), false), 0),
                          mn - prefix + 1) - 1 AS suffix FROM p)
SELECT request_id, CAST(prefix AS BIGINT) AS prefix, CAST(suffix AS BIGINT) AS suffix,
       CAST(na - prefix - suffix AS BIGINT) AS removed, CAST(nb - prefix - suffix AS BIGINT) AS added FROM s""")
def q_s9(spark, d):
    lg = _lagged(spark, d).where(F.col("prev").isNotNull())
    c = F.col("counts")
    return df_.diff_counts(lg, "prev", "text").select("request_id", c["prefix"].alias("prefix"), c["suffix"].alias("suffix"),
                     c["removed"].alias("removed"), c["added"].alias("added"))


def _rng_sql(s: str, n: str) -> str:
    return f"concat(CAST(CASE WHEN {n} > 0 THEN {s} + 1 ELSE {s} END AS VARCHAR), ',', CAST({n} AS VARCHAR))"


S10_SQL = ov.with_views("file_revisions") + f""",
 q0 AS (SELECT *, nullif(regexp_extract(split_part(text, chr(10), 1), '{PATH_RE2}', 1), '') AS p
        FROM file_revisions),
 q AS (SELECT *, CASE WHEN length(text) >= 200 THEN p END AS path_q FROM q0),
 lg AS (SELECT *, CASE WHEN path_q IS NOT NULL THEN lag(text) OVER (
                     PARTITION BY session_id, path_q, CASE WHEN path_q IS NULL THEN request_id END
                     ORDER BY at_ms, request_id) END AS prev FROM q),
 c AS (SELECT *, prev IS NOT NULL AND prev <> text AS cand FROM lg),
 arr AS (SELECT *, string_split(regexp_replace(prev, '\n$', ''), chr(10)) AS a,
                string_split(regexp_replace(text, '\n$', ''), chr(10)) AS b FROM c WHERE cand),
 m AS (SELECT *, len(a) AS na, len(b) AS nb, least(len(a), len(b)) AS mn FROM arr),
 pp AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, mn + 1), lambda i: a[i] = b[i]), false), 0),
                           mn + 1) - 1 AS pre FROM m),
 ss AS (SELECT *, coalesce(nullif(list_position(list_transform(range(1, mn - pre + 1),
                                                lambda i: a[na - i + 1] = b[nb - i + 1]), false), 0),
                           mn - pre + 1) - 1 AS suf FROM pp),
 h AS (SELECT *, greatest(pre - 4, 0) AS st, na - suf AS a_end, nb - suf AS b_end,
              least(na - suf + 4, na) AS a_stop, least(nb - suf + 4, nb) AS b_stop FROM ss),
 d AS (SELECT request_id,
              regexp_replace(array_to_string(list_concat(
                 [concat('--- ', path_q, chr(9), 'previous'), concat('+++ ', path_q, chr(9), 'current'),
                  concat('@@ -', {_rng_sql('st', 'a_stop - st')}, ' +', {_rng_sql('st', 'b_stop - st')}, ' @@')],
                 list_transform(a[st + 1:pre], lambda x: concat(' ', x)),
                 list_transform(a[pre + 1:a_end], lambda x: concat('-', x)),
                 list_transform(b[pre + 1:b_end], lambda x: concat('+', x)),
                 list_transform(a[a_end + 1:a_stop], lambda x: concat(' ', x)),
                 CASE WHEN a_stop = na AND b_stop = nb AND NOT ends_with(prev, chr(10)) AND NOT ends_with(text, chr(10))
                      THEN ['\\ No newline at end of file'] ELSE [] END), chr(10)), '\\s+$', '') AS diff
       FROM h),
 r AS (SELECT c.request_id, c.text, c.prev, c.path_q, d.diff,
              coalesce(c.cand AND length(d.diff) < length(c.text), false) AS rw
       FROM c LEFT JOIN d USING (request_id)),
 t AS (SELECT request_id, {ov.tok_sql('text')} AS tok0,
              CASE WHEN rw THEN {ov.tok_sql("concat(path_q, ' — ', CAST(len(string_split(prev, chr(10))) AS VARCHAR), ' lines, sent as a diff vs. the previous version:', chr(10), chr(10), diff)")}
                   ELSE {ov.tok_sql('text')} END AS tok1, rw FROM r)
SELECT request_id, 'filediff' AS stage,
       CAST(CASE WHEN tok0 - tok1 < 32 THEN 0 ELSE tok0 - tok1 END AS BIGINT) AS saved,
       CAST(tok0 - tok1 AS BIGINT) AS measured, tok0 - tok1 < 32 AS reverted,
       CASE WHEN tok0 - tok1 < 32 THEN concat('reverted: saved ', CAST(tok0 - tok1 AS VARCHAR), ' < min 32')
            WHEN rw THEN 'diffed 1 file(s)' ELSE 'no re-sent files to diff' END AS notes
FROM t"""


FILEDIFF_ONLY = {"filediff": True, "cache": False, "strip": False}


@register("s10_filediff_rewrite", S10_SQL)
def q_s10(spark, d):
    # one changed line per re-send: the multi-hunk and single-hunk diffs coincide, so the
    # oracle (single hunk, rebuilt in SQL) checks the default (multi-hunk) stage
    red = reduce_requests(tb.file_revision_blocks(spark, d), Config(stages=FILEDIFF_ONLY))
    return red.ledger.select("request_id", "stage", "saved", "measured", "reverted", "notes")


# What is sent, put together again from the versions sent before, is what the client had; all changes of a growing file are the
# line of its revision, its last line where that gets a line end, and the new lines.
S10_GROWING_SQL = PREV_SQL + """,
 l AS (SELECT f.request_id, f.text, g.prev, g.prev IS NOT NULL AND g.prev <> f.text AS cand,
              string_split(regexp_replace(replace(g.prev, chr(10), concat('$', chr(10))), '\n$', ''), chr(10)) AS a,
              string_split(regexp_replace(replace(f.text, chr(10), concat('$', chr(10))), '\n$', ''), chr(10)) AS b
       FROM file_versions f LEFT JOIN lagged g USING (request_id)),
 p AS (SELECT *, len(a) - 2 AS na, len(b) - 2 AS nb, coalesce(list_position(list_transform(range(3, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false), 0) AS stop FROM l)
SELECT request_id, md5(text) AS restored_md5,
       CAST(CASE WHEN cand THEN 1 + na - CASE WHEN stop = 0 THEN least(na, nb) ELSE stop - 1 END ELSE 0 END AS BIGINT) AS removed,
       CAST(CASE WHEN cand THEN 1 + nb - CASE WHEN stop = 0 THEN least(na, nb) ELSE stop - 1 END ELSE 0 END AS BIGINT) AS added FROM p"""


@register("s10_filediff_growing_files", S10_GROWING_SQL)
def q_s10_growing(spark, d):
    # files that grow at the end while an early line changes: two hunks
    from slimwire.operators.stages import previous_versions, restored_text
    files = tb.file_blocks(spark, d)
    sent = reduce_requests(files, Config(stages=FILEDIFF_ONLY, min_savings=-(1 << 40))).blocks.select("request_id", F.col("text").alias("sent"))
    known = previous_versions(files, files["text"]).select("request_id", "_path", F.col("_prev").alias("previous"), "text")
    both = sent.join(known, "request_id")
    differs = F.col("previous") != F.col("text")
    script = df_.line_diff_udf(F.when(differs, F.col("_path")), F.when(differs, F.col("previous")), F.when(differs, F.col("text")))
    counted = both.withColumn("restored", restored_text(F.col("sent"), F.col("previous"))).withColumn("lines", F.slice(F.split(script, "\n", -1), 3, 1 << 30))
    count = lambda mark: F.coalesce(F.size(F.filter("lines", lambda x: x.startswith(mark))), F.lit(0)).cast("bigint")
    return counted.select("request_id", F.md5("restored").alias("restored_md5"), F.when(F.col("lines").isNull(), 0).otherwise(count("-")).cast("bigint").alias("removed"),
                          F.when(F.col("lines").isNull(), 0).otherwise(count("+")).cast("bigint").alias("added"))


@register("s11_s12_stub_stages", ov.with_views("requests") + """
SELECT request_id, 'slice' AS stage, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS saved, true AS reverted,
       'reverted: saved 0 < min 32' AS notes FROM requests
UNION ALL
SELECT request_id, 'intent', CAST(1 AS BIGINT), CAST(0 AS BIGINT), true, 'reverted: saved 0 < min 32' FROM requests""")
def q_s11(spark, d):
    red = reduce_requests(tb.request_blocks(spark, d),
                          Config(stages={"cache": False, "strip": False, "slice": True, "intent": True}))
    return red.ledger.select("request_id", "stage", F.col("ord").cast("bigint").alias("ord"), "saved",
                             "reverted", "notes")


@register("s13_fnv1a32", ov.with_views("context_puts") + """
SELECT DISTINCT content,
       lower(to_hex(list_reduce(list_transform(string_split(content, ''), lambda c: CAST(unicode(c) AS BIGINT)),
                                lambda acc, u: (xor(acc, u) * 16777619) % 4294967296, 2166136261::BIGINT)))
         AS fnv
FROM context_puts""")
def q_s13(spark, d):
    cp = tb.context_puts(spark, d).select("content").distinct()
    return cp.select("content", tx.fnv1a32("content").alias("fnv"))


@register("s14_block_key", ov.with_views("request_blocks") + """
SELECT request_id, msg_idx, block_idx, md5(concat('t:', text)) AS key_md5 FROM request_blocks""")
def q_s14(spark, d):
    b = tb.request_blocks(spark, d)
    key = tx.block_key("type", "text", "tool_id", "tool_name", "payload")
    return b.select("request_id", "msg_idx", "block_idx", F.md5(key).alias("key_md5"))


# --------------------------------------------------------------------------- pipeline
@register("p1_ordered_stages", """
SELECT stage, CAST(ord AS BIGINT) AS ord
FROM (VALUES ('cache', 0), ('dedup', 1), ('strip', 2), ('filediff', 3), ('slice', 4), ('intent', 5)) v(stage, ord)
WHERE (SELECT count(*) FROM conversations) > 0""")
def q_p1(spark, d):
    cfg = Config(stages={k: True for k in ("cache", "dedup", "strip", "filediff", "slice", "intent")})
    red = reduce_requests(tb.request_blocks(spark, d), cfg)
    return red.ledger.select("stage", F.col("ord").cast("bigint").alias("ord")).distinct()


@register("p2_stage_toggles", """
SELECT stage, CAST(ord AS BIGINT) AS ord FROM (VALUES ('dedup', 0), ('strip', 1)) v(stage, ord)
WHERE (SELECT count(*) FROM conversations) > 0""")
def q_p2(spark, d):
    # unknown key and a non-boolean value are ignored; strip keeps its default (on)
    cfg = Config(stages={"cache": False, "dedup": True, "strip": "yes", "bogus": True})
    red = reduce_requests(tb.request_blocks(spark, d), cfg)
    return red.ledger.select("stage", F.col("ord").cast("bigint").alias("ord")).distinct()


LEDGER_SQL = pipeline_sql("dup_blocks", 32) + """,
 led AS (
  SELECT request_id, 'cache' AS stage, 0 AS ord, 0 AS saved, 0 AS measured, false AS reverted,
         CASE WHEN provider <> 'anthropic' OR NOT coalesce(has_sys, false) THEN 'no cache breakpoint applied'
              ELSE 'cache_control on final system block' END AS notes FROM req
  UNION ALL
  SELECT request_id, 'dedup', 1, CASE WHEN saved_dedup < 32 THEN 0 ELSE saved_dedup END, saved_dedup,
         saved_dedup < 32,
         CASE WHEN saved_dedup < 32 THEN concat('reverted: saved ', CAST(saved_dedup AS VARCHAR), ' < min 32')
              WHEN hits > 0 THEN concat('collapsed ', CAST(hits AS VARCHAR), ' duplicate block(s)')
              ELSE 'no duplicates found' END FROM req
  UNION ALL
  SELECT request_id, 'strip', 2, tokens_dedup - tokens_after, tokens_dedup - tokens_after, false,
         'cleaned whitespace + removed duplicate text blocks' FROM req)"""


@register("p3_stage_ledger", LEDGER_SQL + """
SELECT request_id, stage, CAST(ord AS BIGINT) AS ord, CAST(saved AS BIGINT) AS saved,
       CAST(measured AS BIGINT) AS measured, reverted, notes FROM led""")
def q_p3(spark, d):
    red = reduce_requests(tb.dup_blocks(spark, d), Config(stages={"dedup": True}))
    return red.ledger.select("request_id", "stage", F.col("ord").cast("bigint").alias("ord"), "saved", "measured",
                             "reverted", "notes")


@register("p6_unchanged_passthrough", ov.with_views("request_blocks") + """
SELECT request_id, bool_or(provider = 'anthropic' AND section = 'system') AS changed
FROM request_blocks GROUP BY request_id""")
def q_p6(spark, d):
    red = reduce_requests(tb.request_blocks(spark, d), Config(stages={"strip": False}))
    return red.requests.select("request_id", "changed")


@register("p8_savings_by_stage", LEDGER_SQL + """
SELECT stage, CAST(ord AS BIGINT) AS ord, CAST(count(*) AS BIGINT) AS runs, CAST(sum(saved) AS BIGINT) AS saved,
       CAST(sum(measured) AS BIGINT) AS measured, CAST(sum(CASE WHEN reverted THEN 1 ELSE 0 END) AS BIGINT) AS reverted,
       floor(avg(CASE WHEN reverted THEN 1.0 ELSE 0.0 END) * 100 * 10 + 0.5) / 10 AS revert_pct
FROM led GROUP BY stage, ord""")
def q_p8(spark, d):
    red = reduce_requests(tb.dup_blocks(spark, d), Config(stages={"dedup": True}))
    return savings_by_stage(red).withColumn("ord", F.col("ord").cast("bigint"))


HEAD = 40


@register("u1_custom_stage", ov.with_views("request_blocks") + f""",
 m AS (SELECT request_id, CAST(sum({ov.tok_sql('text')}) - sum({ov.tok_sql(f'left(text, {HEAD})')}) AS BIGINT) AS measured,
              count(*) FILTER (WHERE length(text) > {HEAD}) AS cut FROM request_blocks GROUP BY request_id)
SELECT request_id, 'head' AS stage, CASE WHEN measured < 32 THEN CAST(0 AS BIGINT) ELSE measured END AS saved, measured < 32 AS reverted,
       CASE WHEN measured < 32 THEN concat('reverted: saved ', CAST(measured AS VARCHAR), ' < min 32') ELSE 'heads only' END AS notes FROM m""")
def q_u1(spark, d):
    # A user stage: keep the head of every text block; lossy, so the guardrail applies.
    head = custom_stage("head", lambda df: df.withColumn(
        "n_text", F.when(F.col("type") == "text", F.left("text", F.lit(HEAD))).otherwise(F.col("text"))),
        reversible=False, note="heads only")
    red = reduce_requests(tb.request_blocks(spark, d), Config(), stages=[head])
    return red.ledger.select("request_id", "stage", "saved", "reverted", "notes")


@register("u2_custom_tokenizer_words", ov.with_views("request_blocks") + f""",
 c AS (SELECT request_id, text, {ov.clean_sql('text')} AS clean FROM request_blocks),
 n AS (SELECT request_id, len(string_split(text, ' ')) AS before,
              CASE WHEN regexp_matches(clean, '{ov.RE_BLANK}') THEN 0 ELSE len(string_split(clean, ' ')) END AS after FROM c)
SELECT request_id, CAST(sum(before) AS BIGINT) AS tokens_before, CAST(sum(after) AS BIGINT) AS tokens_after FROM n GROUP BY request_id""")
def q_u2_words(spark, d):
    # A user tokenizer in column expressions: words between single spaces.
    words = lambda c: F.size(F.split(c, " ", -1)).cast("bigint")
    # anthropic system blocks repeat in no request here, so strip only cleans and drops blanks
    return reduce_requests(tb.request_blocks(spark, d), Config(), tokenizer=words).requests.select("request_id", "tokens_before", "tokens_after")


@register("m6_run_summary", pipeline_sql("request_blocks", 32) + """
SELECT request_id, tokens_before, tokens_after, saved,
       CASE WHEN tokens_before > 0 THEN floor(saved / tokens_before * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS saved_pct,
       concat('cache:0:true,dedup:', CAST(CASE WHEN saved_dedup < 32 THEN 0 ELSE saved_dedup END AS BIGINT), ':false,strip:',
              CAST(tokens_dedup - tokens_after AS BIGINT), ':true') AS stages FROM req""")
def q_m6_run(spark, d):
    from slimwire.operators.metrics import run_summary
    red = reduce_requests(tb.request_blocks(spark, d), Config(stages={"dedup": True}))
    text = F.array_join(F.transform("stages", lambda s: F.concat_ws(":", s["name"], s["saved"].cast("string"), s["reversible"].cast("string"))), ",")
    return run_summary(red.per_request).select("request_id", "tokens_before", "tokens_after", "saved", "saved_pct", text.alias("stages"))


@register("m3_metrics_of_run", pipeline_sql("request_blocks", 32) + """
SELECT CAST(count(*) AS BIGINT) AS requests, CAST(sum(tokens_before) AS BIGINT) AS tokens_before, CAST(sum(tokens_after) AS BIGINT) AS tokens_after,
       CAST(sum(saved) AS BIGINT) AS saved, CASE WHEN sum(tokens_before) > 0 THEN floor(sum(saved) / sum(tokens_before) * 100 * 10 + 0.5) / 10 ELSE 0.0 END AS saved_pct,
       0.0 AS avg_duration_ms FROM req""")
def q_m3_run(spark, d):
    from slimwire.operators.metrics import metrics_of_run, metrics_total
    red = reduce_requests(tb.request_blocks(spark, d), Config(stages={"dedup": True}))
    return metrics_total(metrics_of_run(red.per_request))


# --------------------------------------------------------------------------- P7, H8
def _cfg_values_sql() -> str:
    rows = []
    for r in tb.CONFIG_LOG:
        vals = [str(r[0]), str(r[1])] + [("true" if x else "false") for x in r[2:8]] + [str(r[8]),
                                                                                          "true" if r[9] else "false"]
        rows.append("(" + ", ".join(vals) + ")")
    return ("cfglog AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(valid_from_ms, valid_to_ms, cache, dedup, "
            "strip, filediff, slice, intent, min_savings, store))")


P7_SQL = ov.with_views("request_blocks") + f""",
 {_cfg_values_sql()},
 rc AS (SELECT r.request_id, c.* EXCLUDE (valid_from_ms, valid_to_ms) FROM requests r
        LEFT JOIN cfglog c ON r.at_ms >= c.valid_from_ms AND r.at_ms < c.valid_to_ms)"""


@register("p7_config_as_of", P7_SQL + """
SELECT request_id, cache, dedup, strip, filediff, slice, intent, CAST(min_savings AS BIGINT) AS min_savings, store
FROM rc""")
def q_p7(spark, d):
    from slimwire.plans.config_asof import config_as_of
    r = tb.requests(spark, d).select("request_id", "at_ms")
    return config_as_of(r, tb.config_log(spark)).select(
        "request_id", "cache", "dedup", "strip", "filediff", "slice", "intent",
        F.col("min_savings").cast("bigint").alias("min_savings"), "store")


@register("p7_reduce_with_config_log", P7_SQL + f""",
 b0 AS (SELECT b.*, rc.cache AS c_cache, rc.dedup AS c_dedup, rc.strip AS c_strip, rc.filediff AS c_fd,
               rc.slice AS c_slice, rc.intent AS c_intent, rc.min_savings AS c_min, {ov.tok_sql('text')} AS tok0
        FROM request_blocks b JOIN rc USING (request_id)),
 d0 AS (SELECT *, c_dedup AND section = 'message' AND length(text) >= {tx.MIN_DUP_CHARS} AS elig FROM b0),
 d1 AS (SELECT *, elig AND row_number() OVER (PARTITION BY request_id, elig, text
                                              ORDER BY msg_idx, block_idx) > 1 AS dup FROM d0),
 d2 AS (SELECT *, CASE WHEN dup THEN '{tx.OMIT_MARKER}' ELSE text END AS text_d FROM d1),
 d3 AS (SELECT *, sum(tok0) OVER (PARTITION BY request_id)
                  - sum({ov.tok_sql('text_d')}) OVER (PARTITION BY request_id) AS saved_dedup FROM d2),
 b1 AS (SELECT * REPLACE (CASE WHEN c_dedup AND saved_dedup >= c_min THEN text_d ELSE text END AS text) FROM d3),
 s0 AS (SELECT *, CASE WHEN c_strip THEN {ov.clean_sql('text')} ELSE text END AS clean FROM b1),
 s1 AS (SELECT *, c_strip AND regexp_matches(clean, '{ov.RE_BLANK}') AS blank FROM s0),
 s2 AS (SELECT *, c_strip AND NOT blank AND row_number() OVER (
           PARTITION BY request_id, section, CASE WHEN section = 'system' THEN -1 ELSE msg_idx END, blank, clean
           ORDER BY msg_idx, block_idx) > 1 AS rep FROM s1),
 fin AS (SELECT *, CASE WHEN blank OR rep THEN 0 ELSE {ov.tok_sql('clean')} END AS tok_final FROM s2),
 req AS (SELECT request_id, CAST(sum(tok0) AS BIGINT) AS tokens_before, CAST(sum(tok_final) AS BIGINT) AS tokens_after,
                any_value(c_cache) AS c_cache, any_value(c_dedup) AS c_dedup, any_value(c_strip) AS c_strip,
                any_value(c_fd) AS c_fd, any_value(c_slice) AS c_slice, any_value(c_intent) AS c_intent,
                any_value(c_min) AS c_min, any_value(saved_dedup) AS saved_dedup,
                bool_or(provider = 'anthropic' AND section = 'system') AS cache_hit
         FROM fin GROUP BY request_id)
SELECT request_id, tokens_before, tokens_after,
       CAST(CAST(c_cache AS INT) + CAST(c_dedup AS INT) + CAST(c_strip AS INT) + CAST(c_fd AS INT)
            + CAST(c_slice AS INT) + CAST(c_intent AS INT) AS BIGINT) AS n_stages,
       CAST(CAST(c_dedup AND saved_dedup < c_min AS INT) + CAST(c_fd AND 0 < c_min AS INT)
            + CAST(c_slice AND 0 < c_min AS INT) + CAST(c_intent AND 0 < c_min AS INT) AS BIGINT) AS n_reverted,
       (c_cache AND cache_hit) OR (c_dedup AND saved_dedup >= c_min) OR c_strip AS changed
FROM req""")
def q_p7_reduce(spark, d):
    red = reduce_requests(tb.request_blocks(spark, d), Config(), config_log=tb.config_log(spark))
    return red.per_request.select(
        "request_id", "tokens_before", "tokens_after", F.size("stages").cast("bigint").alias("n_stages"),
        F.size(F.filter("stages", lambda s: s["reverted"])).cast("bigint").alias("n_reverted"), "changed")


@register("h8_store_gate", P7_SQL + f""",
 turns AS (SELECT b.session_id, b.request_id, any_value(b.at_ms) AS at_ms,
                  CAST(sum({ov.tok_sql('b.text')}) AS BIGINT) AS tokens
           FROM request_blocks b JOIN rc USING (request_id) WHERE rc.store GROUP BY b.session_id, b.request_id)
SELECT session_id, CAST(count(*) AS BIGINT) AS turns, CAST(sum(tokens) AS BIGINT) AS total_tokens,
       max(at_ms) AS last_active FROM turns GROUP BY session_id""")
def q_h8(spark, d):
    from slimwire.operators import sessions as hs
    from slimwire.plans.config_asof import config_as_of
    # every block has its request's time, so the log is met where the blocks are
    blocks = config_as_of(tb.request_blocks(spark, d), tb.config_log(spark))
    st = hs.session_state(hs.build_turns(blocks, store=F.coalesce(F.col("store"), F.lit(True))))
    return st.select("session_id", "turns", "total_tokens", "last_active")


# --------------------------------------------------------------------------- T4, T5, U2
BPE_MERGES = 100
_learned: dict[tuple[str, str], list] = {}   # by application and folder: T4 and U2 count with the table that T5 learns


def _ranks(spark, d):
    from slimwire.operators import bpe
    key = (spark.sparkContext.applicationId, d)
    if key not in _learned:
        ranks = bpe.learn_bpe_ranks(tb.read_table(spark, d, "documents").select("text"), BPE_MERGES)
        _learned[key] = [tuple(r) for r in ranks.collect()]   # BPE_MERGES rows
    return spark.createDataFrame(_learned[key], "rank long, left string, right string, token string, pair_count long")


CUT = "chr(983040)"   # a private character that no text has


def _pretokens_sql(text: str) -> str:
    """Pre-tokens without a look ahead: the last blank of a run before something else goes with that, so the run is cut before it."""
    from slimwire.operators.bpe import PRETOKEN_PATTERN, SPACE
    plain = PRETOKEN_PATTERN.replace(f"[{SPACE}]+(?![^{SPACE}])|", "").replace("'", "''")
    cut = rf"regexp_replace(coalesce({text}, ''), '([{SPACE}])([{SPACE}][^{SPACE}])', concat('\1', {CUT}, '\2'), 'g')"
    return f"flatten(list_transform(string_split({cut}, {CUT}), lambda p: regexp_extract_all(p, '{plain}')))"


def _bpe_sql(texts: str) -> str:
    """Merging one by one: ``r`` has the words of ``documents`` and of the query's own ``texts``, which don't count, after each merge."""
    return f"""
 bw AS (SELECT unnest({_pretokens_sql('text')}) AS word, 1 AS n FROM documents UNION ALL SELECT unnest({_pretokens_sql('text')}), 0 FROM (SELECT DISTINCT text FROM {texts})),
 w0 AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, regexp_extract_all(lower(hex(encode(word))), '..') AS syms FROM bw GROUP BY word),
 r(step, word, n, syms, a, b, cnt) AS (
  SELECT 0, word, n, syms, '', '', CAST(0 AS BIGINT) FROM w0
  UNION ALL
  SELECT step + 1, word, n, CASE WHEN contains(concat(' ', array_to_string(syms, ' '), ' '), concat(' ', p.a, ' ', p.b, ' ')) THEN
     list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(syms, lambda x: [x])),
                 lambda s, x: CASE WHEN len(s) > 0 AND s[-1] = p.a AND x[1] = p.b THEN list_append(s[:-2], concat(p.a, p.b)) ELSE list_concat(s, x) END) ELSE syms END,
     p.a, p.b, p.cnt
  FROM r, (SELECT a, b, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT n, unnest(syms[:-2]) AS a, unnest(syms[2:]) AS b FROM r WHERE len(syms) > 1 AND n > 0)
           GROUP BY a, b ORDER BY cnt DESC, a, b LIMIT 1) p
  WHERE step < {BPE_MERGES}),
 last_step AS (SELECT max(step) AS step FROM r),
 tokens AS (SELECT word, len(syms) AS tokens FROM r JOIN last_step USING (step)),
 text_words AS (SELECT text, unnest({_pretokens_sql('text')}) AS word FROM (SELECT DISTINCT text FROM {texts})),
 text_tokens AS (SELECT text, CAST(sum(tokens) AS BIGINT) AS tokens FROM text_words JOIN tokens USING (word) GROUP BY text)"""


@register("t5_learn_bpe_ranks", "WITH RECURSIVE one AS (SELECT '' AS text)," + _bpe_sql("one") + """
SELECT DISTINCT CAST(step - 1 AS BIGINT) AS rank, a AS left, b AS right, concat(a, b) AS token, cnt AS pair_count FROM r WHERE step > 0""")
def q_t5(spark, d):
    from slimwire.operators import bpe
    return bpe.learn_bpe_ranks(tb.read_table(spark, d, "documents").select("text"), BPE_MERGES)


@register("t4_bpe_tokens", "WITH RECURSIVE" + _bpe_sql("conversations") + f"""
SELECT conv_id * {tb.TURNS} + turn AS id, coalesce(tokens, 0) AS tokens FROM conversations c LEFT JOIN text_tokens t ON t.text = c.text""")
def q_t4(spark, d):
    from slimwire.operators import bpe
    conv = tb.read_table(spark, d, "conversations").select(
        (F.col("conv_id") * tb.TURNS + F.col("turn")).alias("id"), "text")
    return bpe.bpe_token_counts(conv, _ranks(spark, d), "id")


@register("u2_custom_tokenizer", ov.with_views("request_blocks").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
 c AS (SELECT request_id, text, {ov.clean_sql('text')} AS clean FROM request_blocks),
 both_texts AS (SELECT text FROM c UNION SELECT clean FROM c),""" + _bpe_sql("both_texts") + f""",
 q AS (SELECT request_id, coalesce(t.tokens, 0) AS before, CASE WHEN regexp_matches(clean, '{ov.RE_BLANK}') THEN 0 ELSE coalesce(u.tokens, 0) END AS after
       FROM c LEFT JOIN text_tokens t ON t.text = c.text LEFT JOIN text_tokens u ON u.text = clean),
 z AS (SELECT request_id, CAST(sum(before) AS BIGINT) AS tokens_before, CAST(sum(after) AS BIGINT) AS tokens_after FROM q GROUP BY request_id)
SELECT *, tokens_before - tokens_after AS saved FROM z""")
def q_u2(spark, d):
    from slimwire.operators import bpe
    ranks = bpe.ranks_from_table(_ranks(spark, d))
    red = reduce_requests(tb.request_blocks(spark, d), Config(), tokenizer=bpe.bpe_tokenizer_udf(ranks))
    return red.requests.select("request_id", "tokens_before", "tokens_after", "saved")
