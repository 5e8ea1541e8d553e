"""Registered queries for file versions (F*), the registry (R*) and the context store (C*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.functions import text as tx
from slimwire.operators import context as cx
from slimwire.plans import oracle_views as ov
from slimwire.plans.queries_state import _scratch, _toxic_sessions
from slimwire.registry import register
from slimwire.session import stored
from slimwire.sources import snapshot as snap
from slimwire.sources import tables as tb

DIGITS = "'0123456789abcdefghijklmnopqrstuvwxyz'"


def _d(x: str) -> str:
    return f"substr({DIGITS}, CAST({x} AS BIGINT) + 1, 1)"


def b36_sql(n: str) -> str:
    """Base-36 text of a non-negative integer below 36^4 (DuckDB has no radix conversion)."""
    return (f"CASE WHEN {n} < 36 THEN {_d(n)} "
            f"WHEN {n} < 1296 THEN concat({_d(f'{n} // 36')}, {_d(f'{n} % 36')}) "
            f"WHEN {n} < 46656 THEN concat({_d(f'{n} // 1296')}, {_d(f'({n} // 36) % 36')}, {_d(f'{n} % 36')}) "
            f"ELSE concat({_d(f'{n} // 46656')}, {_d(f'({n} // 1296) % 36')}, {_d(f'({n} // 36) % 36')}, "
            f"{_d(f'{n} % 36')}) END")


def fnv_sql(expr: str) -> str:
    return (f"lower(to_hex(list_reduce(list_transform(string_split({expr}, ''), lambda c: CAST(unicode(c) AS BIGINT)), "
            f"lambda acc, u: (xor(acc, u) * 16777619) % 4294967296, 2166136261::BIGINT)))")


# --------------------------------------------------------------------------- F1, F2
F_SQL = ov.with_views("file_versions") + """,
 fl AS (SELECT session_id, path, request_id, md5(text) AS text_md5,
               row_number() OVER (PARTITION BY session_id, path ORDER BY at_ms DESC, request_id DESC) AS rn,
               count(*) OVER (PARTITION BY session_id, path) AS puts
        FROM file_versions)"""


def _latest_files(spark: SparkSession, d: str) -> DataFrame:
    return cx.latest_file_version(tb.file_versions(spark, d))


@register("f1_latest_file_version", F_SQL + """
SELECT session_id, path, request_id, text_md5, CAST(puts AS BIGINT) AS puts FROM fl WHERE rn = 1""")
def q_f1(spark, d):
    lf = _latest_files(spark, d)
    return lf.select("session_id", "path", "request_id", F.md5("text").alias("text_md5"), "puts")


@register("f2_clear_file_versions", F_SQL + """
SELECT session_id, path, request_id FROM fl WHERE rn = 1
  AND session_id NOT IN (SELECT concat('s', CAST(doc_id AS VARCHAR)) FROM labels WHERE toxic = 1)""")
def q_f2(spark, d):
    kept = cx.clear_file_versions(_latest_files(spark, d), _toxic_sessions(spark, d))
    return kept.select("session_id", "path", "request_id")


# --------------------------------------------------------------------------- R1, R2
R_SQL = ov.with_views("request_blocks") + f""",
 seen AS (SELECT session_id, md5(text) AS hash, at_ms, request_id, msg_idx, block_idx,
                 row_number() OVER (PARTITION BY session_id, md5(text)
                                    ORDER BY at_ms, request_id, msg_idx, block_idx) AS rn
          FROM request_blocks),
 reg AS (SELECT session_id, hash,
                CAST(row_number() OVER (ORDER BY at_ms, request_id, msg_idx, block_idx, session_id, hash) - 1
                     AS BIGINT) AS seq
         FROM seen WHERE rn = 1),
 reg_id AS (SELECT session_id, hash, seq, concat('ctx_', {b36_sql('seq')}) AS ctx_id FROM reg)"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    rb = tb.request_blocks(spark, d).withColumn("hash", F.md5("text"))
    return cx.registry_register(rb, ["at_ms", "request_id", "msg_idx", "block_idx"])


@register("r1_registry_register", R_SQL + "\nSELECT session_id, hash, seq, ctx_id FROM reg_id")
def q_r1(spark, d):
    return _registry(spark, d)


@register("r2_registry_lookup", R_SQL + """,
 lk AS (SELECT concat('s', CAST(conv_id AS VARCHAR)) AS session_id, conv_id, turn, md5(text) AS hash
        FROM conversations
        UNION ALL
        SELECT 'default', conv_id, turn, md5(text) FROM conversations)
SELECT lk.session_id, lk.conv_id, lk.turn, r.ctx_id FROM lk LEFT JOIN reg_id r USING (session_id, hash)""")
def q_r2(spark, d):
    conv = tb.read_table(spark, d, "conversations")
    own = conv.select(F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
                      "conv_id", "turn", F.md5("text").alias("hash"))
    other = conv.select(F.lit("default").alias("session_id"), "conv_id", "turn", F.md5("text").alias("hash"))
    res = cx.registry_lookup(own.unionByName(other), _registry(spark, d))
    return res.select("session_id", "conv_id", "turn", "ctx_id")


# --------------------------------------------------------------------------- C1-C6
C_SQL = ov.with_views("context_puts") + f""",
 store AS (SELECT concat('ctx_', {fnv_sql('content')}) AS id, sha256(content) AS sha, content,
                  CAST(length(content) AS BIGINT) AS bytes,
                  arg_max(label, at_ms) FILTER (WHERE label <> '') AS label,
                  max(at_ms) AS last_put_ms, CAST(count(*) AS BIGINT) AS puts
           FROM context_puts WHERE content <> '' GROUP BY content),
 by_id AS (SELECT id, arg_max(content, last_put_ms) AS content, arg_max(bytes, last_put_ms) AS bytes,
                  arg_max(label, last_put_ms) AS label, count(DISTINCT sha) > 1 AS collision
           FROM store GROUP BY id)"""


def _store(spark: SparkSession, d: str) -> DataFrame:
    store, _ = cx.context_put(tb.context_puts(spark, d))
    return store


@register("c1_context_put", C_SQL + "\nSELECT id, sha, bytes, label, puts FROM store")
def q_c1(spark, d):
    return _store(spark, d).select("id", "sha", "bytes", "label", "puts")


@register("c2_context_get", C_SQL + f""",
 ids AS (SELECT id FROM store UNION SELECT concat('ctx_', {fnv_sql('text')}) FROM benchmark)
SELECT ids.id, CASE WHEN b.content IS NULL THEN 'not_found' ELSE 'ok' END AS status,
       CAST(length(b.content) AS BIGINT) AS content_len
FROM ids LEFT JOIN by_id b USING (id)""")
def q_c2(spark, d):
    store = stored(_store(spark, d), "contexts")   # read for its ids and for its contents
    bench = tb.read_table(spark, d, "benchmark").select(
        F.concat(F.lit(cx.CTX_PREFIX), tx.fnv1a32("text")).alias("id"))
    ids = store.select("id").union(bench).distinct()
    got = cx.context_get(ids, store)
    return got.select("id", "status", tx.utf16_len("content").alias("content_len"))


@register("c3_context_list", C_SQL + "\nSELECT id, bytes, label FROM by_id")
def q_c3(spark, d):
    return cx.context_list(_store(spark, d))


@register("c4_context_clear", C_SQL + "\nSELECT id, sha, content, bytes, label, last_put_ms, puts FROM store WHERE false")
def q_c4(spark, d):
    store = _store(spark, d)
    path = _scratch(spark, "context")
    snap.write_snapshot(store, path)
    snap.write_snapshot(store.limit(0), path)
    return snap.read_snapshot(spark, path, store.schema)


@register("c5_hash_collisions", C_SQL + """
SELECT id, CAST(count(DISTINCT sha) AS BIGINT) AS contents FROM store GROUP BY id HAVING count(DISTINCT sha) > 1""")
def q_c5(spark, d):
    return cx.hash_collisions(_store(spark, d))


@register("c6_reference_encode_expand", ov.with_views("request_blocks") + """
SELECT request_id, msg_idx, block_idx, text FROM request_blocks""")
def q_c6(spark, d):
    blocks = tb.request_blocks(spark, d)
    puts = blocks.select(F.col("text").alias("content"), F.lit("").alias("label"), F.col("at_ms"))
    store, _ = cx.context_put(puts)
    enc = cx.reference_encode(blocks, store)
    return cx.reference_expand(enc, store).select("request_id", "msg_idx", "block_idx", "text")


@register("c6_encoded_share", ov.with_views("request_blocks") + """
SELECT request_id, CAST(count(*) AS BIGINT) AS blocks, CAST(sum(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS BIGINT)
       AS referenced FROM request_blocks GROUP BY request_id""")
def q_c6_share(spark, d):
    blocks = tb.request_blocks(spark, d)
    puts = blocks.select(F.col("text").alias("content"), F.lit("").alias("label"), F.col("at_ms"))
    store, _ = cx.context_put(puts)
    enc = cx.reference_encode(blocks, store)
    return enc.groupBy("request_id").agg(F.count(F.lit(1)).alias("blocks"),
                                         F.count("ref").alias("referenced"))
