"""Registered queries for kept-up stores: a log put in two halves, in turn, gives what the whole log gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.plans.queries_context import C_SQL, F_SQL, R_SQL
from slimwire.plans.queries_state import TURNS, _scratch, _turns
from slimwire.registry import register
from slimwire.sources import tables as tb
from slimwire.sources import upkeep as up


def _in_halves(log: DataFrame, put: Callable[[DataFrame], object]) -> None:
    """Put the older half of the log's time, then the rest, which is merged into what is stored."""
    span = log.agg(F.min("at_ms").alias("lo"), F.max("at_ms").alias("hi")).first()
    mid = ((span["lo"] or 0) + (span["hi"] or 0)) // 2
    put(log.where(F.col("at_ms") <= mid))
    put(log.where(F.col("at_ms") > mid))


@register("c1_context_upkeep", C_SQL + "\nSELECT id, sha, bytes, label, last_put_ms, puts FROM store")
def q_c1_upkeep(spark, d):
    store = up.context_store(spark, _scratch(spark, "context-store"))
    _in_halves(tb.context_puts(spark, d), lambda part: up.put_contexts(store, part))
    return store.read().select("id", "sha", "bytes", "label", "last_put_ms", "puts")


@register("f1_file_upkeep", F_SQL + "\nSELECT session_id, path, request_id, text_md5, CAST(puts AS BIGINT) AS puts FROM fl WHERE rn = 1")
def q_f1_upkeep(spark, d):
    store = up.file_store(spark, _scratch(spark, "file-store"))
    _in_halves(tb.file_versions(spark, d), lambda part: up.put_files(store, part))
    return store.read().select("session_id", "path", "request_id", F.md5("text").alias("text_md5"), "puts")


@register("h1_session_upkeep", TURNS + "\nSELECT session_id, model, turns, first_seen, last_active, total_tokens, n_blocks FROM state")
def q_h1_upkeep(spark, d):
    turns = _turns(spark, d)
    store = up.session_store(spark, _scratch(spark, "session-store"), turns)
    _in_halves(turns, lambda part: up.put_turns(store, part))
    return store.read().select("session_id", "model", "turns", "first_seen", "last_active", "total_tokens", F.size("messages").cast("bigint").alias("n_blocks"))


@register("r1_registry_upkeep", R_SQL + "\nSELECT session_id, hash, seq, ctx_id FROM reg_id")
def q_r1_upkeep(spark, d):
    store = up.registry_store(spark, _scratch(spark, "registry"))
    seen = tb.request_blocks(spark, d).withColumn("hash", F.md5("text"))
    _in_halves(seen, lambda part: up.register_hashes(store, part, ["at_ms", "request_id", "msg_idx", "block_idx"]))
    return up.registry_ids(store).select("session_id", "hash", "seq", "ctx_id")
