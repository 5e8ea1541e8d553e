"""F1-F2 file versions, R1-R2 context registry, C1-C6 content-addressed context store.

Identity at scale is SHA-256 of the content (``content_key``); the reference's
32-bit FNV id is exposed as a column and its collisions are reported (C5), never
silently merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.functions import text as tx

CTX_PREFIX = "ctx_"   # fixed value: id prefix of registry and store entries


# --------------------------------------------------------------------------- F1, F2
def latest_file_version(versions: DataFrame) -> DataFrame:
    """last text per (session, path) in arrival order (at_ms, request_id, msg_idx, block_idx)."""
    order = [c for c in ("at_ms", "request_id", "msg_idx", "block_idx") if c in versions.columns]
    key = F.struct(*[F.col(c) for c in order])
    return (versions.groupBy("session_id", "path")
                    .agg(F.max_by("text", key).alias("text"), F.max_by("request_id", key).alias("request_id"),
                         F.count(F.lit(1)).alias("puts")))


def clear_file_versions(latest: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """forget the listed sessions' files (None: all)."""
    if sessions is None:
        return latest.limit(0)
    return latest.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


# --------------------------------------------------------------------------- R1, R2
def registry_register(seen: DataFrame, order: list[str]) -> DataFrame:
    """A stable id per (session, hash), numbered process-wide in first-seen order.

    ``seen`` has session_id, hash and the ``order`` columns. The first sight of each
    pair is a grouped min (partial aggregation absorbs hot pairs); the dense
    numbering is :func:`slimwire.plans.sequence.sequence` (no single-partition window).
    """
    from slimwire.plans.sequence import sequence
    first = (seen.groupBy("session_id", "hash")
                 .agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first")))
    first = first.select("session_id", "hash", *[F.col("_first")[c].alias(c) for c in order])
    numbered = sequence(first, order + ["session_id", "hash"], "seq")
    return numbered.select("session_id", "hash", "seq",
                           F.concat(F.lit(CTX_PREFIX), F.lower(F.conv(F.col("seq").cast("string"), 10, 36)))
                           .alias("ctx_id"))


def registry_lookup(lookups: DataFrame, registry: DataFrame) -> DataFrame:
    """R2: the id of (session, hash) or NULL; sessions never see each other's ids."""
    return lookups.join(registry.select("session_id", "hash", "ctx_id"), ["session_id", "hash"], "left")


# --------------------------------------------------------------------------- C1-C6
def context_put(puts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(store, rejected). Store: one row per distinct content.

    ``puts`` has content, label, at_ms. Id = ``ctx_`` + FNV-1a(content); bytes =
    UTF-16 length; the latest non-empty label wins; repeated puts are idempotent.
    Empty content is rejected (the reference raises an error for it).
    """
    ok = puts.where(F.coalesce(F.length("content"), F.lit(0)) > 0)
    rejected = puts.where(F.coalesce(F.length("content"), F.lit(0)) == 0)
    keyed = ok.withColumn("sha", tx.content_key("content"))
    store = (keyed.groupBy("sha")
                  .agg(F.first("content").alias("content"),
                       F.max(F.when(F.col("label") != "", F.struct("at_ms", "label"))).alias("_lab"),
                       F.max("at_ms").alias("last_put_ms"), F.count(F.lit(1)).alias("puts")))
    store = store.select(F.concat(F.lit(CTX_PREFIX), tx.fnv1a32("content")).alias("id"), "sha", "content",
                         tx.utf16_len("content").alias("bytes"), F.col("_lab")["label"].alias("label"),
                         "last_put_ms", "puts")
    return store, rejected


def context_by_id(store: DataFrame) -> DataFrame:
    """The id-addressed view of the store: on an id collision the latest put wins (as
    in the reference); ``collision`` flags it."""
    return (store.groupBy("id")
                 .agg(F.max_by("content", "last_put_ms").alias("content"),
                      F.max_by("bytes", "last_put_ms").alias("bytes"),
                      F.max_by("label", "last_put_ms").alias("label"),
                      (F.count_distinct("sha") > 1).alias("collision")))


def context_get(ids: DataFrame, store: DataFrame) -> DataFrame:
    """Expand ids; unknown ids get status ``not_found`` and no content."""
    by_id = context_by_id(store)
    j = ids.join(by_id.select("id", "content"), "id", "left")
    return j.withColumn("status", F.when(F.col("content").isNull(), F.lit("not_found")).otherwise(F.lit("ok")))


def context_list(store: DataFrame) -> DataFrame:
    """Id, bytes, label."""
    return context_by_id(store).select("id", "bytes", "label")


def hash_collisions(store: DataFrame) -> DataFrame:
    """32-bit ids shared by different contents."""
    return (store.groupBy("id").agg(F.count_distinct("sha").alias("contents"))
                 .where(F.col("contents") > 1))


def reference_encode(blocks: DataFrame, store: DataFrame) -> DataFrame:
    """Replace block texts found in the store by their content key (shuffle join on sha)."""
    keyed = blocks.withColumn("sha", tx.content_key("text"))
    j = keyed.join(store.select("sha", F.col("id").alias("ref_id")), "sha", "left")
    return (j.withColumn("ref", F.when(F.col("ref_id").isNotNull(), F.col("sha")))
             .withColumn("text", F.when(F.col("ref").isNotNull(), F.lit(None).cast("string")).otherwise(F.col("text")))
             .drop("sha"))


def reference_expand(encoded: DataFrame, store: DataFrame) -> DataFrame:
    """Inverse of :func:`reference_encode`; reproduces the blocks exactly."""
    j = encoded.join(store.select(F.col("sha").alias("ref"), F.col("content").alias("_content")), "ref", "left")
    return j.withColumn("text", F.coalesce(F.col("text"), F.col("_content"))).drop("_content", "ref", "ref_id")
