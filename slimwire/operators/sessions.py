"""Session history as keyed aggregates and windows over a ``turns`` table.

``turns(session_id, at_ms, request_id, model, tokens, messages)`` holds one row per
stored request: the conversation as the user sent it (before reduction, H11) and
its token count before reduction. Arrival order is ``(at_ms, request_id)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimwire.functions import text as tx

ORDER = ["at_ms", "request_id"]
EMPTY_PREVIEW = "—"   # fixed value: preview of a message without content


def build_turns(blocks: DataFrame, tokenizer: Callable[[Column], Column] = tx.approx_tokens,
                store: Column | None = None) -> DataFrame:
    """One turn per request from the *pre-reduction* blocks.

    ``tokens`` sums per-block counts over system, message and tool blocks (T3);
    ``messages`` keeps the message blocks in (msg_idx, block_idx) order. ``store``
    (a boolean column of the blocks, H8) drops requests that were sent with store off.
    Rows of type ``none`` (``normalize(..., keep_empty=True)``) give requests without blocks
    their turn, and stand in ``messages`` for messages without blocks.
    """
    b = blocks if store is None else blocks.where(store)
    rendered = tx.render_block("type", "text", "tool_name", "payload", "rendered")
    b = b.withColumn("_tok", tokenizer(rendered))
    msg = F.when(F.col("section") == "message",
                 F.struct(F.col("msg_idx").cast("bigint").alias("msg_idx"),
                          F.col("block_idx").cast("bigint").alias("block_idx"),
                          F.col("role"), F.col("type"), F.col("text")))
    return (b.groupBy("session_id", "request_id")
             .agg(F.first("at_ms").alias("at_ms"), F.first("model").alias("model"),
                  F.sum("_tok").cast("bigint").alias("tokens"),
                  F.array_sort(F.collect_list(msg)).alias("messages")))


def turn_index(turns: DataFrame) -> DataFrame:
    """H2: 0-based position of each turn in its session.

    Numbered with :func:`slimwire.plans.sequence.sequence` (range partitions), so a
    hot session is split across tasks instead of sorted in one window partition."""
    from slimwire.plans.sequence import sequence
    return sequence(turns, ORDER, "turn_index", group="session_id")


def timeline(turns: DataFrame, cap: int = 0) -> DataFrame:
    """H3: timeline rows (true index, A8 fixed), keeping the newest ``cap`` per session (0 = all).

    The cap compares the index with the session's turn count (its highest index, from the
    same numbered table, joined back), not a per-session window."""
    t = turn_index(turns)
    if cap > 0:
        counts = t.groupBy("session_id").agg((F.max("turn_index") + 1).alias("_n"))
        t = t.join(counts, "session_id").where(F.col("turn_index") >= F.col("_n") - cap).drop("_n")
    return t.select("session_id", "request_id", F.col("turn_index").alias("index"), "model", "tokens", "at_ms")


def session_state(turns: DataFrame) -> DataFrame:
    """H1: latest conversation and model, first/last activity, token total, turn count."""
    key = F.struct(*[F.col(c) for c in ORDER])
    return (turns.groupBy("session_id")
                 .agg(F.max_by("messages", key).alias("messages"), F.max_by("model", key).alias("model"),
                      F.min_by("at_ms", key).alias("first_seen"), F.max_by("at_ms", key).alias("last_active"),
                      F.sum("tokens").cast("bigint").alias("total_tokens"),
                      F.count(F.lit(1)).alias("turns")))


def resume_sessions(turns: DataFrame, cap: int = 0) -> DataFrame:
    """H4: checkpoint per session: latest conversation, totals and the retained timeline.

    With ``cap > 0`` the newest ``cap`` timeline rows are attached as an array (a
    bounded group). With ``cap == 0`` the timeline is unbounded and stays in long
    form: use :func:`timeline` — a hot session's history is never collected into
    one row. ``turns`` is the retained count, ``all_turns`` counts every turn.
    Filter by ``session_id`` for one checkpoint; an unknown id yields no row.
    """
    cols = ["session_id", "model", "messages"]
    if cap > 0:
        # the numbered turns are a table of their own: the turns are built once for both sides
        numbered_ = turn_index(turns)
        st = session_state(numbered_)
        kept = (numbered_.select("session_id", "turn_index", "model", "tokens", "at_ms").join(st.select("session_id", F.col("turns").alias("_n")), "session_id")
                .where(F.col("turn_index") >= F.col("_n") - cap))
        tl = kept.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn_index").alias("index"), "model", "tokens", "at_ms"))).alias("timeline"))
        return st.join(tl, "session_id").select(*cols, "timeline", F.size("timeline").cast("bigint").alias("turns"),
                                                F.col("turns").alias("all_turns"), "first_seen", "last_active", "total_tokens")
    st = session_state(turns)
    return st.select(*cols, F.col("turns").cast("bigint").alias("turns"), F.col("turns").alias("all_turns"),
                     "first_seen", "last_active", "total_tokens")


def list_sessions(turns: DataFrame, cap: int = 0) -> DataFrame:
    """H5: one summary per session, newest activity first (ties: earlier first_seen)."""
    st = session_state(turns)
    retained = F.least(F.col("turns"), F.lit(cap)) if cap > 0 else F.col("turns")
    return (st.select("session_id", "model", retained.cast("bigint").alias("turns"), "last_active",
                      "total_tokens", "first_seen")
              .orderBy(F.col("last_active").desc(), F.col("first_seen")))


def purge_sessions(turns: DataFrame, purge: DataFrame | None) -> DataFrame:
    """H6: forget the listed sessions (``purge`` has a ``session_id`` column); None forgets all."""
    if purge is None:
        return turns.limit(0)
    return turns.join(purge.select("session_id").distinct(), "session_id", "left_anti")


def ttl_purge(turns: DataFrame, ttl_ms: int, now_ms: int | None = None) -> DataFrame:
    """H7: keep sessions active within ``ttl_ms`` of ``now_ms`` (default: newest activity seen).

    The default "now" is one scalar aggregate, not a window over all sessions."""
    st = session_state(turns)
    if now_ms is None:
        row = turns.agg(F.max("at_ms").alias("now")).first()
        now_ms = row["now"] if row and row["now"] is not None else 0
    return st.where(F.col("last_active") >= F.lit(now_ms - ttl_ms))


def transcript_preview(messages_flat: DataFrame) -> DataFrame:
    """Per message of a conversation: block texts (or ``[type]``) joined by a space, ``—`` if empty.

    Input: one row per block with session_id, msg_idx, block_idx, role, type, text.
    """
    # only text blocks have a ``text``; any other kind shows as ``[type]``; type ``none`` stands for a message without blocks
    piece = F.when(F.col("type") == "text", F.coalesce(F.col("text"), F.lit(""))) \
             .when(F.col("type") == "none", F.lit("")) \
             .otherwise(F.concat(F.lit("["), F.col("type"), F.lit("]")))
    agg = (messages_flat.groupBy("session_id", "msg_idx")
                        .agg(F.first("role").alias("role"),
                             F.array_sort(F.collect_list(F.struct("block_idx", piece.alias("p")))).alias("_b")))
    joined = F.array_join(F.transform("_b", lambda s: s["p"]), " ")
    return agg.select("session_id", "msg_idx", "role",
                      F.coalesce(F.when(joined != "", joined), F.lit(EMPTY_PREVIEW)).alias("preview"))


def latest_messages(turns: DataFrame) -> DataFrame:
    """Blocks of each session's latest conversation, one row per block."""
    st = session_state(turns).select("session_id", F.explode("messages").alias("m"))
    return st.select("session_id", "m.msg_idx", "m.block_idx", "m.role", "m.type", "m.text")
