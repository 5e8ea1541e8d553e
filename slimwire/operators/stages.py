"""Reduction stages as column rewrites over a ``blocks`` DataFrame.

A stage reads the current state columns of every block

    text STRING, drop BOOLEAN, cache BOOLEAN, tok BIGINT

and adds the proposed new state ``n_text``, ``n_drop``, ``n_cache`` plus two
request-level columns (constant within a request): ``n_hits`` (how many blocks it
touched, for the note) and ``n_obj`` (the stage produced a new request object,
which decides the pass-through of P6). The pipeline measures tokens, applies the
guardrail and commits or reverts (``slimwire.plans.reduce``).

Windows are always ``PARTITION BY session_id, request_id, ...`` or
``session_id, path`` so one hash partitioning on ``session_id`` serves them all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slimwire.functions import text as tx

REQ = ["session_id", "request_id"]


def pos() -> Column:
    """Order key of a block inside its request."""
    return F.struct(F.col("msg_idx"), F.col("block_idx"))


def w_request() -> Window:
    return Window.partitionBy(*REQ)


@dataclass(frozen=True)
class StageContext:
    """Per-run settings a stage may read. ``store`` may be a per-request column."""

    min_savings: float = tx.MIN_SAVINGS_TOKENS
    store: Column | bool = True
    tokenizer: Callable[[Column], Column] = tx.approx_tokens
    minimal_diff: bool = True    # False: native single hunk instead of minimal hunks in an Arrow UDF
    distinct_versions: bool = False   # True: diffs against the version before it, not against the send before it


@dataclass(frozen=True)
class Stage:
    """A reduction stage: ``rewrite(df, ctx) -> df`` adding n_text/n_drop/n_cache/n_hits/n_obj/n_note."""

    name: str
    enabled: bool
    reversible: bool
    rewrite: Callable[[DataFrame, StageContext], DataFrame]


def _hits(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).over(w_request()).cast("bigint")


# --------------------------------------------------------------------------- S1
def _cache_rewrite(df: DataFrame, ctx: StageContext) -> DataFrame:
    sys_live = (F.col("section") == "system") & ~F.col("drop")
    w = w_request()
    df = (df.withColumn("_last_sys", F.max(F.when(sys_live, pos())).over(w))
            .withColumn("_marked", F.max(F.when(sys_live & F.col("cache"), F.lit(1))).over(w)))
    apply = ((F.col("provider") == "anthropic") & F.col("_last_sys").isNotNull()
             & F.col("_marked").isNull())
    return (df.withColumn("n_text", F.col("text"))
              .withColumn("n_drop", F.col("drop"))
              .withColumn("n_cache", F.col("cache") | (apply & sys_live & (pos() == F.col("_last_sys"))))
              .withColumn("n_hits", F.when(apply, 1).otherwise(0).cast("bigint"))
              .withColumn("n_obj", apply)
              .withColumn("n_note",
                          F.when((F.col("provider") != "anthropic") | F.col("_last_sys").isNull(),
                                 F.lit("no cache breakpoint applied"))
                           .when(F.col("_marked").isNotNull(), F.lit("cache marker already present"))
                           .otherwise(F.lit("cache_control on final system block")))
              .drop("_last_sys", "_marked"))


# --------------------------------------------------------------------------- S6
def dedup_flag(df: DataFrame) -> Column:
    """Later exact copy (>=120 UTF-16 units) of a message text block in the same request."""
    n = F.octet_length(F.col("text"))
    long_enough = (n >= tx.MIN_DUP_CHARS) & ((F.char_length(F.col("text")) >= tx.MIN_DUP_CHARS)
                                             | (tx.utf16_len(F.col("text")) >= tx.MIN_DUP_CHARS))
    elig = ((F.col("section") == "message") & (F.col("type") == "text") & ~F.col("drop")
            & long_enough)
    # Hash first so the window sort compares 8 bytes; the text itself keeps it exact.
    w = Window.partitionBy(*REQ, elig, F.xxhash64(F.col("text")), F.col("text"))
    return elig & (pos() != F.min(pos()).over(w))


def _dedup_rewrite(df: DataFrame, ctx: StageContext) -> DataFrame:
    df = df.withColumn("_dup", dedup_flag(df))
    hits = _hits(F.col("_dup"))
    return (df.withColumn("n_text", F.when(F.col("_dup"), F.lit(tx.OMIT_MARKER)).otherwise(F.col("text")))
              .withColumn("n_drop", F.col("drop"))
              .withColumn("n_cache", F.col("cache"))
              .withColumn("n_hits", hits)
              .withColumn("n_obj", F.lit(True))
              .withColumn("n_note", F.when(F.col("n_hits") > 0,
                                           F.format_string("collapsed %d duplicate block(s)", F.col("n_hits")))
                                     .otherwise(F.lit("no duplicates found")))
              .drop("_dup"))


# --------------------------------------------------------------------------- S2-S5
def strip_columns(df: DataFrame) -> DataFrame:
    """Adds _clean (cleaned text), _blank and _rep (repeat within message / system)."""
    is_txt = (F.col("type") == "text") & ~F.col("drop")
    df = df.withColumn("_clean", F.when(is_txt, tx.clean_text(F.col("text"))).otherwise(F.col("text")))
    df = df.withColumn("_blank", is_txt & tx.is_blank(F.col("_clean")))
    keep_cand = is_txt & ~F.col("_blank")
    grp = F.when(F.col("section") == "system", F.lit(-1).cast("bigint")).otherwise(F.col("msg_idx"))
    w = Window.partitionBy(*REQ, F.col("section"), grp, keep_cand,
                           F.xxhash64(F.col("_clean")), F.col("_clean"))
    return df.withColumn("_rep", keep_cand & (pos() != F.min(pos()).over(w)))


def _strip_rewrite(df: DataFrame, ctx: StageContext) -> DataFrame:
    df = strip_columns(df)
    return (df.withColumn("n_text", F.col("_clean"))
              .withColumn("n_drop", F.col("drop") | F.col("_blank") | F.col("_rep"))
              .withColumn("n_cache", F.col("cache"))
              .withColumn("n_hits", _hits(F.col("_blank") | F.col("_rep")))
              .withColumn("n_obj", F.lit(True))
              .withColumn("n_note", F.lit("cleaned whitespace + removed duplicate text blocks"))
              .drop("_clean", "_blank", "_rep"))


# --------------------------------------------------------------------------- S7-S10
def _with_path(df: DataFrame, is_file_text: Column) -> DataFrame:
    """Adds _path, named by the first line of ``is_file_text`` where that is long enough, else NULL."""
    long_enough = (F.octet_length(is_file_text) >= tx.MIN_FILE_CHARS) & (tx.utf16_len(is_file_text) >= tx.MIN_FILE_CHARS)
    return df.withColumn("_path", F.when(long_enough, tx.detect_path(is_file_text)))


def _arrival(df: DataFrame) -> list[str]:
    return [c for c in ("at_ms", "request_id", "msg_idx", "block_idx") if c in df.columns]


def previous_versions(df: DataFrame, is_file_text: Column) -> DataFrame:
    """Adds _path, and of the version sent before it in the session, _prev (text) and _prev_request.

    Every qualifying block advances the file store in arrival order, also when the stage is later reverted: a lag over
    (session, path). Other rows are keyed by their request, so they never pile up in one (session, NULL) partition."""
    df = _with_path(df, is_file_text)
    w = Window.partitionBy("session_id", "_path",
                           F.when(F.col("_path").isNull(), F.col("request_id"))).orderBy(*map(F.col, _arrival(df)))
    known = F.col("_path").isNotNull()
    return (df.withColumn("_prev", F.when(known, F.lag("text").over(w)))
              .withColumn("_prev_request", F.when(known, F.lag("request_id").over(w))))


def previous_distinct_versions(df: DataFrame, is_file_text: Column) -> DataFrame:
    """The columns of :func:`previous_versions`, where a version is a text that is new to its file: every send of it has the
    version before it as _prev, and no send the version itself. So a history that sends v1 and v2 again has v2 against v1,
    and v1 whole.

    Versions of a file are numbered in order of their first sends, in ranges, and a version meets the one before it
    by its number: neither a file of many versions nor a version of many sends is one task's work."""
    from slimwire.plans.ordered import numbered

    df = _with_path(df, is_file_text).withColumn("_version", F.when(F.col("_path").isNotNull(), F.sha2("text", 256)))
    file = ["session_id", "_path"]
    order = _arrival(df)
    sends = df.where("_path is not null").select(*file, "_version", "text", F.struct(*order).alias("_first"))
    versions = sends.groupBy(*file, "_version").agg(F.min("_first").alias("_first"), F.first("text").alias("_text"))
    placed = numbered(versions, [*file, "_first"], "_at", "file-versions")
    before = placed.select((F.col("_at") + 1).alias("_at"), *(F.col(c).alias(f"_before{c}") for c in file),
                           F.col("_text").alias("_prev"), F.col("_first.request_id").alias("_prev_request"))
    same = F.lit(True)
    for c in file:
        same = same & (F.col(c) == F.col(f"_before{c}"))
    linked = placed.join(before, "_at").where(same).select(*file, "_version", "_prev", "_prev_request")
    return df.join(linked, [*file, "_version"], "left").select(*(c for c in df.columns if c != "_version"), "_prev", "_prev_request")


# Fixed value: what stands between a file's name with its line count and the diff.
SENT_AS_DIFF = " lines, sent as a diff vs. the previous version:\n\n"


def restored_text(sent: Column, previous: Column) -> Column:
    """The whole text of a file block, also where filediff ``sent`` it as a diff against its ``previous`` version."""
    from slimwire.operators.diff import apply_diff_udf

    at = F.locate(SENT_AS_DIFF, sent)
    head = F.substring_index(sent, SENT_AS_DIFF, 1)
    is_diff = (at > 0) & previous.isNotNull() & head.rlike(r"\A\S+ — \d+\z")
    diff = F.when(is_diff, F.substr(sent, at + len(SENT_AS_DIFF)))
    return F.coalesce(apply_diff_udf(F.when(is_diff, previous), diff), sent)


def _filediff_rewrite(df: DataFrame, ctx: StageContext) -> DataFrame:
    from slimwire.operators.diff import line_diff_udf, with_unified_diff

    store = ctx.store if isinstance(ctx.store, Column) else F.lit(bool(ctx.store))
    is_file = (F.col("section") == "message") & (F.col("type") == "text") & ~F.col("drop") & store
    versions = previous_distinct_versions if ctx.distinct_versions else previous_versions
    df = versions(df, F.when(is_file, F.col("text"))).drop("_prev_request")
    cand = F.col("_prev").isNotNull() & (F.col("_prev") != F.col("text"))
    if ctx.minimal_diff:
        # multi-hunk minimal diff in an Arrow UDF
        df = df.withColumn("_diff", line_diff_udf(F.when(cand, F.col("_path")),
                                                  F.when(cand, F.col("_prev")),
                                                  F.when(cand, F.col("text"))))
    else:
        df = (df.withColumn("_dprev", F.when(cand, F.col("_prev"))).withColumn("_dcur", F.when(cand, F.col("text")))
                .transform(lambda d: with_unified_diff(d, "_path", "_dprev", "_dcur", "_diff"))
                .drop("_dprev", "_dcur"))
    rewrite = cand & (tx.utf16_len(F.col("_diff")) < tx.utf16_len(F.col("text")))
    new_text = F.concat(F.col("_path"), F.lit(" — "),
                        F.size(F.split(F.col("_prev"), "\n", -1)).cast("string"), F.lit(SENT_AS_DIFF), F.col("_diff"))
    df = df.withColumn("_rw", F.coalesce(rewrite, F.lit(False)))
    return (df.withColumn("n_text", F.when(F.col("_rw"), new_text).otherwise(F.col("text")))
              .withColumn("n_drop", F.col("drop"))
              .withColumn("n_cache", F.col("cache"))
              .withColumn("n_hits", _hits(F.col("_rw")))
              .withColumn("n_obj", store)
              .withColumn("n_note", F.when(~store, F.lit("no file store; skipped"))
                                     .when(F.col("n_hits") > 0,
                                           F.format_string("diffed %d file(s)", F.col("n_hits")))
                                     .otherwise(F.lit("no re-sent files to diff")))
              .drop("_path", "_prev", "_diff", "_rw"))


# --------------------------------------------------------------------------- S11, S12
def _stub(note: str) -> Callable[[DataFrame, StageContext], DataFrame]:
    def rewrite(df: DataFrame, ctx: StageContext) -> DataFrame:
        return (df.withColumn("n_text", F.col("text")).withColumn("n_drop", F.col("drop"))
                  .withColumn("n_cache", F.col("cache")).withColumn("n_hits", F.lit(0).cast("bigint"))
                  .withColumn("n_obj", F.lit(False)).withColumn("n_note", F.lit(note)))
    return rewrite


CACHE = Stage("cache", True, True, _cache_rewrite)
DEDUP = Stage("dedup", False, False, _dedup_rewrite)
STRIP = Stage("strip", True, True, _strip_rewrite)
FILEDIFF = Stage("filediff", False, False, _filediff_rewrite)
SLICE = Stage("slice", False, False, _stub("stub: no files sliced"))
INTENT = Stage("intent", False, False, _stub("stub: no metadata extracted"))

# Fixed order, conservative to aggressive. Stages do not commute.
ORDERED_STAGES: list[Stage] = [CACHE, DEDUP, STRIP, FILEDIFF, SLICE, INTENT]
TOGGLE_KEYS = ("cache", "dedup", "strip", "filediff", "slice", "intent")


def custom_stage(name: str, rewrite_text: Callable[[DataFrame], DataFrame], *, reversible: bool,
                 enabled: bool = True, note: str = "") -> Stage:
    """A user stage. ``rewrite_text(df)`` returns df with ``n_text`` and optionally
    ``n_drop``; the pipeline measures, guards and logs it like a built-in stage. A result may
    also say for its request whether it is reversible (``n_reversible``) and what to note
    (``n_note``), the same on all blocks of the request; ``reversible`` and ``note`` are the defaults."""

    def rewrite(df: DataFrame, ctx: StageContext) -> DataFrame:
        out = rewrite_text(df)
        if "n_drop" not in out.columns:
            out = out.withColumn("n_drop", F.col("drop"))
        changed = _hits(~F.col("n_text").eqNullSafe(F.col("text")) | (F.col("n_drop") != F.col("drop")))
        noted = F.coalesce(F.col("n_note"), F.lit(note)) if "n_note" in out.columns else F.lit(note)
        return (out.withColumn("n_cache", F.col("cache")).withColumn("n_hits", changed)
                   .withColumn("n_obj", F.lit(True)).withColumn("n_note", noted))

    return Stage(name, enabled, reversible, rewrite)
