"""Run the ordered stages over a blocks table with measured savings and a guardrail.

Shape of the plan (one hash exchange on ``(session_id, request_id)``; every window but
filediff's and the final per-request aggregate are partitioned by a superset of it, so
Spark adds sorts but no further exchanges)::

    blocks -> repartition(session_id, request_id) -> tok
      for stage in enabled: rewrite -> n_tok -> saved = sum(tok)-sum(n_tok) OVER request
                            revert = lossy AND saved < min -> commit or keep
      -> per-request aggregate (totals + stage array) -> ledger via inline()

Request totals are window sums rather than groupBy + join, because a join would
demand co-partitioning on all of its keys and add exchanges.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimwire.functions import text as tx
from slimwire.operators.stages import (ORDERED_STAGES, REQ, TOGGLE_KEYS, Stage, StageContext,
                                       w_request)

DEFAULT_TOGGLES = {"cache": True, "strip": True, "dedup": False, "filediff": False,
                   "slice": False, "intent": False}


@dataclass(frozen=True)
class Config:
    """The reduction config: stage toggles, guardrail threshold and the store flag."""

    stages: Mapping[str, bool] | None = None
    min_savings: float = tx.MIN_SAVINGS_TOKENS
    store: bool = True
    # filediff: multi-hunk diff of the shortest edit script (a per-row helper in an Arrow UDF) or, when False, the native single hunk (no Python, no extra exchange)
    minimal_diff: bool = True
    # filediff against the version before a text's first send rather than against the send before it
    distinct_versions: bool = False

    def toggles(self) -> dict[str, bool]:
        # Config keys win; unknown or non-boolean values are ignored.
        out = dict(DEFAULT_TOGGLES)
        for k, v in (self.stages or {}).items():
            if k in out and isinstance(v, bool):
                out[k] = v
        return out


def enabled_stages(config: Config, stages: Sequence[Stage] = ORDERED_STAGES) -> list[Stage]:
    """A stage with a toggle key follows the config, any other follows its own flag."""
    toggles = config.toggles()
    return [s for s in stages if (toggles[s.name] if s.name in TOGGLE_KEYS else s.enabled)]


@dataclass
class Reduction:
    """Lazy outputs of one pipeline run; all derive from ``blocks``."""

    blocks: DataFrame          # final block state (drop flag kept so empty messages survive)
    per_request: DataFrame     # one row per request: totals, changed flag, stage array
    stage_names: list[str]

    @property
    def ledger(self) -> DataFrame:
        """One row per (request, enabled stage)."""
        return (self.per_request
                .select("session_id", "request_id", "model", F.inline("stages"))
                .select("session_id", "request_id", "model", "stage", "ord", "saved", "measured",
                        "reversible", "reverted", "notes"))

    @property
    def requests(self) -> DataFrame:
        return self.per_request.drop("stages")


def block_tokens(tokenizer: Callable[[Column], Column]) -> Column:
    """Tokens of one block in its current state (0 once dropped)."""
    rendered = tx.render_block("type", "text", "tool_name", "payload", "rendered")
    return F.when(F.col("drop"), F.lit(0).cast("bigint")).otherwise(tokenizer(rendered))


def prepare_blocks(blocks: DataFrame) -> DataFrame:
    """Repartition once by request and add the mutable state columns.

    A request is the unit of every stage but filediff, so a hot session (say every
    header-less request, in session ``default``) is spread over many tasks; filediff's
    lag over (session, path) brings exchanges of its own when it is on.
    """
    return (blocks.repartition(*REQ)
                  .withColumn("drop", F.lit(False)).withColumn("edited", F.lit(False))
                  .withColumn("cache", F.coalesce(F.col("cache_control"), F.lit(False))))


def reduce_requests(blocks: DataFrame, config: Config | None = None,
                    stages: Sequence[Stage] | None = None,
                    tokenizer: Callable[[Column], Column] = tx.approx_tokens,
                    per_request_config: DataFrame | None = None,
                    config_log: DataFrame | None = None) -> Reduction:
    """P5: reduce every request of a blocks table.

    ``per_request_config`` (from :func:`slimwire.plans.config_asof.config_as_of`) holds
    one row per (session_id, request_id) with boolean columns named after the stages plus
    ``min_savings`` and ``store``; when given, toggles are columns (P7) and every
    stage with a toggle key is planned but gated per request. ``config_log``
    (intervals, see ``config_asof``) does the same without a per-request table:
    every block carries its request's ``at_ms``, so the log is joined onto the blocks by
    time bucket and range. Blocks of type ``none`` stand for requests and messages without
    blocks (``normalize(..., keep_empty=True)``): they cost nothing and count as no block,
    but their request gets its row.
    """
    if config_log is not None:
        from slimwire.plans.config_asof import config_as_of
        blocks = config_as_of(blocks, config_log)
        per_request_config = blocks.select(*REQ)   # marker: toggles are columns now
    config = config or Config()
    all_stages = list(stages) if stages is not None else list(ORDERED_STAGES)
    if per_request_config is None:
        run = enabled_stages(config, all_stages)
    else:
        run = all_stages
    df = blocks
    if config_log is not None:
        df = df.select("*", *[F.col(k).alias("cfg_" + k) for k in TOGGLE_KEYS],
                       F.col("min_savings").alias("cfg_min"), F.col("store").alias("cfg_store"))
        min_col = F.coalesce(F.col("cfg_min").cast("double"), F.lit(float(config.min_savings)))
        store_col = F.coalesce(F.col("cfg_store"), F.lit(config.store))
    elif per_request_config is not None:
        cfg = per_request_config.select(
            *REQ, *[F.col(k).alias("cfg_" + k) for k in TOGGLE_KEYS],
            F.col("min_savings").alias("cfg_min"), F.col("store").alias("cfg_store"))
        # one row per request; the join's strategy is left to AQE
        df = df.join(cfg, REQ, "left")
        min_col = F.coalesce(F.col("cfg_min").cast("double"), F.lit(float(config.min_savings)))
        store_col = F.coalesce(F.col("cfg_store"), F.lit(config.store))
    else:
        min_col = F.lit(float(config.min_savings))
        store_col = F.lit(config.store)

    df = prepare_blocks(df)
    df = df.withColumn("tok", block_tokens(tokenizer))
    w = w_request()
    df = df.withColumn("tokens_before", F.sum("tok").over(w).cast("bigint"))
    df = df.withColumn("_changed", F.lit(False))

    stage_structs = []
    for ord_, stage in enumerate(run):
        name = stage.name
        if per_request_config is not None and name in TOGGLE_KEYS:
            on = F.coalesce(F.col("cfg_" + name), F.lit(False))
        else:
            on = F.lit(True)
        store = store_col & on if name == "filediff" else store_col
        ctx = StageContext(min_savings=config.min_savings, store=store, tokenizer=tokenizer,
                           minimal_diff=config.minimal_diff, distinct_versions=config.distinct_versions)
        df = stage.rewrite(df, ctx).withColumn("_edit", ~F.col("n_text").eqNullSafe(F.col("text")))
        _edit = F.col("_edit")
        # Recount only blocks whose rendered content changed.
        changed_blk = (~F.col("n_text").eqNullSafe(F.col("text"))) | (F.col("n_drop") != F.col("drop"))
        new_tok = F.when(F.col("n_drop"), F.lit(0).cast("bigint")).when(
            changed_blk, tokenizer(tx.render_block("type", "n_text", "tool_name", "payload", "rendered"))
        ).otherwise(F.col("tok"))
        df = df.withColumn("n_tok", new_tok)
        df = df.withColumn(f"_m{ord_}", F.sum(F.col("tok") - F.col("n_tok")).over(w).cast("bigint"))
        usual = F.lit(stage.reversible)
        df = df.withColumn(f"_v{ord_}", F.coalesce(F.col("n_reversible"), usual) if "n_reversible" in df.columns else usual)
        df = df.withColumn(f"_r{ord_}", on & ~F.col(f"_v{ord_}") & (F.col(f"_m{ord_}") < min_col))
        commit = on & ~F.col(f"_r{ord_}")
        note = F.when(F.col(f"_r{ord_}"), F.format_string(
            "reverted: saved %d < min %s", F.col(f"_m{ord_}"),
            F.when(min_col == F.floor(min_col), F.floor(min_col).cast("bigint").cast("string"))
             .otherwise(min_col.cast("string")))).otherwise(F.col("n_note"))
        df = (df.withColumn("text", F.when(commit, F.col("n_text")).otherwise(F.col("text")))
                .withColumn("drop", F.when(commit, F.col("n_drop")).otherwise(F.col("drop")))
                .withColumn("cache", F.when(commit, F.col("n_cache")).otherwise(F.col("cache")))
                .withColumn("tok", F.when(commit, F.col("n_tok")).otherwise(F.col("tok")))
                .withColumn("edited", F.col("edited") | (commit & _edit))
                .withColumn("_changed", F.col("_changed") | (commit & F.col("n_obj")))
                .withColumn(f"_n{ord_}", note).withColumn(f"_on{ord_}", on)
                .drop("n_text", "n_drop", "n_cache", "n_tok", "n_hits", "n_obj", "n_note", "n_reversible", "_edit"))
        stage_structs.append((ord_, stage))

    out_blocks = (df.withColumn("tokens_after", F.sum("tok").over(w).cast("bigint"))
                    .withColumn("changed", F.max("_changed").over(w)))   # of the whole request

    is_block = F.col("type") != "none"
    aggs = [F.first("model").alias("model"), F.first("provider").alias("provider"),
            F.first("at_ms").alias("at_ms"),
            F.first("tokens_before").alias("tokens_before"),
            F.sum("tok").cast("bigint").alias("tokens_after"),
            F.max(F.col("_changed").cast("int")).alias("_chg"),
            F.sum(F.when(is_block, 1).otherwise(0)).cast("bigint").alias("blocks_in"),
            F.sum(F.when(is_block & ~F.col("drop"), 1).otherwise(0)).cast("bigint").alias("blocks_out"),
            F.sum(F.when(F.col("cache") & ~F.col("drop") & ~F.coalesce(F.col("cache_control"), F.lit(False)), 1)
                  .otherwise(0)).cast("bigint").alias("markers_added"),
            # a cache marker goes with its block when a later stage drops that
            F.sum(F.when(F.col("cache") & F.col("drop"), 1).otherwise(0)).cast("bigint").alias("markers_lost")]
    for ord_, stage in stage_structs:
        aggs += [F.first(f"_v{ord_}").alias(f"_v{ord_}"), F.first(f"_m{ord_}").alias(f"_m{ord_}"), F.first(f"_r{ord_}").alias(f"_r{ord_}"),
                 F.first(f"_n{ord_}").alias(f"_n{ord_}"), F.first(f"_on{ord_}").alias(f"_on{ord_}")]
    per_req = df.groupBy(*REQ).agg(*aggs)
    structs = []
    for ord_, stage in stage_structs:
        measured = F.col(f"_m{ord_}")
        reverted = F.col(f"_r{ord_}")
        structs.append(F.when(F.col(f"_on{ord_}"), F.struct(
            F.lit(stage.name).alias("stage"), F.lit(ord_).alias("ord"),
            F.when(reverted, F.lit(0).cast("bigint")).otherwise(measured).alias("saved"),
            measured.alias("measured"), F.col(f"_v{ord_}").alias("reversible"),
            reverted.alias("reverted"), F.col(f"_n{ord_}").alias("notes"))))
    stages_arr = (F.filter(F.array(*structs), lambda s: s.isNotNull()) if structs
                  else F.array().cast("array<struct<stage:string,ord:int,saved:bigint,measured:bigint,"
                                      "reversible:boolean,reverted:boolean,notes:string>>"))
    per_req = per_req.select(
        *REQ, "model", "provider", "at_ms", "tokens_before", "tokens_after",
        (F.col("tokens_before") - F.col("tokens_after")).alias("saved"),
        (F.col("_chg") == 1).alias("changed"), "blocks_in", "blocks_out", "markers_added", "markers_lost",
        stages_arr.alias("stages"))
    return Reduction(out_blocks, per_req, [s.name for _, s in stage_structs])


def savings_by_model(red: Reduction) -> DataFrame:
    """Minimum slice: requests, tokens before/after and savings per model."""
    r = red.requests
    return (r.groupBy("model")
             .agg(F.count(F.lit(1)).alias("requests"),
                  F.sum("tokens_before").cast("bigint").alias("tokens_before"),
                  F.sum("tokens_after").cast("bigint").alias("tokens_after"),
                  F.sum("saved").cast("bigint").alias("saved"))
             .withColumn("saved_pct", F.when(F.col("tokens_before") > 0,
                                             tx.js_round(F.col("saved") / F.col("tokens_before") * 100, 1))
                                       .otherwise(F.lit(0.0))))


def savings_by_stage(red: Reduction) -> DataFrame:
    """Per-stage totals and revert rate over the whole log."""
    led = red.ledger
    return (led.groupBy("stage", "ord")
               .agg(F.count(F.lit(1)).alias("runs"),
                    F.sum("saved").cast("bigint").alias("saved"),
                    F.sum("measured").cast("bigint").alias("measured"),
                    F.sum(F.col("reverted").cast("int")).cast("bigint").alias("reverted"),
                    tx.js_round(F.avg(F.col("reverted").cast("double")) * 100, 1).alias("revert_pct")))
