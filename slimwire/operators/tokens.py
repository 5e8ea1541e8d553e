"""Token accounting jobs over block and text tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimwire.functions import text as tx

BROADCAST_MAX_ROWS = 100_000   # dimension tables above this are joined with a shuffle


def request_tokens(blocks: DataFrame, tokenizer: Callable[[Column], Column] = tx.approx_tokens,
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Per request, the sum of per-block counts (each block rounded up on its own). Rows of type ``none``
    (``normalize(..., keep_empty=True)``) bring in requests without blocks, with 0 tokens and 0 blocks.
    ``keep``: columns that are the same for all blocks of a request."""
    rendered = tx.render_block("type", "text", "tool_name", "payload", "rendered")
    return (blocks.groupBy("session_id", "request_id")
                  .agg(*[F.first(c).alias(c) for c in keep], F.sum(tokenizer(rendered)).cast("bigint").alias("tokens"),
                       F.sum(F.when(F.col("type") != "none", 1).otherwise(0)).cast("bigint").alias("blocks")))


def token_report(texts: DataFrame, text_col: str = "text", model_col: str | None = "model",
                 tokenizer: Callable[[Column], Column] = tx.approx_tokens) -> DataFrame:
    """Tokens, UTF-16 characters and the approximate flag for each text.

    A NULL text counts as ``""``; a missing model is ``generic``.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    model = F.coalesce(F.col(model_col), F.lit("generic")) if model_col else F.lit("generic")
    return texts.select("*", model.alias("_model")).select(
        *[c for c in texts.columns if c != text_col and c != model_col],
        F.col("_model").alias("model"), tokenizer(t).alias("tokens"), tx.utf16_len(t).alias("characters"),
        (~tx.exact_for_model(F.col("_model"))).alias("approximate"))


def chars_per_token(report: DataFrame) -> DataFrame:
    """Characters per token to 2 places; NULL (shown as a dash) for 0 tokens."""
    return report.withColumn(
        "chars_per_token",
        F.when(F.col("tokens") > 0, tx.js_round(F.col("characters") / F.col("tokens"), 2)))


def small_dim(dim: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Broadcast a dimension only after checking its size (reads at most max_rows+1 rows)."""
    max_rows = BROADCAST_MAX_ROWS if max_rows is None else max_rows
    n = dim.limit(max_rows + 1).count()
    return F.broadcast(dim) if n <= max_rows else dim


def input_cost(df: DataFrame, prices: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Tokens / 1e6 * price[model]; unknown models use the ``generic`` price."""
    row = prices.where(F.col("model") == "generic").select("usd_per_mtok").first()
    generic = F.lit(row[0] if row else None).cast("double")
    p = prices.select(F.col("model").alias("_pm"), F.col("usd_per_mtok").alias("_price"))
    out = df.join(small_dim(p), F.col("model") == F.col("_pm"), "left")
    return (out.withColumn("usd", F.col(tokens_col) / F.lit(1_000_000.0) * F.coalesce(F.col("_price"), generic))
               .drop("_pm", "_price"))


def resend_cost(blocks: DataFrame, tokenizer: Callable[[Column], Column] = tx.approx_tokens) -> DataFrame:
    """Per session, tokens billed again because a block of any kind is re-sent on later requests.

    Blocks are the same when their keys are (S14; tool definitions by what they are counted by) and cost what
    they are counted by (T2). Pre-aggregated per (session, key hash): partial aggregation combines the copies
    map-side, so a hot session is spread over its distinct blocks.
    """
    rendered = tx.render_block("type", "text", "tool_name", "payload", "rendered")
    key = F.when(F.col("type") == "tool", F.concat(F.lit("d:"), rendered)).otherwise(
        tx.block_key("type", "text", "tool_id", "tool_name", "payload"))
    keyed = blocks.where(F.col("type") != "none").select("session_id", "request_id", F.sha2(key, 256).alias("h"),
                                                         tokenizer(rendered).alias("tok"))
    per_text = (keyed.groupBy("session_id", "h")
                     .agg(F.count(F.lit(1)).alias("times_sent"), F.first("tok").alias("tok")))
    return (per_text.groupBy("session_id")
                    .agg(F.count(F.lit(1)).alias("distinct_texts"),
                         F.sum(F.col("tok") * F.col("times_sent")).cast("bigint").alias("billed_tokens"),
                         F.sum(F.col("tok") * (F.col("times_sent") - 1)).cast("bigint").alias("resent_tokens")))
