"""SURVEY §5 invariants on the small fixture, and scan pruning."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from slimwire.plans.reduce import Config, reduce_requests
from slimwire.sources import tables as tb


def test_ledger_adds_up_and_guardrail_holds(spark):
    for blocks in (tb.dup_blocks(spark, SF_SMALL), tb.noisy_blocks(spark, SF_SMALL)):
        red = reduce_requests(blocks, Config(stages={"dedup": True}))
        led = red.ledger.groupBy("request_id").agg(F.sum("saved").alias("s"))
        j = red.requests.join(led, "request_id")
        assert j.where(F.col("saved") != F.col("s")).count() == 0
        bad = red.ledger.where(~F.col("reversible") & ~F.col("reverted") & (F.col("saved") < 32))
        assert bad.count() == 0


def test_dedup_keeps_every_first_copy(spark):
    blocks = tb.dup_blocks(spark, SF_SMALL)
    red = reduce_requests(blocks, Config(stages={"dedup": True, "strip": False}, min_savings=0))
    before = blocks.select("request_id", "text").distinct()
    after = red.blocks.select("request_id", "text").distinct()
    # every original text still appears in its request (first copies survive)
    assert before.join(after, ["request_id", "text"], "left_anti").count() == 0


def test_lossless_strip_keeps_distinct_cleaned_texts(spark):
    from slimwire.functions import text as tx
    blocks = tb.line_blocks(spark, SF_SMALL)
    red = reduce_requests(blocks, Config(stages={"cache": False}))
    want = (blocks.select("request_id", tx.clean_text("text").alias("t"))
                  .where(~tx.is_blank("t")).distinct())
    got = red.blocks.where(~F.col("drop")).select("request_id", F.col("text").alias("t")).distinct()
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_scans_read_only_needed_columns(spark):
    from slimwire.operators import metrics as mx
    df = mx.metrics_total(tb.request_metrics(spark, SF_SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan, plan
