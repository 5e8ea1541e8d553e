import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[4]").appName("slimwire-tests")
             .config("spark.sql.shuffle.partitions", "4")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # tests set their own checkpoint folder only where the session has none
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        d = tempfile.mkdtemp(prefix="slimwire-test-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
        spark.sparkContext.setCheckpointDir(d)
    yield spark


def blocks_df(spark, rows):
    """Tiny blocks table: rows are dicts with at least request_id, section, msg_idx, block_idx, text."""
    from slimwire.sources.tables import BLOCK_COLUMNS
    full = []
    for r in rows:
        d = {"request_id": 1, "session_id": "s", "at_ms": 0, "provider": "anthropic", "model": "m",
             "section": "message", "msg_idx": 0, "block_idx": 0, "role": "user", "type": "text", "text": "",
             "tool_id": None, "tool_name": None, "payload": None, "is_error": None, "cache_control": False,
             "rendered": None}
        d.update(r)
        full.append(tuple(d[c] for c in BLOCK_COLUMNS))
    schema = ("request_id long, session_id string, at_ms long, provider string, model string, section string, "
              "msg_idx long, block_idx long, role string, type string, text string, tool_id string, "
              "tool_name string, payload string, is_error boolean, cache_control boolean, rendered string")
    return spark.createDataFrame(full, schema)
