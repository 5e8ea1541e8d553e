"""Column functions against the reference's own vectors and brute-force Python."""

from pyspark.sql import functions as F

from slimwire.functions import text as tx


def one(spark, col, value, schema="t string"):
    return spark.createDataFrame([(value,)], schema).select(col.alias("x")).first()["x"]


def py_fnv(s: str) -> str:
    h = 0x811C9DC5
    units = s.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h ^= (units[i] << 8) | units[i + 1]
        h = (h * 0x01000193) & 0xFFFFFFFF
    return format(h, "x")


def test_approx_tokens(spark):
    assert one(spark, tx.approx_tokens("t"), "") == 0
    assert one(spark, tx.approx_tokens("t"), "abcd") == 1
    assert one(spark, tx.approx_tokens("t"), "abcde") == 2
    assert one(spark, tx.approx_tokens("t"), None) == 0


def test_utf16_length_counts_surrogate_pairs(spark):
    assert one(spark, tx.utf16_len("t"), "a\U0001F600b") == 4
    assert one(spark, tx.utf16_len("t"), "héllo") == 5


def test_js_round_ties_toward_positive_infinity(spark):
    assert one(spark, tx.js_round(F.col("t"), 0), -2.5, "t double") == -2.0
    assert one(spark, tx.js_round(F.col("t"), 0), 2.5, "t double") == 3.0
    assert one(spark, tx.js_round(F.col("t"), 1), 41.66, "t double") == 41.7


def test_clean_text_vector(spark):
    assert one(spark, tx.clean_text("t"), "line  \n\n\n\nmore   ") == "line\n\nmore"
    assert one(spark, tx.clean_text("t"), "a \t\r\nb") == "a \t\r\nb"   # \r is not stripped (per line split)


def test_is_blank_uses_javascript_whitespace(spark):
    for v in ["", "   ", " \n\t", "﻿", " "]:
        assert one(spark, tx.is_blank("t"), v) is True
    assert one(spark, tx.is_blank("t"), " a ") is False


def test_fnv1a32_matches_python(spark):
    for s in ["", "a", "ab", "hello world", "a\U0001F600b", "ÉtionÇ"]:
        assert one(spark, tx.fnv1a32("t"), s) == py_fnv(s), s


def test_fnv1a32_of_many_texts_without_a_lambda_a_unit(spark):
    texts = [None, "", *("ab\U0001F600É"[i % 4] * (i % 57) + str(i) for i in range(300)), "long " * 4000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(2).select("i", tx.fnv1a32("t").alias("h"))
    assert {r["i"]: r["h"] for r in df.collect()} == {i: None if t is None else py_fnv(t) for i, t in enumerate(texts)}
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()   # a native fold took 160 of 200 CPU seconds of c2


def test_detect_path(spark):
    cases = {"src/app.ts": "src/app.ts", "// src/a.ts": "src/a.ts", "# tools/x.py": "tools/x.py",
             "-- q.sql": "q.sql", "/* styles/a.css */": "styles/a.css", "hello world": None,
             "  lib/@scope/x.js  ": "lib/@scope/x.js", "no_extension": None}
    for first, want in cases.items():
        assert one(spark, tx.detect_path("t"), first + "\nbody") == want, first


def test_exact_for_model(spark):
    for m, want in {"gpt-4o": True, "o3": True, "GPT-4": True, "text-davinci-003": True,
                    "claude-sonnet-4-6": False, "model_0": False, "omni": False}.items():
        assert one(spark, tx.exact_for_model("t"), m) is want, m


def test_block_key(spark):
    df = spark.createDataFrame([("text", "hi", None, None, None), ("tool_use", None, "1", "ab", '{"x":1}'),
                                ("raw", None, None, None, None)],
                               "type string, text string, tool_id string, tool_name string, payload string")
    keys = [r[0] for r in df.select(tx.block_key("type", "text", "tool_id", "tool_name", "payload")).collect()]
    assert keys == ["t:hi", 'u:1ab{"x":1}', "x:null"]
