"""Input tables: the raw parquet tables and the request-log views derived from them.

The raw tables are read with ``spark.read.parquet``; every derived view is a lazy
DataFrame over them, so Catalyst prunes columns and pushes filters into the scans.
The DuckDB text of the same views lives in ``slimwire.plans.oracle_views``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split()

# Canonical block schema (column order of every ``blocks`` DataFrame).
# Ids of conversations are spaced by this many turns, document lines by this many lines.
TURNS = 1_000_000
LINES = 100_000_000
# Documents whose copies can meet in one derived request.
DUP_RANGE = 5_000

BLOCK_COLUMNS = ["request_id", "session_id", "at_ms", "provider", "model", "section",
                 "msg_idx", "block_idx", "role", "type", "text", "tool_id", "tool_name",
                 "payload", "is_error", "cache_control", "rendered"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text_block_defaults(df: DataFrame) -> DataFrame:
    """Fill the typed-block columns of plain text blocks."""
    cols = {
        "type": F.lit("text"),
        "tool_id": F.lit(None).cast("string"),
        "tool_name": F.lit(None).cast("string"),
        "payload": F.lit(None).cast("string"),
        "is_error": F.lit(None).cast("boolean"),
        "cache_control": F.lit(False),
        "rendered": F.lit(None).cast("string"),
    }
    for k, v in cols.items():
        if k not in df.columns:
            df = df.withColumn(k, v)
    return df.select(*BLOCK_COLUMNS)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per user turn of a conversation (the conversation so far is re-sent)."""
    c = read_table(spark, sf_dir, "conversations")
    return (c.where(F.col("role") == "user")
             .select((F.col("conv_id") * TURNS + F.col("turn")).alias("request_id"),
                     F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
                     (F.col("conv_id") * TURNS + F.col("turn") * 10).alias("at_ms"),
                     F.when(F.col("conv_id") % 2 == 0, "anthropic").otherwise("openai").alias("provider"),
                     F.concat(F.lit("model_"), (F.col("conv_id") % 4).cast("string")).alias("model"),
                     F.col("conv_id"), F.col("turn")))


def request_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative history per request: every earlier turn becomes one text block.

    Joined on ``conv_id`` (an equi-join, so it shuffles by conversation) with the
    turn bound as a residual filter.
    """
    r = requests(spark, sf_dir).alias("r")
    m = read_table(spark, sf_dir, "conversations").alias("m")
    j = r.join(m, (F.col("m.conv_id") == F.col("r.conv_id")) & (F.col("m.turn") <= F.col("r.turn")))
    out = j.select(
        F.col("r.request_id"), F.col("r.session_id"), F.col("r.at_ms"), F.col("r.provider"),
        F.col("r.model"),
        F.when((F.col("m.role") == "system") & (F.col("r.provider") == "anthropic"), "system")
         .otherwise("message").alias("section"),
        F.col("m.turn").alias("msg_idx"), F.lit(0).cast("bigint").alias("block_idx"),
        F.col("m.role").alias("role"), F.col("m.text").alias("text"))
    return _text_block_defaults(out)


def dup_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of an id range grouped by length into 97 requests, where exact copies meet; the
    number of requests grows with the documents."""
    d = read_table(spark, sf_dir, "documents")
    k = F.floor(F.col("doc_id") / DUP_RANGE).cast("bigint") * 97 + F.col("n_chars") % 97
    out = d.select(k.alias("request_id"), F.concat(F.lit("b"), k.cast("string")).alias("session_id"),
                   k.alias("at_ms"), F.lit("openai").alias("provider"), F.lit("model_0").alias("model"),
                   F.lit("message").alias("section"), F.col("doc_id").alias("msg_idx"),
                   F.lit(0).cast("bigint").alias("block_idx"), F.lit("user").alias("role"),
                   F.col("text"))
    return _text_block_defaults(out)


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a one-message request; each of its lines is a text block."""
    d = read_table(spark, sf_dir, "documents")
    ex = d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "ln"))
    out = ex.select(F.col("doc_id").alias("request_id"),
                    F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("session_id"),
                    F.col("doc_id").alias("at_ms"), F.lit("openai").alias("provider"),
                    F.lit("model_0").alias("model"), F.lit("message").alias("section"),
                    F.lit(0).cast("bigint").alias("msg_idx"), F.col("pos").cast("bigint").alias("block_idx"),
                    F.lit("user").alias("role"), F.col("ln").alias("text"))
    return _text_block_defaults(out)


def system_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per request of the cached provider; each of its lines is a system block."""
    d = read_table(spark, sf_dir, "documents")
    ex = d.select("doc_id", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "ln"))
    out = ex.select(F.col("doc_id").alias("request_id"),
                    F.concat(F.lit("y"), F.col("doc_id").cast("string")).alias("session_id"),
                    F.col("doc_id").alias("at_ms"), F.lit("anthropic").alias("provider"),
                    F.lit("model_1").alias("model"), F.lit("system").alias("section"),
                    F.lit(0).cast("bigint").alias("msg_idx"), F.col("pos").cast("bigint").alias("block_idx"),
                    F.lit("system").alias("role"), F.col("ln").alias("text"))
    return _text_block_defaults(out)


def noisy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with trailing blanks and runs of blank lines added after each sentence."""
    d = read_table(spark, sf_dir, "documents")
    return d.select("doc_id", F.replace(F.col("text"), F.lit(". "), F.lit(".  \n\n\n\n")).alias("text"))


def noisy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``noisy_docs`` as one-block requests (trailing blanks and blank-line runs to clean)."""
    d = noisy_docs(spark, sf_dir)
    out = d.select(F.col("doc_id").alias("request_id"),
                   F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("session_id"),
                   F.col("doc_id").alias("at_ms"), F.lit("openai").alias("provider"),
                   F.lit("model_0").alias("model"), F.lit("message").alias("section"),
                   F.lit(0).cast("bigint").alias("msg_idx"), F.lit(0).cast("bigint").alias("block_idx"),
                   F.lit("user").alias("role"), F.col("text"))
    return _text_block_defaults(out)


def _ordered_join(arr_of_struct: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.sort_array(arr_of_struct), lambda x: x["text"]), sep)


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A growing 'file' per conversation: path line, a revision line, then the history so far."""
    rb = request_blocks(spark, sf_dir)
    bodies = (rb.groupBy("request_id")
                .agg(_ordered_join(F.collect_list(F.struct("msg_idx", "text")), "\n").alias("body")))
    r = requests(spark, sf_dir)
    path = F.concat(F.lit("src/conv_"), F.substring(F.col("session_id"), 2, 1 << 30), F.lit(".txt"))
    return (r.join(bodies, "request_id")
             .select("session_id", "at_ms", "request_id", path.alias("path"),
                     F.concat(path, F.lit("\n"), F.lit("rev "), (F.col("request_id") % TURNS).cast("string"),
                              F.lit("\n"), F.col("body")).alias("text")))


def resent_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that re-send every version of their file so far, one block a version."""
    fv = file_versions(spark, sf_dir)
    now = fv.select("session_id", "request_id", "at_ms")
    then = fv.select("session_id", F.col("at_ms").alias("sent_ms"), "text")
    return (now.join(then, "session_id").where("sent_ms <= at_ms")
               .select("session_id", "request_id", "at_ms", F.lit(0).cast("bigint").alias("msg_idx"), F.col("sent_ms").alias("block_idx"), "text"))


def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file_versions`` as requests of one message each, for the filediff stage."""
    fv = file_versions(spark, sf_dir)
    r = requests(spark, sf_dir).select("request_id", "provider", "model")
    out = (fv.join(r, "request_id")
             .select("request_id", "session_id", "at_ms", "provider", "model",
                     F.lit("message").alias("section"), F.lit(0).cast("bigint").alias("msg_idx"),
                     F.lit(0).cast("bigint").alias("block_idx"), F.lit("user").alias("role"), "text"))
    return _text_block_defaults(out)


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric row per event: the request_metrics fact table."""
    e = read_table(spark, sf_dir, "events")
    saved = F.col("event_id") % 97 - 5
    before = F.col("event_id") % 900 + 100
    return e.select(F.col("event_id").alias("id"), (F.col("event_id") * 1000).alias("at_ms"),
                    F.when(F.col("user_id") % 2 == 0, "anthropic").otherwise("openai").alias("provider"),
                    F.col("event_type").alias("model"),
                    F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
                    before.alias("tokens_before"), (before - saved).alias("tokens_after"),
                    saved.alias("saved"), F.col("value").alias("duration_ms"))


# ---------------------------------------------------------------------------
# Small dimension tables (literal rows). Each is joined to data derived from the
# input tables; none is a query input on its own.
# ---------------------------------------------------------------------------

# The reference's rough input price per 1M tokens (USD).
REFERENCE_PRICES = [
    ("claude-opus-4-8", 15.0),
    ("claude-sonnet-4-6", 3.0),
    ("claude-haiku-4-5", 1.0),
    ("gpt-4o", 2.5),
    ("gpt-4o-mini", 0.15),
    ("o3", 10.0),
    ("generic", 3.0),
]
# Fixture prices for the derived models; model_3 is missing on purpose (generic fallback).
FIXTURE_PRICES = [("model_0", 15.0), ("model_1", 3.0), ("model_2", 0.15)]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCE_PRICES + FIXTURE_PRICES, "model string, usd_per_mtok double")


# Stage configuration log: [valid_from_ms, valid_to_ms) with the toggles in force.
CONFIG_LOG = [
    # from, to, cache, dedup, strip, filediff, slice, intent, min_savings, store
    (0, 20_000_000, True, False, True, False, False, False, 32, True),
    (20_000_000, 50_000_000, True, True, True, False, False, False, 32, True),
    (50_000_000, 80_000_000, False, True, False, False, False, False, 500, False),
    (80_000_000, 1 << 62, True, True, True, False, True, True, 0, True),
]


def config_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        CONFIG_LOG,
        "valid_from_ms long, valid_to_ms long, cache boolean, dedup boolean, strip boolean, "
        "filediff boolean, slice boolean, intent boolean, min_savings long, store boolean")


def header_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request headers derived from the requests: a session header on most, auth headers on all."""
    r = requests(spark, sf_dir)
    hdr = F.map_from_arrays(
        F.array(F.lit("Authorization"), F.lit("X-Api-Key"), F.lit("User-Agent"), F.lit("x-session-id")),
        F.array(F.concat(F.lit("Bearer sk-"), F.col("request_id").cast("string")),
                F.concat(F.lit("key-"), F.col("conv_id").cast("string")),
                F.lit("agent/1.0"), F.col("session_id")))
    no_session = F.map_from_arrays(
        F.array(F.lit("authorization"), F.lit("Anthropic-Api-Key"), F.lit("accept")),
        F.array(F.concat(F.lit("Bearer sk-"), F.col("request_id").cast("string")),
                F.lit("ak"), F.lit("application/json")))
    return r.select("request_id", F.when(F.col("conv_id") % 5 == 0, no_session).otherwise(hdr).alias("headers"))


def context_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One context put per document line (repeated lines are repeated puts)."""
    d = read_table(spark, sf_dir, "documents")
    ex = d.select("doc_id", "source", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("pos", "ln"))
    return (ex.where(F.col("ln") != "")
              .select(F.col("ln").alias("content"),
                      F.when(F.col("pos") % 3 == 0, F.col("source")).otherwise(F.lit("")).alias("label"),
                      (F.col("doc_id") * LINES + F.col("pos")).alias("at_ms"),
                      F.concat(F.lit("d"), (F.col("doc_id") % 20).cast("string")).alias("session_id")))


def _jstr(s: Column) -> Column:
    j = F.to_json(F.array(s))
    return j.substr(F.lit(2), F.length(j) - 2)


def request_json(spark: SparkSession, sf_dir: str, broken: bool = True) -> DataFrame:
    """Wire bodies built from ``request_blocks`` (one per request) plus invalid bodies.

    Anthropic: system as a string, or (conv_id % 3 = 0) as an array whose block is
    already cache-marked; user content as a string, assistant content as a block
    array; ``max_tokens`` and ``stream``. OpenAI: everything inline, string content,
    ``max_completion_tokens`` (conv_id % 3 = 1) instead of ``max_tokens``, and a
    numeric string temperature (conv_id % 5 = 0) that must not parse as a number.
    Invalid bodies are the raw HTML of ``pages`` (request ids from 10^9).
    """
    rb = request_blocks(spark, sf_dir)
    r = requests(spark, sf_dir).select("request_id", "conv_id")
    b = rb.join(r, "request_id")
    anth = F.col("provider") == "anthropic"
    text_obj = F.concat(F.lit('{"type":"text","text":'), _jstr(F.col("text")), F.lit("}"))
    content = F.when(anth & (F.col("role") == "assistant"), F.concat(F.lit("["), text_obj, F.lit("]"))) \
               .otherwise(_jstr(F.col("text")))
    msg = F.concat(F.lit('{"role":'), _jstr(F.col("role")), F.lit(',"content":'), content, F.lit("}"))
    sys_obj = F.concat(F.lit('[{"type":"text","text":'), _jstr(F.col("text")),
                       F.lit(',"cache_control":{"type":"ephemeral"}}]'))
    sysj = F.when(F.col("conv_id") % 3 == 0, sys_obj).otherwise(_jstr(F.col("text")))
    per = (b.groupBy("request_id")
             .agg(F.first("provider").alias("provider"), F.first("model").alias("model"),
                  F.first("conv_id").alias("conv_id"), F.first("session_id").alias("session_id"),
                  F.first("at_ms").alias("at_ms"),
                  F.sort_array(F.collect_list(F.when(F.col("section") == "message",
                                                     F.struct("msg_idx", msg.alias("j"))))).alias("ms"),
                  F.first(F.when(F.col("section") == "system", sysj), ignorenulls=True).alias("sys")))
    msgs = F.concat(F.lit("["), F.array_join(F.transform("ms", lambda x: x["j"]), ","), F.lit("]"))
    conv = F.col("conv_id")
    anth_body = F.concat(F.lit('{"model":'), _jstr(F.col("model")),
                         F.lit(',"max_tokens":'), (F.lit(1024) + conv % 7).cast("string"),
                         F.when(F.col("sys").isNotNull(), F.concat(F.lit(',"system":'), F.col("sys")))
                          .otherwise(F.lit("")),
                         F.lit(',"stream":'), F.when(conv % 4 == 0, F.lit("true")).otherwise(F.lit("false")),
                         F.lit(',"messages":'), msgs, F.lit("}"))
    oai_body = F.concat(F.lit('{"model":'), _jstr(F.col("model")), F.lit(',"messages":'), msgs,
                        F.when(conv % 3 == 1, F.concat(F.lit(',"max_completion_tokens":'), (F.lit(512) + conv % 5).cast("string")))
                         .otherwise(F.concat(F.lit(',"max_tokens":'), (F.lit(256) + conv % 5).cast("string"))),
                        F.when(conv % 5 == 0, F.lit(',"temperature":"0.7"')).otherwise(F.lit(',"temperature":0.5')),
                        F.lit(',"stop":["\\n\\n"]}'))
    out = per.select("request_id", "session_id", "at_ms", "provider",
                     F.when(F.col("provider") == "anthropic", anth_body).otherwise(oai_body).alias("body"))
    if broken:
        pages = read_table(spark, sf_dir, "pages").select(
            (F.col("page_id") + F.lit(1_000_000_000)).alias("request_id"),
            F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("session_id"),
            F.col("page_id").alias("at_ms"),
            F.when(F.col("page_id") % 2 == 0, "anthropic").otherwise("openai").alias("provider"),
            F.col("html").alias("body"))
        out = out.unionByName(pages)
    return out


def tool_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anthropic bodies with every block kind, derived from the conversations.

    Each assistant turn is [text, tool_use(name 'search', input {"n": turn})]; each
    later user turn is [tool_result(tool_use_id, content [text, tool_result [text "deep"]]), raw image block].
    One request per conversation (the whole conversation), two tool definitions.
    """
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") != "system")
    tid = F.concat(F.lit("tu_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    prev_tid = F.concat(F.lit("tu_"), F.col("conv_id").cast("string"), F.lit("_"), (F.col("turn") - 1).cast("string"))
    asst = F.concat(F.lit('[{"type":"text","text":'), _jstr(F.col("text")),
                    F.lit('},{"type":"tool_use","id":'), _jstr(tid),
                    F.lit(',"name":"search","input":{"n":'), F.col("turn").cast("string"), F.lit("}}]"))
    user = F.concat(F.lit('[{"type":"tool_result","tool_use_id":'), _jstr(prev_tid),
                    F.lit(',"content":[{"type":"text","text":'), _jstr(F.col("text")),
                    F.lit('},{"type":"tool_result","tool_use_id":"in","content":[{"type":"text","text":"deep"}]}]},{"type":"image","n":'),
                    F.col("turn").cast("string"), F.lit("}]"))
    content = F.when(F.col("role") == "assistant", asst).when(F.col("turn") == 0, _jstr(F.col("text"))).otherwise(user)
    msg = F.concat(F.lit('{"role":'), _jstr(F.col("role")), F.lit(',"content":'), content, F.lit("}"))
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", msg.alias("j")))).alias("ms"))
    tools = ('[{"name":"search","description":"Find text","input_schema":{"type":"object"}},'
             '{"name":"noop","input_schema":{}}]')
    body = F.concat(F.lit('{"model":"model_t","max_tokens":64,"tools":'), F.lit(tools), F.lit(',"messages":['),
                    F.array_join(F.transform("ms", lambda x: x["j"]), ","), F.lit("]}"))
    return per.select((F.col("conv_id") + F.lit(2_000_000_000)).alias("request_id"),
                      F.concat(F.lit("t"), F.col("conv_id").cast("string")).alias("session_id"),
                      F.col("conv_id").alias("at_ms"), F.lit("anthropic").alias("provider"), body.alias("body"))


def edge_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of every user turn that mostly hold no block, by conv_id % 5: an empty message list; an empty
    content; an empty block list before the turn's text; no messages at all; the text after a duplicate model key."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    r = requests(spark, sf_dir).join(c, ["conv_id", "turn"])
    model = F.concat(F.lit('"model":'), _jstr(F.col("model")))
    text, kind = _jstr(F.col("text")), F.col("conv_id") % 5
    body = (F.when(kind == 0, F.concat(F.lit("{"), model, F.lit(',"messages":[]}')))
             .when(kind == 1, F.concat(F.lit("{"), model, F.lit(',"messages":[{"role":"user","content":""}]}')))
             .when(kind == 2, F.concat(F.lit("{"), model, F.lit(',"messages":[{"role":"user","content":[]},{"role":"assistant","content":'), text, F.lit("}]}")))
             .when(kind == 3, F.concat(F.lit("{"), model, F.lit("}")))
             .otherwise(F.concat(F.lit('{"model":"first",'), model, F.lit(',"messages":[{"role":"user","content":'), text, F.lit("}]}"))))
    return r.select("request_id", "session_id", "at_ms", "provider", body.alias("body"))


def lossy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anthropic bodies of every user turn, by conv_id % 6: an image among the system blocks; an extra key on a text
    block; a cache marker on a tool result; a cache marker of another kind on a system block; tools that are no list;
    nothing that a round trip loses."""
    c = read_table(spark, sf_dir, "conversations").where(F.col("role") == "user").select("conv_id", "turn", "text")
    r = requests(spark, sf_dir).join(c, ["conv_id", "turn"])
    text, kind = _jstr(F.col("text")), F.col("conv_id") % 6
    plain = F.concat(F.lit('"messages":[{"role":"user","content":'), text, F.lit("}]}"))
    body = (F.when(kind == 0, F.concat(F.lit('{"system":[{"type":"text","text":"S"},{"type":"image"},{"type":"image"}],'), plain))
             .when(kind == 1, F.concat(F.lit('{"messages":[{"role":"user","content":[{"type":"text","citations":[],"text":'), text, F.lit("}]}]}")))
             .when(kind == 2, F.concat(F.lit('{"messages":[{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","cache_control":{"type":"ephemeral"},"content":'), text, F.lit("}]}]}")))
             .when(kind == 3, F.concat(F.lit('{"system":[{"type":"text","text":"S","cache_control":{"type":"ephemeral","ttl":"1h"}}],'), plain))
             .when(kind == 4, F.concat(F.lit('{"tools":{"a":1},'), plain))
             .otherwise(F.concat(F.lit('{"system":"S","tools":[{"name":"n","input_schema":{}}],'), plain)))
    return r.select("request_id", "session_id", "at_ms", F.lit("anthropic").alias("provider"), body.alias("body"))


def file_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation whose only change between requests is its revision line.

    text = path, ``rev <turn>``, then the whole conversation (every turn), so each
    re-send differs from the previous version in one line: the case where a diff
    is far smaller than the file.
    """
    c = read_table(spark, sf_dir, "conversations")
    body = (c.groupBy("conv_id")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))),
                                           lambda x: x["text"]), "\n").alias("body")))
    r = requests(spark, sf_dir)
    path = F.concat(F.lit("src/conv_"), F.col("conv_id").cast("string"), F.lit(".txt"))
    return (r.join(body, "conv_id")
             .select("request_id", "session_id", "at_ms", "provider", "model", path.alias("path"),
                     F.concat(path, F.lit("\nrev "), F.col("turn").cast("string"), F.lit("\n"), F.col("body"))
                     .alias("text")))


def file_revision_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = file_revisions(spark, sf_dir).select(
        "request_id", "session_id", "at_ms", "provider", "model", F.lit("message").alias("section"),
        F.lit(0).cast("bigint").alias("msg_idx"), F.lit(0).cast("bigint").alias("block_idx"),
        F.lit("user").alias("role"), "text")
    return _text_block_defaults(out)


def all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole derived request log: conversation requests plus the document-derived
    repeat-heavy, noisy, system and line requests (request ids are unique per session)."""
    parts = [request_blocks, dup_blocks, noisy_blocks, system_blocks, line_blocks]
    out = parts[0](spark, sf_dir)
    for f in parts[1:]:
        out = out.unionByName(f(spark, sf_dir))
    return out
