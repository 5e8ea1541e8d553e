"""Request bodies (two provider wire formats) <-> the canonical block table.

Bodies are read and parsed once into ``VARIANT`` with ``try_parse_json`` (NULL ->
quarantine, I6). Messages, system and tools become one array of items, exploded once,
and each item's content is exploded into blocks; the element kind is read from
``schema_of_variant``. The reader is tolerant like the reference: missing or wrongly
typed fields become defaults, never errors. Of duplicate keys the last one counts.

JSON text of opaque payloads (tool input, raw blocks, tool schemas) is
``to_json(variant)``: compact like ``JSON.stringify`` with keys sorted; the length,
and so the token count, is the same except for number spellings such as ``1e3``.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from slimwire.functions import text as tx
from slimwire.sources.tables import BLOCK_COLUMNS

# Request header carrying the session id; callers whose clients send another name pass it
# to ``session_key`` / ``normalize`` (header names compare case-insensitively).
SESSION_HEADER = "x-session-id"
BLOCK_ARRAY = ("array<struct<type:string,text:string,tool_id:string,tool_name:string,payload:string,"
               "is_error:boolean,cache_control:boolean>>")


# --------------------------------------------------------------------------- variant helpers
def vtype(v: Column) -> Column:
    """Kind of a variant value: STRING, NUMBER, BOOLEAN, OBJECT, ARRAY, NULL."""
    s = F.schema_of_variant(v)
    return (F.when(v.isNull(), F.lit("NULL"))
             .when(s == "VOID", F.lit("NULL"))
             .when(s.startswith("OBJECT"), F.lit("OBJECT"))
             .when(s.startswith("ARRAY"), F.lit("ARRAY"))
             .when(s == "STRING", F.lit("STRING"))
             .when(s == "BOOLEAN", F.lit("BOOLEAN"))
             .otherwise(F.lit("NUMBER")))


def field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def is_true(v: Column) -> Column:
    """``v === true``: the JSON boolean true only (the string "true" does not count)."""
    return (F.schema_of_variant(v) == "BOOLEAN") & F.try_variant_get(v, "$", "boolean")


def json_text(v: Column) -> Column:
    """``JSON.stringify(v ?? null)``."""
    return F.when(v.isNull(), F.lit("null")).otherwise(F.to_json(v))


def as_array(v: Column) -> Column:
    """Array of variants when ``v`` is a JSON array, else NULL."""
    return F.when(vtype(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>"))


def number(v: Column, target: str) -> Column:
    """A number or nothing (a numeric string stays NULL)."""
    return F.when(vtype(v) == "NUMBER", F.try_variant_get(v, "$", target))


# --------------------------------------------------------------------------- normalize
def parse_bodies(log: DataFrame) -> DataFrame:
    """Adds ``v`` (VARIANT, NULL for what can't be parsed). Input: request_id, body, ...

    Turns on ``spark.sql.variant.allowDuplicateKeys`` in the session, as JSON readers elsewhere
    keep the last of duplicate keys."""
    log.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return log.withColumn("v", F.try_parse_json(F.col("body")))


@F.pandas_udf(StringType())
def _why_rejected(bodies: pd.Series) -> pd.Series:
    def why(body: str | None) -> str:
        try:
            json.loads(body or "")
        except RecursionError:
            return "unsupported"
        except ValueError:
            return "malformed"
        return "unsupported"
    return bodies.map(why)


def quarantine(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) — rejected bodies produce no metric or history.

    ``reason`` of a rejected row: ``malformed`` (not JSON), or ``unsupported`` for JSON beyond what a VARIANT
    holds (a string over some 20 million characters, about a thousand nested levels), so that neither is
    taken for the other. The reason is found in Python, for rejected rows alone."""
    parsed = parse_bodies(log)
    bad = parsed.where(F.col("v").isNull()).drop("v")
    return parsed.where(F.col("v").isNotNull()), bad.withColumn("reason", _why_rejected(F.col("body")))


def session_key(headers: Column, header: str = SESSION_HEADER) -> Column:
    """Session id from the (case-insensitive) session header, else ``default``."""
    name = header.lower()
    hit = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(tx.DEFAULT_SESSION))


def redact_headers(headers: Column) -> Column:
    """I8: mask the values of sensitive headers (names compared case-insensitively)."""
    sens = F.array(*[F.lit(h) for h in tx.SENSITIVE_HEADERS])
    return F.transform_values(headers, lambda k, v: F.when(F.array_contains(sens, F.lower(k)),
                                                            F.lit(tx.REDACTED)).otherwise(v))


def sampling_params(v: Column, provider: Column) -> Column:
    """max_tokens (openai falls back to max_completion_tokens), temperature, top_p, stop."""
    mt = number(field(v, "max_tokens"), "bigint")
    mct = number(field(v, "max_completion_tokens"), "bigint")
    stop_key = F.when(provider == "anthropic", field(v, "stop_sequences")).otherwise(field(v, "stop"))
    stop = F.when(vtype(stop_key) == "ARRAY", F.try_variant_get(stop_key, "$", "array<string>"))
    return F.struct(F.when(provider == "openai", F.coalesce(mt, mct)).otherwise(mt).alias("max_tokens"),
                    number(field(v, "temperature"), "double").alias("temperature"),
                    number(field(v, "top_p"), "double").alias("top_p"),
                    stop.alias("stop"))


def _kind(schema: Column) -> Column:
    """Kind from a ``schema_of_variant`` string."""
    return (F.when(schema.isNull() | (schema == "VOID"), F.lit("NULL"))
             .when(schema.startswith("OBJECT"), F.lit("OBJECT"))
             .when(schema.startswith("ARRAY"), F.lit("ARRAY"))
             .when(schema == "STRING", F.lit("STRING"))
             .when(schema == "BOOLEAN", F.lit("BOOLEAN"))
             .otherwise(F.lit("NUMBER")))


def _with_variant(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Materialize a variant field and its kind once per row (keeps expressions small)."""
    df = df.withColumn(name, expr)
    return df.withColumn(name + "_k", _kind(F.schema_of_variant(F.col(name))))


def _jstr_of(name: str, default: str = "") -> Column:
    """``String(x ?? default)`` of a materialized variant column."""
    v, k = F.col(name), F.col(name + "_k")
    return (F.when(k == "NULL", F.lit(default)).when(k == "STRING", F.try_variant_get(v, "$", "string"))
             .when(k == "OBJECT", F.lit("[object Object]")).otherwise(F.to_json(v)))


def _json_of(name: str) -> Column:
    """``JSON.stringify(x ?? null)`` of a materialized variant column."""
    return F.when(F.col(name + "_k") == "NULL", F.lit("null")).otherwise(F.to_json(F.col(name)))


def _piece(b: Column) -> Column:
    """blockText of a block within a tool_result that holds no blocks: its text, name and input, its string content, or its JSON."""
    t = F.try_variant_get(b, "$.type", "string")
    return (F.when(t == "text", F.coalesce(F.try_variant_get(b, "$.text", "string"), F.lit("")))
             .when(t == "tool_use", F.concat(F.coalesce(F.try_variant_get(b, "$.name", "string"), F.lit("")), json_text(field(b, "input"))))
             .when(t == "tool_result", F.when(vtype(field(b, "content")) == "STRING", F.try_variant_get(field(b, "content"), "$", "string")).otherwise(F.lit("")))
             .otherwise(json_text(b)))


def _is_result(b: Column) -> Column:
    return F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False))


WAITING = "struct<waiting:array<variant>,pieces:array<string>>"


def _render_inner(blocks: Column) -> Column:
    """The text of a tool_result's blocks, of any depth, in order.

    Results within results are unfolded one block at a time: a result's own blocks take its place at the head of those
    that wait, any other block gives its piece. There are no more steps than braces in the JSON. Without such
    results, which the wire formats don't know, the pieces are joined as they are."""
    none = F.array().cast("array<variant>")

    def step(state: Column, _: Column) -> Column:
        head, rest = F.element_at(state["waiting"], 1), F.slice(state["waiting"], F.lit(2), F.greatest(F.size(state["waiting"]) - 1, F.lit(0)))
        own = F.when(_is_result(head), as_array(field(head, "content")))
        out = F.when(own.isNotNull(), F.struct(F.concat(own, rest).alias("waiting"), state["pieces"].alias("pieces"))) \
               .otherwise(F.struct(rest.alias("waiting"), F.concat(state["pieces"], F.array(_piece(head))).alias("pieces")))
        return F.when(F.size(state["waiting"]) == 0, state).otherwise(out).cast(WAITING)

    blocks = F.coalesce(blocks, none)
    steps = F.transform(blocks, lambda b: F.regexp_count(F.to_json(b), F.lit(r"\{")) + 1)
    total = F.aggregate(steps, F.lit(0), lambda a, x: a + x) + F.size(blocks)
    start = F.struct(blocks.alias("waiting"), F.array().cast("array<string>").alias("pieces")).cast(WAITING)
    # a string among the blocks has no brace; each block gives a step of its own beside its braces
    unfolded = F.aggregate(F.sequence(F.lit(1), F.greatest(total + _strings(blocks), F.lit(1))), start, step)["pieces"]
    return F.array_join(F.when(F.exists(blocks, _is_result), unfolded).otherwise(F.transform(blocks, _piece)), "")


def _strings(blocks: Column) -> Column:
    """No fewer than the values that aren't objects in the blocks' arrays: a comma stands between any two of them."""
    return F.aggregate(F.transform(blocks, lambda b: F.regexp_count(F.to_json(b), F.lit(r"[,\[]"))), F.lit(0), lambda a, x: a + x)


ITEM = "array<struct<section:string,idx:bigint,v:variant>>"


def _items(v: Column, provider: Column) -> Column:
    """Messages, system (anthropic) and tools of a body as one array of (section, idx, variant), after an
    item that stands for the request itself."""
    none = F.array().cast(ITEM)

    def listed(name: str, section: str) -> Column:
        arr = F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(arr, lambda x, i: F.struct(F.lit(section).alias("section"), i.cast("bigint").alias("idx"),
                                                      x.alias("v"))).cast(ITEM)
    own = F.array(F.struct(F.lit("request").alias("section"), F.lit(0).cast("bigint").alias("idx"),
                           F.lit(None).cast("variant").alias("v"))).cast(ITEM)
    system = F.when(provider == "anthropic", F.array(F.struct(
        F.lit("system").alias("section"), F.lit(0).cast("bigint").alias("idx"), field(v, "system").alias("v"))).cast(ITEM)).otherwise(none)
    return F.concat(own, system, listed("messages", "message"), listed("tools", "tool"))


def normalize(log: DataFrame, provider: str | Column | None = None,
              session_header: str = SESSION_HEADER, keep_empty: bool = False, with_raw: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parse a request log into (requests, blocks).

    ``log`` has request_id, body and optionally session_id, at_ms, provider, headers.
    The provider comes from the argument or the ``provider`` column. Invalid JSON
    rows are dropped here (see :func:`quarantine`). Blocks carry (msg_idx, block_idx)
    as the order key; system blocks have section ``system`` and msg_idx 0.

    ``keep_empty`` adds rows of type ``none`` (block_idx -1): one for each request (section
    ``request``, msg_idx -1) and one for each message without blocks, so that requests and
    messages without blocks are seen downstream. The log is read, parsed and exploded once.
    ``with_raw``: the request's row has its body as ``raw``, so that blocks alone go back to bodies.
    """
    df = parse_bodies(log).where(F.col("v").isNotNull())
    if provider is not None:
        df = df.withColumn("provider", F.lit(provider) if isinstance(provider, str) else provider)
    if "session_id" not in df.columns:
        df = df.withColumn("session_id", session_key(F.col("headers"), session_header) if "headers" in df.columns
                           else F.lit(tx.DEFAULT_SESSION))
    if "at_ms" not in df.columns:
        df = df.withColumn("at_ms", F.lit(None).cast("bigint"))
    df = _with_variant(df, "_model", field(F.col("v"), "model"))
    df = df.withColumn("model", _jstr_of("_model"))
    v = F.col("v")
    requests = df.select("request_id", "session_id", "at_ms", "provider", "model",
                         F.coalesce(is_true(field(v, "stream")), F.lit(False)).alias("stream"),
                         sampling_params(v, F.col("provider")).alias("params"), F.col("body").alias("raw"))
    keys = ["request_id", "session_id", "at_ms", "provider", "model"]
    anth = F.col("provider") == "anthropic"

    own = [F.when(F.col("it.section") == "request", F.col("body")).alias("raw")] if with_raw else []
    also = ["raw"] if with_raw else []
    items = df.select(*keys, *(["body"] if with_raw else []), F.explode(_items(v, F.col("provider"))).alias("it")) \
              .select(*keys, *own, F.col("it.section").alias("section"), F.col("it.idx").alias("idx"), F.col("it.v").alias("iv"))
    items = _with_variant(items, "_role", field(F.col("iv"), "role"))
    # the content: a message's, a system value itself, a tool definition as one block
    is_msg, is_tool = F.col("section") == "message", F.col("section") == "tool"
    items = _with_variant(items, "_c", F.when(is_msg, field(F.col("iv"), "content")).otherwise(F.col("iv")))
    arr = (F.when(is_tool, F.array(F.col("iv")))
            .when((F.col("_c_k") == "STRING") & (F.length(F.try_variant_get("_c", "$", "string")) > 0), F.array(F.col("_c")))
            .when(F.col("_c_k") == "ARRAY", F.try_variant_get("_c", "$", "array<variant>")))
    ex = items.select(*keys, *also, "section", "idx", F.when(is_msg, _jstr_of("_role", "user")).when(F.col("section") == "system", F.lit("system")).alias("role"),
                      ((F.col("_c_k") == "STRING") & ~is_tool).alias("_from_str"), F.posexplode_outer(arr).alias("pos", "b"))
    ex = _with_variant(ex, "_b", F.col("b"))
    ex = ex.withColumn("_bt", F.when(F.col("_b_k") == "OBJECT", F.try_variant_get("_b", "$.type", "string")))
    ex = _with_variant(ex, "_tx", field(F.col("_b"), "text"))
    ex = _with_variant(ex, "_in", field(F.col("_b"), "content"))
    ex = ex.withColumn("_fn", F.when(is_tool, F.when(anth, F.col("_b")).otherwise(field(F.col("_b"), "function"))))
    ex = _with_variant(ex, "_desc", field(F.col("_fn"), "description"))
    ex = _with_variant(ex, "_name", field(F.col("_fn"), "name"))
    ex = ex.withColumn("type", F.when(F.col("pos").isNull(), F.lit("none")).when(is_tool, F.lit("tool"))
                       .when(F.col("_from_str"), F.lit("text")).when(F.col("_bt") == "text", F.lit("text"))
                       .when(anth & F.col("_bt").isin("tool_use", "tool_result"), F.col("_bt")).otherwise(F.lit("raw")))
    t = F.col("type")
    falsy = (F.col("_desc_k") == "NULL") | (_jstr_of("_desc") == "") | (F.to_json(F.col("_desc")).isin("false", "0"))
    text = (F.when(is_tool, F.when(falsy, F.lit(None).cast("string")).otherwise(_jstr_of("_desc")))
             .when(t == "none", F.lit(None).cast("string"))
             .when(F.col("_from_str"), F.try_variant_get("_b", "$", "string"))
             .when(t == "text", _jstr_of("_tx"))
             .when(t == "tool_result",
                   F.when(F.col("_in_k") == "STRING", F.try_variant_get("_in", "$", "string"))
                    .when(F.col("_in_k") == "ARRAY", _render_inner(F.try_variant_get("_in", "$", "array<variant>")))
                    .otherwise(F.lit(""))))
    cache = anth & ~F.col("_from_str") & (t == "text") & (
        _kind(F.schema_of_variant(field(F.col("_b"), "cache_control"))) == "OBJECT")
    tool_id = (F.when(t == "tool_use", F.coalesce(F.try_variant_get("_b", "$.id", "string"), F.lit("")))
                .when(t == "tool_result", F.coalesce(F.try_variant_get("_b", "$.tool_use_id", "string"), F.lit(""))))
    tool_name = (F.when(t == "tool", _jstr_of("_name"))
                  .when(t == "tool_use", F.coalesce(F.try_variant_get("_b", "$.name", "string"), F.lit(""))))
    schema = F.when(anth, field(F.col("_b"), "input_schema")).otherwise(F.col("_fn"))
    payload = (F.when(t == "tool", F.coalesce(F.to_json(schema), F.lit("{}")))
                .when(t == "tool_use", json_text(field(F.col("_b"), "input")))
                .when(t == "tool_result", F.when(F.col("_in_k") != "NULL", F.to_json(F.col("_in"))))
                .when(t == "raw", _json_of("_b")))
    is_error = F.when(t == "tool_result", F.coalesce(is_true(field(F.col("_b"), "is_error")), F.lit(False)))
    blocks = ex.select(
        *keys, "section", F.when(is_msg, F.col("idx")).when(F.col("section") == "request", F.lit(-1)).otherwise(F.lit(0)).cast("bigint").alias("msg_idx"),
        F.when(t == "none", F.lit(-1)).when(is_tool, F.col("idx")).otherwise(F.col("pos")).cast("bigint").alias("block_idx"),
        "role", "type", text.alias("text"), tool_id.alias("tool_id"), tool_name.alias("tool_name"), payload.alias("payload"),
        is_error.alias("is_error"), F.coalesce(cache, F.lit(False)).alias("cache_control"), *also)
    blocks = blocks.withColumn("rendered", F.when(t == "tool", F.concat("tool_name", F.coalesce("text", F.lit("")), "payload")))
    kept = (t != "none") | (F.col("section").isin("request", "message") if keep_empty else F.lit(False))
    # a system value's blocks are its text blocks
    kept = kept & ((F.col("section") != "system") | (t == "text"))
    return requests, blocks.where(kept).select(*BLOCK_COLUMNS, *also)


# --------------------------------------------------------------------------- denormalize
def _jstr(s: Column) -> Column:
    """JSON string literal of a string column."""
    j = F.to_json(F.array(s))
    return j.substr(F.lit(2), F.length(j) - 2)


def _block_json(anthropic: bool) -> Column:
    t = F.col("type")
    if not anthropic:
        return F.when(t == "text", F.concat(F.lit('{"type":"text","text":'), _jstr(F.col("text")), F.lit("}"))) \
                .when(t == "tool", F.concat(F.lit('{"type":"function","function":'), F.col("payload"), F.lit("}"))) \
                .otherwise(F.col("payload"))
    mark = F.when(F.col("marked"), F.lit(',"cache_control":{"type":"ephemeral"}')).otherwise(F.lit(""))
    text_json = F.concat(F.lit('{"type":"text","text":'), _jstr(F.col("text")), mark, F.lit("}"))
    tool_use = F.concat(F.lit('{"type":"tool_use","id":'), _jstr(F.col("tool_id")), F.lit(',"name":'),
                        _jstr(F.col("tool_name")), F.lit(',"input":'), F.col("payload"), F.lit("}"))
    # a result that a stage rewrote is sent as its text
    content = F.when(F.col("edited") | F.col("payload").isNull(), _jstr(F.coalesce("text", F.lit("")))).otherwise(F.col("payload"))
    tool_result = F.concat(F.lit('{"type":"tool_result","tool_use_id":'), _jstr(F.col("tool_id")), F.lit(',"content":'), content,
                           F.when(F.col("is_error"), F.lit(',"is_error":true')).otherwise(F.lit("")), F.lit("}"))
    tool = F.concat(F.lit('{"name":'), _jstr(F.col("tool_name")),
                    F.when(F.coalesce(F.col("text"), F.lit("")) != "", F.concat(F.lit(',"description":'), _jstr(F.col("text")))).otherwise(F.lit("")),
                    F.lit(',"input_schema":'), F.col("payload"), F.lit("}"))
    return (F.when(t == "text", text_json).when(t == "tool_use", tool_use)
             .when(t == "tool_result", tool_result).when(t == "tool", tool).otherwise(F.col("payload")))


def denormalize(requests: DataFrame | None, blocks: DataFrame) -> DataFrame:
    """Blocks back to a wire body per request, overlaid on the original body.

    One exchange: block rows and request rows are unioned and grouped once by
    (session_id, request_id) (a request's blocks are bounded by its size), then the body
    is assembled row-locally with higher-order functions. Without ``requests`` the blocks'
    own request rows have the body (``normalize(..., keep_empty=True, with_raw=True)``), and blocks
    that are already dealt by request, as a reduction leaves them, aren't dealt again.

    Reads the state a reduction leaves, where it is there: ``drop`` (left out), ``cache`` (the
    marker in force, else ``cache_control``), ``edited`` (a tool result or tool definition whose
    text a stage rewrote), ``changed`` (a request that no stage changed keeps its raw body, byte for byte).

    Anthropic: system is absent, a string (one unmarked block) or an array; a message left
    without blocks is sent with ``content: []``. OpenAI: message *i* keeps the extra fields of raw
    message *i*, string content is restored when the original was a string and all blocks are
    text, and an empty block list keeps the original content. Tool definitions that no stage
    touched stay as they were; if all are dropped, the original ones stay. Output: session_id,
    request_id, body (JSON text).
    """
    return _with_bodies(requests, blocks).select("session_id", "request_id", "body")


def _with_bodies(requests: DataFrame | None, blocks: DataFrame) -> DataFrame:
    """Per request its raw body, provider and the body made of its blocks."""
    b = blocks.withColumn("marked", F.coalesce(F.col("cache" if "cache" in blocks.columns else "cache_control"), F.lit(False)))
    for name, usual in (("drop", False), ("edited", False), ("changed", True)):
        if name not in b.columns:
            b = b.withColumn(name, F.lit(usual))
    is_anth = F.col("provider") == "anthropic"
    b = b.withColumn("bj", F.when(is_anth, _block_json(True)).otherwise(_block_json(False)))
    blk = F.struct(F.col("msg_idx").cast("bigint").alias("msg_idx"), F.col("block_idx").cast("bigint").alias("block_idx"),
                   "section", "role", "type", "text", "marked", "edited", "bj")
    keys = ["session_id", "request_id"]
    rows = b.select(*keys, F.when((F.col("type") != "none") & ~F.col("drop"), blk).alias("blk"), (F.col("raw") if requests is None else F.lit(None).cast("string")).alias("raw"),
                    "provider", "model", "changed")
    if requests is not None:
        rows = rows.unionByName(requests.select(*keys, F.lit(None).cast(BLK).alias("blk"), "raw", "provider", "model", F.lit(None).cast("boolean").alias("changed")))
    g = (rows.groupBy(*keys)
          .agg(F.sort_array(F.collect_list("blk")).alias("bl"), F.first("raw", ignorenulls=True).alias("raw"),
               F.first("provider", ignorenulls=True).alias("provider"),
               F.first("model", ignorenulls=True).alias("model"), F.coalesce(F.max("changed"), F.lit(True)).alias("changed"))
          .where(F.col("raw").isNotNull()))

    v = F.when(F.col("changed"), F.try_parse_json(F.col("raw")))   # an unchanged body is not read
    empty_arr = F.array().cast("array<variant>")
    listed = lambda name: F.coalesce(F.when(vtype(field(F.col("v"), name)) == "ARRAY",
                                            F.try_variant_get(F.col("v"), f"$.{name}", "array<variant>")), empty_arr)
    g = g.withColumn("v", v).withColumn("om", listed("messages")).withColumn("ot", listed("tools"))
    anth = F.col("provider") == "anthropic"
    empty_map = F.create_map().cast("map<string,variant>")

    def per_message(i):
        # evaluated once per message: its blocks and its raw object as a map
        om_i = F.element_at(F.col("om"), i + 1)
        first, after = F.array_position("_at", i), F.size("_at") - F.array_position("_back", i) + 2
        return F.struct(F.when(first > 0, F.slice("_mb", first.cast("int"), (after - first).cast("int"))).otherwise(F.slice("_mb", 1, 0)).alias("mb"),
                        F.coalesce(F.try_variant_get(om_i, "$", "map<string,variant>"), empty_map).alias("om"))

    def message(m):
        mb, om_map = m["mb"], m["om"]
        was_string = F.schema_of_variant(F.element_at(om_map, F.lit("content"))) == "STRING"
        all_text = F.forall(mb, lambda x: x["type"] == "text")
        arr_json = F.concat(F.lit("["), F.array_join(F.transform(mb, lambda x: x["bj"]), ","), F.lit("]"))
        str_json = _jstr(F.array_join(F.transform(mb, lambda x: x["text"]), ""))
        orig = F.to_json(F.element_at(om_map, F.lit("content")))
        content = (F.when(F.size(mb) > 0, F.when(~anth & was_string & all_text, str_json).otherwise(arr_json))
                    .when(anth, F.lit("[]")).otherwise(orig))
        raw_role = F.try_variant_get(F.element_at(om_map, F.lit("role")), "$", "string")
        role = F.coalesce(F.try_element_at(mb, F.lit(1))["role"], raw_role, F.lit("user"))
        kept = F.transform(F.map_entries(F.map_filter(om_map, lambda k, _v: ~k.isin("role", "content"))),
                           lambda e: F.concat(_jstr(e["key"]), F.lit(":"), F.to_json(e["value"])))
        parts = F.concat(F.array(F.concat(F.lit('"role":'), _jstr(role))), kept,
                         F.when(content.isNotNull(), F.array(F.concat(F.lit('"content":'), content)))
                          .otherwise(F.array().cast("array<string>")))
        return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))

    # a message's blocks lie side by side; found by place, as a filter over all blocks for each message is their square
    g = g.withColumn("_mb", F.filter("bl", lambda x: x["section"] == "message")).withColumn("_at", F.transform("_mb", lambda x: x["msg_idx"]))
    g = g.withColumn("_back", F.reverse("_at"))
    g = g.withColumn("_msgs", F.transform(F.sequence(F.lit(0), F.size("om") - 1), per_message))
    msgs = F.when(F.size("om") == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("["), F.array_join(F.transform("_msgs", message), ","), F.lit("]")))
    sl = F.filter("bl", lambda x: x["section"] == "system")
    single = (F.size(sl) == 1) & ~F.try_element_at(sl, F.lit(1))["marked"]
    sys_json = F.when(F.size(sl) == 0, F.lit(None).cast("string")).when(single, _jstr(F.try_element_at(sl, F.lit(1))["text"])) \
                .otherwise(F.concat(F.lit("["), F.array_join(F.transform(sl, lambda x: x["bj"]), ","), F.lit("]")))
    tl = F.filter("bl", lambda x: x["section"] == "tool")
    touched = (F.size(tl) > 0) & ((F.size(tl) < F.size("ot")) | F.exists(tl, lambda x: x["edited"]))
    tools_json = F.concat(F.lit("["), F.array_join(F.transform(tl, lambda x: F.when(
        x["edited"], x["bj"]).otherwise(F.to_json(F.element_at(F.col("ot"), x["block_idx"].cast("int") + 1)))), ","), F.lit("]"))
    top = F.coalesce(F.try_variant_get(F.col("v"), "$", "map<string,variant>"), empty_map)
    keep = F.map_filter(top, lambda k, _v: ~k.isin("model", "messages") & ~((k == "system") & anth) & ~((k == "tools") & touched))
    entries = F.transform(F.map_entries(keep), lambda e: F.concat(_jstr(e["key"]), F.lit(":"), F.to_json(e["value"])))
    new = F.array(F.concat(F.lit('"model":'), _jstr(F.col("model"))), F.concat(F.lit('"messages":'), msgs))
    no_part = F.array().cast("array<string>")
    sys_part = F.when(anth & sys_json.isNotNull(), F.array(F.concat(F.lit('"system":'), sys_json))).otherwise(no_part)
    tool_part = F.when(touched, F.array(F.concat(F.lit('"tools":'), tools_json))).otherwise(no_part)
    body = F.concat(F.lit("{"), F.array_join(F.concat(entries, new, sys_part, tool_part), ","), F.lit("}"))
    return g.select(*keys, "raw", "provider", F.when(F.col("changed"), body).otherwise(F.col("raw")).alias("body"))


def optimized_bodies(log: DataFrame, config=None, provider: str | Column | None = None, **reduction) -> DataFrame:
    """A request log to the bodies that would be sent on: (session_id, request_id, body).

    log -> normalize -> reduce -> denormalize; the raw body where no stage changed the request. Invalid JSON
    is left out. Further arguments go to ``reduce_requests``."""
    from slimwire.plans.reduce import reduce_requests
    _, blocks = normalize(log, provider, keep_empty=True, with_raw=True)
    return denormalize(None, reduce_requests(blocks, config, **reduction).blocks)


BLK = ("struct<msg_idx:bigint,block_idx:bigint,section:string,role:string,type:string,text:string,"
       "marked:boolean,edited:boolean,bj:string>")


# --------------------------------------------------------------------------- round trip
def _content_json(content: Column) -> Column:
    """Content as canonical JSON: a string is the one text block that it stands for, no or empty content no block; keys in
    order, null ones left out."""
    text = F.try_variant_get(content, "$", "string")

    def block(b: Column) -> Column:
        entries = F.try_variant_get(b, "$", "map<string,variant>")
        full = F.map_filter(entries, lambda k, v: vtype(v) != "NULL")
        return F.coalesce(_object_json(full), F.to_json(b))
    return (F.when(vtype(content) == "STRING", F.when(text == "", F.lit("[]")).otherwise(F.concat(F.lit('[{"text":'), _jstr(text), F.lit(',"type":"text"}]'))))
             .when(vtype(content) == "ARRAY", F.concat(F.lit("["), F.array_join(F.transform(as_array(content), block), ","), F.lit("]")))
             .when(vtype(content) == "NULL", F.lit("[]")).otherwise(F.to_json(content)))


def _object_json(entries: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(F.transform_values(entries, lambda k, v: F.to_json(v)))), lambda e: F.concat(_jstr(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _canonical(v: Column, provider: Column) -> Column:
    """The parts of a body, as canonical JSON texts: struct(messages, system, blocks of system, tools, others)."""
    empty = F.create_map().cast("map<string,variant>")

    def message(m: Column) -> Column:
        own = F.coalesce(F.try_variant_get(m, "$", "map<string,variant>"), empty)
        rest = F.map_filter(own, lambda k, _: ~k.isin("content", "role"))
        role = F.when(vtype(field(m, "role")) == "NULL", F.lit('"user"')).otherwise(F.to_json(field(m, "role")))
        return F.array_join(F.array(role, _content_json(field(m, "content")), _object_json(rest)), "|")
    messages = F.coalesce(as_array(field(v, "messages")), F.array().cast("array<variant>"))
    anth = provider == "anthropic"
    system = field(v, "system")
    top = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"), empty)
    others = F.map_filter(top, lambda k, _: ~(k.isin("messages", "model", "tools") | (anth & (k == "system"))))
    empty_text = F.coalesce(F.try_variant_get(system, "$", "string") == "", F.lit(False))
    return F.struct(F.array_join(F.transform(messages, message), ",").alias("messages"),
                    F.when(anth, F.when(empty_text, F.lit('""')).otherwise(_content_json(system))).alias("system"),
                    F.when(anth & (vtype(system) == "ARRAY"), F.size(as_array(system))).when(anth & (vtype(system) == "STRING"), 1).otherwise(0).alias("system_blocks"),
                    json_text(field(v, "tools")).alias("tools"), _object_json(others).alias("others"))


def roundtrip_audit(log: DataFrame) -> DataFrame:
    """Requests whose content ``denormalize(normalize(body))`` does not give back: (session_id, request_id,
    messages_differ, system_differ, tools_differ, others_differ, dropped_system_blocks).

    The bodies are really made and compared part by part as canonical JSON (keys in order, numbers as the parser reads
    them) with the source bodies, row by row; the only exchange is denormalize's own. A string content that comes
    back as a one-block array is the same content, a null key of a block is none. Tools that are no list come back as they
    were, but blocks don't hold them: they count as different. Requests are told apart by (session_id, request_id).
    """
    _, blocks = normalize(log, keep_empty=True, with_raw=True)
    made = _with_bodies(None, blocks)
    # parsed twice, as what came back has been: numbers are then spelt alike
    before = made.withColumn("_a", F.try_parse_json(F.to_json(F.try_parse_json("raw")))).withColumn("_b", F.try_parse_json("body"))
    provider = F.col("provider")
    parts = before.select("session_id", "request_id", (~vtype(field(F.col("_a"), "tools")).isin("ARRAY", "NULL")).alias("_odd"),
                          _canonical(F.col("_a"), provider).alias("_x"), _canonical(F.col("_b"), provider).alias("_y"))
    differ = {c: ~F.col(f"_x.{c}").eqNullSafe(F.col(f"_y.{c}")) for c in ("messages", "system", "tools", "others")}
    found = F.struct(differ["messages"].alias("messages_differ"), differ["system"].alias("system_differ"),
                     (differ["tools"] | F.col("_odd")).alias("tools_differ"), differ["others"].alias("others_differ"),
                     F.greatest(F.col("_x.system_blocks") - F.col("_y.system_blocks"), F.lit(0)).cast("bigint").alias("dropped_system_blocks"))
    # a generated row: a filter on plain columns is pushed to the grouping, with all parsing and both bodies in it at each use
    out = parts.select("session_id", "request_id", F.inline(F.array(found)))
    return out.where("messages_differ or system_differ or tools_differ or others_differ")
