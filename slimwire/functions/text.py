"""Column functions shared by every operator.

All but ``fnv1a32`` (an Arrow UDF) are built from native Spark expressions so they stay
inside whole-stage codegen (the higher-order ones run interpreted, still on the JVM).
They take and return ``Column`` objects and can be used in ``select``/``withColumn``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
CHARS_PER_TOKEN = 4                      # approximate tokenizer: ceil(len / 4)
MIN_DUP_CHARS = 120                      # dedup: only collapse blocks this long
OMIT_MARKER = "[↑ identical to an earlier message in this conversation — omitted to save tokens]"
MIN_FILE_CHARS = 200                     # filediff: only consider blocks this long
MIN_SAVINGS_TOKENS = 32                  # guardrail threshold for lossy stages
DEFAULT_SESSION = "default"              # session id when the header is absent
REDACTED = "***redacted***"
SENSITIVE_HEADERS = ["authorization", "x-api-key", "openai-api-key", "anthropic-api-key"]
# Models whose BPE count is exact (case-insensitive prefix test).
EXACT_MODEL_PATTERN = r"(?i)^(gpt|o\d|text-|chatgpt|davinci|babbage)"
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193
# End of fixed values.

# JavaScript's whitespace set (String.prototype.trim and regex \s): Unicode
# spaces, line terminators and the BOM. Java's \s and Spark's trim() are ASCII only.
JS_SPACE_CLASS = (r"[\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                  r"\x{202F}\x{205F}\x{3000}\x{FEFF}]")

# Java regex form of the path pattern: JS \s becomes the explicit class above,
# and end-of-input is \z (Java's $ also matches before a final line terminator).
PATH_LINE_JAVA = (
    "^" + JS_SPACE_CLASS + r"*(?:\/\/|#|--|\/\*)?" + JS_SPACE_CLASS
    + r"*([\w./@-]+\.[A-Za-z][\w]{0,8})" + JS_SPACE_CLASS + r"*\*?\/?" + JS_SPACE_CLASS + r"*\z"
)


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_len(text: Column | str) -> Column:
    """Length in UTF-16 code units (what JavaScript's ``length`` counts)."""
    return (F.octet_length(F.encode(col_(text), "UTF-16BE")) / 2).cast("bigint")


def approx_tokens_from_len(n: Column) -> Column:
    """ceil(n / 4) with 0 for empty text."""
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(
        F.ceil(n / F.lit(float(CHARS_PER_TOKEN))).cast("bigint"))


def approx_tokens(text: Column | str) -> Column:
    """Approximate token count of a string; NULL counts as empty."""
    return approx_tokens_from_len(F.coalesce(utf16_len(text), F.lit(0).cast("bigint")))


def js_round(x: Column | str, digits: int = 1) -> Column:
    """``Math.round(x * 10^d) / 10^d``: ties go toward +infinity."""
    scale = float(10 ** digits)
    return (F.floor(col_(x) * scale + F.lit(0.5)) / F.lit(scale)).cast("double")


def js_fixed1(x: Column | str) -> Column:
    """``x.toFixed(1)``: the exact binary value to one place, halves away from zero, as text.

    The fraction is taken in units of 2^-52, so the rounding is done on integers."""
    v = F.abs(col_(x).cast("double"))
    whole = F.floor(v).cast("bigint")
    units = (v - whole) * F.lit(float(1 << 52))
    part = F.floor(units).cast("bigint")
    tenths = whole * 10 + F.shiftright(part * 10 + F.floor((units - part) * 10).cast("bigint") + F.lit(1 << 51), 52)
    sign = F.when((col_(x) < 0) & (tenths > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(tenths / 10).cast("bigint").cast("string"), F.lit("."), (tenths % 10).cast("string"))


def clean_text(text: Column | str) -> Column:
    """Strip trailing spaces/tabs on every line, then collapse 3+ newlines to 2."""
    no_trailing = F.regexp_replace(col_(text), r"[ \t]+(?=\n|\z)", "")
    return F.regexp_replace(no_trailing, r"\n{3,}", "\n\n")


def is_blank(text: Column | str) -> Column:
    """True when JavaScript ``trim()`` would leave nothing."""
    return F.coalesce(col_(text), F.lit("")).rlike("^" + JS_SPACE_CLASS + r"*\z")


def exact_for_model(model: Column | str) -> Column:
    """The model's BPE count is exact."""
    return F.coalesce(col_(model).rlike(EXACT_MODEL_PATTERN), F.lit(False))


def detect_path(text: Column | str) -> Column:
    """The path named on the first line, or NULL."""
    first = F.substring_index(col_(text), "\n", 1)
    found = F.regexp_extract(first, PATH_LINE_JAVA, 1)
    return F.when(found != "", found)


FEW = 32   # rows below which a step over all of them costs more than one text's plain loop


@F.arrow_udf(LongType())
def _fnv_of_utf16(texts: pa.Array) -> pa.Array:
    """FNV-1a of UTF-16LE texts, NULL for NULL: one unit of all texts that go on at a time, the last few texts by themselves."""
    wide = pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype="int64" if wide else "int32", count=len(texts) + 1, offset=texts.offset * (8 if wide else 4)).astype("int64") // 2
    units = np.frombuffer(data or b"", dtype="<u2", count=int(bounds[-1]))
    order = np.argsort(bounds[:-1] - bounds[1:], kind="stable")   # the longest first
    at, left = bounds[:-1][order], np.diff(bounds)[order]
    h = np.full(len(order), FNV_OFFSET, dtype="uint32")
    done, k = 0, int(np.searchsorted(-left, 0))
    while k >= FEW:
        for _ in range(done, int(left[k - 1])):   # all k have these units
            h[:k] ^= units.take(at[:k])
            h[:k] *= np.uint32(FNV_PRIME)
            at[:k] += 1
        done = int(left[k - 1])
        k = int(np.searchsorted(-left, -done))
    for j in range(k):
        x = int(h[j])
        for u in units[at[j]:at[j] + left[j] - done].tolist():
            x = (x ^ u) * FNV_PRIME & 0xFFFFFFFF
        h[j] = x
    out = np.empty(len(order), dtype="int64")
    out[order] = h
    return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False))


def fnv1a32(text: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as unpadded lower-case hex.

    Each unit needs the one before, and a native ``aggregate`` goes through boxed values one unit at a time; an Arrow
    UDF takes a unit of all the batch's texts at once."""
    return F.lower(F.hex(_fnv_of_utf16(F.encode(col_(text), "UTF-16LE"))))


def content_key(text: Column | str) -> Column:
    """Collision-safe identity of a text used for grouping at scale (SHA-256 hex)."""
    return F.sha2(F.coalesce(col_(text), F.lit("")), 256)


def block_key(type_: Column | str, text: Column | str, tool_id: Column | str,
              tool_name: Column | str, payload: Column | str) -> Column:
    """Stable identity of a block per kind: t:, u:, r: (content as its string, an array as its JSON), x:."""
    t = col_(type_)
    return (F.when(t == "text", F.concat(F.lit("t:"), F.coalesce(col_(text), F.lit(""))))
            .when(t == "tool_use", F.concat(F.lit("u:"), F.coalesce(col_(tool_id), F.lit("")),
                                            F.coalesce(col_(tool_name), F.lit("")),
                                            F.coalesce(col_(payload), F.lit("null"))))
            .when(t == "tool_result", F.concat(F.lit("r:"), F.coalesce(col_(tool_id), F.lit("")),
                                               F.when(col_(payload).startswith("["), col_(payload))
                                                .otherwise(F.coalesce(col_(text), F.lit("")))))
            .otherwise(F.concat(F.lit("x:"), F.coalesce(col_(payload), F.lit("null")))))


def render_block(type_: Column | str, text: Column | str, tool_name: Column | str,
                 payload: Column | str, rendered: Column | str | None = None) -> Column:
    """The string a block is counted by.

    text -> text; tool_use -> name + JSON(input); tool_result -> its flattened text;
    raw -> JSON(raw); tool definition -> name + description + JSON(schema), pre-rendered.
    """
    t = col_(type_)
    pre = col_(rendered) if rendered is not None else F.lit(None).cast("string")
    return (F.when(t == "text", F.coalesce(col_(text), F.lit("")))
            .when(t == "tool_use", F.concat(F.coalesce(col_(tool_name), F.lit("")),
                                            F.coalesce(col_(payload), F.lit("null"))))
            .when(t == "tool_result", F.coalesce(col_(text), F.lit("")))
            .when(t == "raw", F.coalesce(col_(payload), F.lit("null")))
            .otherwise(F.coalesce(pre, col_(text), F.lit(""))))
