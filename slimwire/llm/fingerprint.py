"""Operator 3: document fingerprints by locally consistent parsing.

A text is parsed into phrases, the phrases into phrases of phrases, and so on. Where a phrase begins is
decided by deterministic coin tossing: four rounds of comparing neighbours leave labels below six, and a
phrase begins at each local maximum of the labels. Cuts depend on a few neighbouring symbols alone, so
equal substrings get equal inner phrases at any offset. A phrase's name is a hash of the names in it; runs
of one symbol become a symbol of their own first. The fingerprint is a bottom-k sketch of the names of all
levels from the second on, and the likeness of two fingerprints estimates the share of names in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.llm.common import in_batches, mix, pair, shuffle_partitions

KEEP = 64          # names in a fingerprint
FIRST_LEVEL = 2    # the least level whose names count (about ten characters a phrase)
TOGETHER = 1 << 18  # code points parsed at a time, more only for one longer text

_U = np.uint64
_DEBRUIJN = _U(0x03F79D71B4CB0A89)
_BIT = np.zeros(64, np.uint8)
for _i in range(64):
    _BIT[(((1 << _i) * 0x03F79D71B4CB0A89) & (2 ** 64 - 1)) >> 58] = _i


def _toss(n: int) -> np.ndarray:
    """Table of the next round's label for a label below ``n`` (row) after another (column): twice the place of the
    lowest bit in which they differ, plus that bit."""
    a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    d = a ^ b
    low = np.zeros_like(d)
    for k in range(7, -1, -1):
        low[(d >> k) & 1 == 1] = k
    return (2 * low + ((a >> low) & 1)).astype(np.uint8)


_PLACE = mix(np.arange(1, 257, dtype=_U)) | _U(1)   # a factor for each place within a phrase; phrases have some ten symbols
_ROUNDS = [_toss(n) for n in (128, 16, 8)]  # 64-bit names -> 128 -> 14 -> 8 -> 6 labels


def _labels(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Labels below six; neighbours within a text differ. Before a text stands a symbol unlike its first one."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[start] = ~x[start]
    d = x ^ before
    low = _BIT[((d & (~d + _U(1))) * _DEBRUIJN) >> _U(58)]
    label = (2 * low + ((x >> low.astype(_U)) & _U(1)).astype(np.uint8)).astype(np.uint8)
    prior = np.empty_like(label)
    for table in _ROUNDS:
        prior[1:] = label[:-1]
        prior[start] = label[start] ^ 1
        label = table[label, prior]
    return label


def _level(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of the next level; every text has at least one symbol."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[offsets[:-1]] = True
    if not new.all():  # runs
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(x)))
        x = x[at]
        long = np.flatnonzero(length > 1)
        x[long] = pair(x[long], length[long].astype(_U))
        offsets = np.append(np.searchsorted(at, offsets[:-1]), len(at))
    start = offsets[:-1]
    label = _labels(x, start)
    peak = np.zeros(len(x), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = offsets[1:] - 1
    peak[last] = False  # a text's last symbol has no right neighbour
    peak[start] = True
    at = np.flatnonzero(peak)
    length = np.diff(np.append(at, len(x)))
    name = np.add.reduceat(x * _PLACE[(np.arange(len(x)) - np.repeat(at, length)) & 255], at)
    return mix(name + length.astype(_U)), np.append(np.searchsorted(at, start), len(at))


def fingerprints(texts: list[np.ndarray], keep: int = KEEP) -> list[np.ndarray]:
    """The ``keep`` least 32-bit phrase hashes (sorted, distinct) of each text, given as arrays of code points."""
    sizes = np.array([len(t) for t in texts], np.int64)
    alive = np.flatnonzero(sizes)
    out = [np.empty(0, np.uint32)] * len(texts)
    if not len(alive):
        return out
    x = np.concatenate([texts[i] for i in alive]).astype(_U) + _U(1)
    offsets = np.concatenate([[0], np.cumsum(sizes[alive])])
    values, owner, level, ids = [], [], 0, alive
    while len(ids):
        x, offsets = _level(x, offsets)
        level += 1
        if level < FIRST_LEVEL:
            continue
        counts = np.diff(offsets)
        values.append((mix(x + _U(level)) >> _U(32)).astype(np.uint32))
        owner.append(np.repeat(ids, counts))
        more = counts > 1  # a text of one phrase is done
        if not more.all():
            x, ids = x[np.repeat(more, counts)], ids[more]
            offsets = np.concatenate([[0], np.cumsum(counts[more])])
    values, owner = np.concatenate(values), np.concatenate(owner)
    both = np.unique((owner.astype(_U) << _U(32)) | values)
    owner, values = (both >> _U(32)).astype(np.int64), (both & _U(0xFFFFFFFF)).astype(np.uint32)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [values[first[i]:min(first[i + 1], first[i] + keep)] for i in range(len(texts))]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated share of phrase names in common, from 0 to 1; two empty fingerprints are alike, an empty one and another aren't."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:keep]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _rows(held: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """Results of all documents held but the last, which is the one after them."""
    texts = [t for _, t in held]
    changed = [edited(t, u) for t, u in zip(texts, texts[1:])]
    prints = fingerprints([code_points(t) for t in texts])
    others = fingerprints([code_points(t) for t in changed])
    hexed = lambda p: p.astype(">u4").tobytes().hex()
    n = len(changed)
    return pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in held[:n]], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
         pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
         pa.array([hexed(p) for p in prints[:n]], pa.string()), pa.array([hexed(p) for p in others], pa.string()),
         pa.array([likeness(p, q) for p, q in zip(prints, others)], pa.float64()), pa.array([likeness(p, q) for p, q in zip(prints, prints[1:])], pa.float64())],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, str]] = []
    size, bucket, closed = 0, None, False
    for batch in batches:
        for b, tail, doc, text in zip(*(batch.column(c) for c in ("bucket", "tail", "doc_id", "text")), strict=True):
            b, tail, text = b.as_py(), tail.as_py(), text.as_py() or ""
            if b != bucket:
                held, size, bucket, closed = [], 0, b, False
            if closed:  # repeated rows of the document after the bucket
                continue
            held.append((doc.as_py(), text))
            size += len(text)
            closed = bool(tail)
            if len(held) > 1 and (tail or size >= TOGETHER):
                yield _rows(held)
                held, size = [] if tail else held[-1:], 0


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (doc_id, text): n_chars, its fingerprint, the edited text's hash and fingerprint, and how alike
    the fingerprint is to the edited text's and to the next document's.

    Next is by ascending doc_id, nulls first, ties by the text's hash (null: empty); after the last comes the first. Empty
    texts have empty fingerprints, repeated rows follow one another, other columns are ignored, an empty table gives no
    rows.

    Rows are dealt once into buckets of neighbours, cut at approximate quantiles of id and text hash, so that the rows of one
    id, or those without, are split as well unless their texts are the same; the first document of a bucket also
    goes to the bucket before it, so that each finds its next one where it is.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = slim.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    n = 4 * shuffle_partitions(spark)
    least = slim.agg(F.min("doc_id")).first()[0] or 0
    # rounding keeps the order of (id, hash), so every cut falls between neighbours
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(float(least) - 2)) + (F.col("h").cast("double") / 2.0**64 + 0.5)
    slim = slim.withColumn("place", place)
    cuts = slim.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    splits = [-float("inf"), *sorted(set(cuts) or {0.0}), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="place", outputCol="as_bucket").transform(slim)
    dealt = dealt.withColumn("bucket", F.col("as_bucket").cast("int")).drop("as_bucket", "place")
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "h")).alias("first")).orderBy("bucket").collect()  # one row a bucket
    heads = [(r["first"]["doc_id"], r["first"]["h"], firsts[i - 1]["bucket"]) for i, r in enumerate(firsts)]
    head = F.broadcast(spark.createDataFrame(heads, "head long, head_h long, before int"))
    marked = dealt.join(head, F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("h") == F.col("head_h")), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct("bucket", F.lit(0).alias("tail")))).otherwise(
        F.array(F.struct("bucket", F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))))
    spread = marked.select("doc_id", "h", "text", F.explode(places).alias("p")).select("p.bucket", "p.tail", "doc_id", "h", "text")
    ordered = spread.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "h", F.coalesce("text", F.lit("")))
    return ordered.transform(in_batches, _stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
