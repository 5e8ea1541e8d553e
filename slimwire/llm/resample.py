"""Operator 12: importance resampling towards a target text, over hashed word runs with a head-tail vocabulary.

Features are runs of words, hashed by crc32 into buckets. The head of the vocabulary, the most frequent
words and pairs of words, is counted first and sent to all tasks: the exact crc32 state after each
frequent word (from which the crc32 of a longer run goes on) and the bucket of each frequent pair. A
feature of the tail takes its crc32 directly. Both feed the same exact totals by bucket, so what is in the
head changes the time and never a result. A document's weight is the mean of its features' gains (by how
much more frequent a bucket is in the target); seeded Gumbel noise added to the weights makes the highest scores
a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from slimwire.llm.common import in_batches, numbered, written

RUNS = 1               # longest run of words that is a feature
BUCKETS = 10_000
SMOOTH = 10_000        # added to the totals of all features
SEED = "2024"
LEAST_WORDS = 20       # documents with fewer are not drawn
PERCENT = 10
SCALE = 1000
HEAD = 4_000           # words, and as many pairs, of the head
LONGEST = 64           # bytes of a word or pair of the head, at most
COUNTED = 200_000      # words that a task counts at a time while the head is sought
WINDOW = 1 << 20       # bytes of a text that are cut into words at a time

# Words are letters a-z, digits and all beyond ASCII; A-Z count as a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None, window: int = WINDOW) -> Iterator[list[bytes]]:
    """The words of a text in order, window by window; a window ends between words."""
    text = (text or b"").translate(_TABLE)
    at = 0
    while at < len(text):
        end = at + window
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            cut = cut if cut > at else text.find(b" ", end)
            end = len(text) if cut < 0 else cut
        yield text[at:end].split()
        at = end


def runs_of(windows: Iterator[list[bytes]], runs: int) -> Iterator[tuple[list[bytes], int]]:
    """The windows with the last ``runs - 1`` words before each, and how many of the words are such."""
    last: list[bytes] = []
    for own in windows:
        yield last + own, len(last)
        last = (last + own)[-(runs - 1):] if runs > 1 else []


class Head(dict):
    """A value for each frequent feature; for all others the value of its crc32's bucket."""

    def __init__(self, items, of_bucket: np.ndarray):
        super().__init__(items)
        self.of_bucket = of_bucket.tolist()

    def __missing__(self, feature: bytes) -> int:
        return self.of_bucket[zlib.crc32(feature) % len(self.of_bucket)]


def values(own: list[bytes], held: int, runs: int, single: Head, states: dict, pairs: Head) -> Iterator[np.ndarray]:
    """The value of every feature that ends in ``own[held:]``."""
    yield np.fromiter(map(single.__getitem__, own[held:]), np.int64, len(own) - held)
    n = len(pairs.of_bucket)
    for k in range(2, runs + 1):
        out = []
        for i in range(max(held, k - 1), len(own)):
            first = own[i - k + 1]
            state = states.get(first)
            if state is None:
                state = zlib.crc32(first)
            if k == 2 and (got := pairs.get(first + b" " + own[i])) is not None:
                out.append(got)
            else:
                out.append(pairs.of_bucket[zlib.crc32(b" " + b" ".join(own[i - k + 2:i + 1]), state) % n])
        yield np.array(out, np.int64)


def _texts(batch: pa.RecordBatch, at: int) -> Iterator[bytes | None]:
    for x in batch.column(at).cast(pa.binary()):
        yield x.as_py()


def frequent(texts: DataFrame, length: int, size: int = HEAD) -> list[bytes]:
    """Some ``size`` of the most frequent runs of ``length`` words over all texts, by the counts of each task's own most frequent ones."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for text in _texts(b, 0):
                for own, n in runs_of(words(text), length):
                    held.update(own if length == 1 else (b" ".join(own[i - length + 1:i + 1]) for i in range(max(n, length - 1), len(own))))
                    if len(held) > COUNTED:
                        held = Counter(dict(held.most_common(COUNTED // 4)))
        top = [(w, c) for w, c in held.most_common(2 * size) if len(w) <= LONGEST][:size]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], ["word", "n"])

    found = in_batches(texts, count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in found.orderBy(F.desc("n"), "word").limit(size).collect()]


class Vocabulary:
    """The head: crc32 states of frequent words, frequent pairs. Sent to tasks with their closures: 2 x HEAD entries of LONGEST bytes at most."""

    def __init__(self, texts: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, size: int = HEAD):
        self.runs, self.buckets = runs, buckets
        self.states = {w: zlib.crc32(w) for w in frequent(texts, 1, size)}
        self.pairs = {p: zlib.crc32(p) % buckets for p in frequent(texts, 2, size)} if runs > 1 else {}

    def tables(self, of_bucket: np.ndarray) -> tuple:
        """Arguments of ``values`` that give each feature ``of_bucket`` of its bucket."""
        single = Head(((w, int(of_bucket[s % self.buckets])) for w, s in self.states.items()), of_bucket)
        return self.runs, single, self.states, Head(((p, int(of_bucket[b])) for p, b in self.pairs.items()), of_bucket)


def bucket_totals(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Features of all texts by bucket. Each task sends its sums; one row a bucket reaches the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.tables(np.arange(vocabulary.buckets))
        total = np.zeros(vocabulary.buckets, np.int64)
        for b in batches:
            for text in _texts(b, 0):
                for own, n in runs_of(words(text), vocabulary.runs):
                    for got in values(own, n, *tables):
                        total += np.bincount(got, minlength=vocabulary.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(vocabulary.buckets, np.int64)
    for r in in_batches(texts, add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray, smooth: int = SMOOTH, scale: int = SCALE) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the floored, scaled log of how much likelier it is in the target."""
    s_all, t_all = float(source.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((t + 1.0) * (s_all + smooth) / ((s + 1.0) * (t_all + smooth)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """Floored, scaled Gumbel noise by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, runs: int = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED, head: int = HEAD) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``: of those with ``least_words`` words,
    ``percent`` in a hundred (rounded down) with the highest scores are drawn, ranked 1, 2, 3...; others have no rank.

    ``target``: a table with ``text``, whose features the drawn documents shall resemble. Null and empty texts have no
    features, weight 0. Ties of score go to the smaller doc_id (null first); repeated rows share a score and are ranked
    one after the other. A null id draws its noise as empty text. A long text is read window by window. Empty tables:
    no rows, or weights that come from ``docs`` alone. Other columns of ``docs``, whatever their names, are not looked at.
    """
    text = docs.select("text")
    vocabulary = Vocabulary(text, runs, buckets, head)
    gain = gains(bucket_totals(text, vocabulary), bucket_totals(target.select("text"), vocabulary))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = vocabulary.tables(gain)
        for b in batches:
            out = []
            for t in _texts(b, 1):
                n = total = count = 0
                for own, held in runs_of(words(t), vocabulary.runs):
                    n += len(own) - held
                    for got in values(own, held, *tables):
                        count += len(got)
                        total += int(got.sum())
                out.append((n, count, total // count if count else 0))
            columns = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in columns)], ["doc_id", "__words", "n_features", "weight"])

    schema = StructType([docs.schema["doc_id"], *(StructField(c, LongType()) for c in ("__words", "n_features", "weight"))])
    scored = written(in_batches(docs.select("doc_id", "text"), weigh, schema).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("__words") >= least_words
    # one row a score: scores are whole numbers between some -60,000 and 80,000, however many rows there are
    counts = scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()
    wanted = sum(r["n"] for r in counts) * percent // 100
    least, seen = None, 0
    for r in counts:
        if seen >= wanted:
            break
        least, seen = r["score"], seen + r["n"]
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if least is None:
        return scored.select(*columns, none)
    near = able & (F.col("score") >= least)
    ranked = numbered(scored.filter(near), [F.desc("score"), F.col("doc_id"), F.col("n_features")], "ranks")
    ranks = ranked.select(*columns, F.when(F.col("__at") < wanted, F.col("__at") + 1).alias("rank"))
    return ranks.unionByName(scored.filter(~near).select(*columns, none))
