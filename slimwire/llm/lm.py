"""Operator 2: interpolated modified Kneser-Ney bigram model, counted in Spark, scored from mapped hash arrays.

Training counts word pairs: each task reduces the pairs of the texts it reads, deals them into shards
of the hash space, and one task per shard adds them up and writes the shard's sorted hashes and counts
into the shared folder. A second exchange adds up what each word has as a word (its count, how many
words it follows) and as a context (how many words follow it once, twice, more often). Scoring maps
these arrays into memory and looks pairs and words up by binary search; no text is moved.

Order two is what the operator learns: trigram types of a corpus of this kind are nearly as many as its
words, and their exchange alone would take more disk than the input has.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.llm.common import WORD, buffers, crc_mod, in_batches, mix, mounted, pair, shared_path, shuffle_partitions, slices, word_hashes

_U = np.uint64
BEGIN, END = (mix(np.array([x], _U))[0] for x in (0xB0B0, 0xE0D0))  # what stands before and after the words
SHARD_BYTES = 16 << 20   # text a shard of the hash space, about
FLUSH = 4 << 20          # word pairs a task holds before it sends them on
HOT_WORDS = 256          # the most frequent words of a sample: their pairs are dealt by the whole pair
HOT_SAMPLE = 2000        # documents of that sample; it only balances tasks and never changes a count

PAIRS, WORDS, COUNTS = 0, 1, 2  # kinds of rows


# -- small integers as bytes, the few large ones beside them ----------------------------

def pack(x: np.ndarray) -> bytes:
    x = x.astype(_U)
    at = np.flatnonzero(x >= 255)
    return b"".join((np.array([len(x), len(at)], _U).tobytes(), np.minimum(x, _U(255)).astype(np.uint8).tobytes(), at.astype(_U).tobytes(), x[at].tobytes()))


def unpack(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    n, m = (int(v) for v in np.frombuffer(blob, _U, 2, at))
    x = np.frombuffer(blob, np.uint8, n, at := at + 16).astype(_U)
    where = np.frombuffer(blob, _U, m, at := at + n)
    x[where.astype(np.int64)] = np.frombuffer(blob, _U, m, at := at + 8 * m)
    return x, at + 8 * m


def pack_keys(x: np.ndarray) -> bytes:
    return np.array([len(x)], _U).tobytes() + x.tobytes()


def unpack_keys(blob: bytes, at: int) -> tuple[np.ndarray, int]:
    n = int(np.frombuffer(blob, _U, 1, at)[0])
    return np.frombuffer(blob, _U, n, at + 8), at + 8 + 8 * n


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, each column added up by key."""
    if len(keys) == 0:
        return (keys, *columns)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return (k[first], *(np.add.reduceat(c[order], first) for c in columns))


# -- counting ---------------------------------------------------------------------------

def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts: each token (words, then the end), the token before it, and each text's first token."""
    words, first = word_hashes(data, offsets)
    n = len(offsets) - 1
    start = first[:-1] + np.arange(n)           # one end a text moves the later words
    tokens = np.empty(len(words) + n, _U)
    ends = first[1:] + np.arange(n)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[ends] = END
    tokens[~is_end] = words
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[start] = BEGIN
    return tokens, before, np.concatenate([start, [len(tokens)]])


def _rows(shard, kind, blob) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], ["shard", "kind", "data"])


ROWS = "shard long, kind int, data binary"


def _dealt(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(shard[part[0]]), [c[part] for c in columns]


def _top(x: np.ndarray, bits: int) -> np.ndarray:
    return (x >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(x), np.int64)


def pair_shard(before: np.ndarray, keys: np.ndarray, hot: np.ndarray, bits: int) -> np.ndarray:
    """The shard of each pair: by its first word; by the whole pair if that word is hot."""
    return _top(np.where(np.isin(before, hot), keys, before), bits)


def _count(bits: int, hot: np.ndarray):
    def flush(before: list[np.ndarray], tokens: list[np.ndarray]) -> pa.RecordBatch:
        b, t = np.concatenate(before), np.concatenate(tokens)
        before.clear()
        tokens.clear()
        k = pair(b, t)
        order = np.argsort(k, kind="stable")
        k = k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        count = np.diff(np.append(first, len(k)))
        order = order[first]
        b, t, k = b[order], t[order], k[first]
        shards, blobs = [], []
        for s, (vb, vt, vc) in _dealt(pair_shard(b, k, hot, bits), b, t, count):
            o = np.argsort(vb, kind="stable")
            heads, runs = np.unique(vb[o], return_counts=True)
            shards.append(s)
            blobs.append(pack_keys(heads) + pack(runs) + pack_keys(vt[o]) + pack(vc[o]))
        return _rows(shards, [PAIRS] * len(shards), blobs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, tokens, held = [], [], 0
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                t, b, _ = sequences(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                before.append(b)
                tokens.append(t)
                held += len(t)
                if held >= FLUSH:
                    yield flush(before, tokens)
                    held = 0
        if held:
            yield flush(before, tokens)
    return run


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The rows of each shard in turn, from input sorted by shard."""
    now, rows = None, []
    for batch in batches:
        for s, kind, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append((kind, blob))
    if rows:
        yield now, rows


def _save(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Each array to a file of its own; a file appears whole or not at all, so tasks can run again."""
    os.makedirs(folder, exist_ok=True)
    for k, x in arrays.items():
        spare = f"{folder}/.{name}-{k}-{uuid.uuid4().hex}"
        with open(spare, "wb") as f:
            np.save(f, x)
        os.replace(spare, f"{folder}/{name}-{k}.npy")


def _save_counts(folder: str, name: str, column: str, x: np.ndarray) -> None:
    at = np.flatnonzero(x >= 255)
    _save(folder, name, **{column: np.minimum(x, 255).astype(np.uint8), column + "_at": at, column + "_big": x[at].astype(_U)})


def _add_pairs(folder: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            b, t, c = [], [], []
            while rows:
                _, blob = rows.pop()
                heads, at = unpack_keys(blob, 0)
                runs, at = unpack(blob, at)
                tokens, at = unpack_keys(blob, at)
                b.append(np.repeat(heads, runs.astype(np.int64)))
                t.append(tokens)
                c.append(unpack(blob, at)[0])
            b, t, c = np.concatenate(b), np.concatenate(t), np.concatenate(c)
            keys = pair(b, t)
            order = np.argsort(keys, kind="stable")
            k = keys[order]
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            c, b, t, k = np.add.reduceat(c[order], first), b[order[first]], t[order[first]], k[first]
            _save(folder, f"pairs-{shard}", keys=k)
            _save_counts(folder, f"pairs-{shard}", "count", c)
            ones = np.ones(len(c), _U)
            as_context = summed(b, *((c == i).astype(_U) for i in (1, 2)), (c >= 3).astype(_U), c)
            as_word = summed(t, c, ones)
            zero = np.zeros
            keys = np.concatenate([as_context[0], as_word[0]])
            n, m = len(as_context[0]), len(as_word[0])
            # count, follows, once, twice, more; a text's begin is no word, its count comes from its pairs
            begins = np.where(as_context[0] == BEGIN, as_context[4], _U(0))
            columns = [np.concatenate([begins, as_word[1]]), np.concatenate([zero(n, _U), as_word[2]]),
                       *(np.concatenate([as_context[i], zero(m, _U)]) for i in (1, 2, 3))]
            got = summed(keys, *columns)
            shards, blobs = [], []
            for s, (k, *cols) in _dealt(_top(got[0], bits), *got):
                shards.append(s)
                blobs.append(pack_keys(k) + b"".join(pack(x) for x in cols))
            of = np.array([np.count_nonzero(c == i) for i in (1, 2, 3, 4)] + [len(c)], _U)
            yield _rows([*shards, shard], [WORDS] * len(shards) + [COUNTS], [*blobs, of.tobytes()])
    return run


def _add_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            parts, of = [], np.zeros(5, _U)
            for kind, blob in rows:
                if kind == COUNTS:
                    of += np.frombuffer(blob, _U)
                    continue
                k, at = unpack_keys(blob, 0)
                cols = [k]
                for _ in range(5):
                    x, at = unpack(blob, at)
                    cols.append(x)
                parts.append(cols)
            stats = np.zeros(8, _U)  # words, tokens, pair types, words that follow 1, 2, 3, 4 and 3 or more
            if parts:
                keys, count, follows, *once = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                _save(folder, f"words-{shard}", keys=keys)
                for name, x in zip(("count", "follows", "once", "twice", "more"), (count, follows, *once), strict=True):
                    _save_counts(folder, f"words-{shard}", name, x)
                word = keys != BEGIN
                stats = np.array([word.sum(), count[word].sum(), follows.sum(), *(np.count_nonzero(follows == i) for i in (1, 2, 3, 4)), np.count_nonzero(follows >= 3)], _U)
            yield _rows([shard], [COUNTS], [np.concatenate([of, stats]).tobytes()])
    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts from counts of counts; where those are too few to give one, 0.5, 1 and 1.5."""
    usual = (0.5, 1.0, 1.5)
    if not n1 or not n2:
        return usual
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else -1.0)
    return tuple(d if 0 < d <= k else usual[k - 1] for k, d in enumerate(found, 1))


@dataclass(frozen=True)
class Model:
    """A trained model: where its arrays are, and the few numbers that hold for all of them."""

    folder: str
    bits: int
    hot: tuple[int, ...]
    words: int            # V: distinct training tokens
    tokens: int           # N: training tokens
    types: int            # distinct pairs
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_rest: float      # what the word distribution leaves to the uniform one

    def word_p(self, follows: np.ndarray) -> np.ndarray:
        """Probability of words by how many different tokens they follow (0: unknown)."""
        d = np.array([0.0, *self.word_discounts])[np.minimum(follows, 3).astype(np.int64)]
        own = (follows - d) / self.types if self.types else np.zeros(len(follows))
        return own + self.word_rest / (self.words + 1)


def train(docs: DataFrame) -> Model:
    """Learn from all texts of ``docs`` (a null is an empty text, which is one end)."""
    spark = docs.sparkSession
    slim = docs.select(F.col("text").cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / SHARD_BYTES)))))
    shards, ask = 1 << bits, shuffle_partitions(spark)
    few = slim.withColumn("h", F.xxhash64("text")).orderBy("h").limit(HOT_SAMPLE)
    heads = (few.select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"))).alias("w")).groupBy(F.lower("w").alias("w")).count()
             .orderBy(F.desc("count"), "w").limit(HOT_WORDS).collect())
    data, offsets = buffers(pa.array([r["w"] for r in heads], pa.string()))
    hot = np.unique(np.append(word_hashes(data, offsets)[0], BEGIN))

    folder = mounted(shared_path(spark, "kneser-ney"))
    tasks = min(shards, max(ask, shards // 4))
    pairs = slim.transform(in_batches, _count(bits, hot), ROWS).repartition(tasks, "shard").sortWithinPartitions("shard")
    words = pairs.transform(in_batches, _add_pairs(folder, bits), ROWS).repartition(tasks, "shard").sortWithinPartitions("shard")
    got = np.zeros(13, _U)
    for r in words.transform(in_batches, _add_words(folder), ROWS).toLocalIterator():  # 13 numbers a shard
        got += np.frombuffer(bytes(r["data"]), _U)
    p1, p2, p3, p4, types, v, n, follows, w1, w2, w3, w4, more = (int(x) for x in got)
    of_pairs, of_words = discounts(p1, p2, p3, p4), discounts(w1, w2, w3, w4)
    rest = (of_words[0] * w1 + of_words[1] * w2 + of_words[2] * more) / follows if follows else 1.0
    return Model(folder, bits, tuple(int(x) for x in hot), v, n, types, of_pairs, of_words, rest)


# -- scoring ----------------------------------------------------------------------------

class _Counts:
    """A mapped column of small counts with its few large ones."""

    def __init__(self, path: str):
        self.small = np.load(f"{path}.npy", mmap_mode="r")
        self.at, self.big = np.load(f"{path}_at.npy"), np.load(f"{path}_big.npy")

    def take(self, at: np.ndarray) -> np.ndarray:
        x = self.small[at].astype(np.float64)
        large = np.flatnonzero(x == 255)
        x[large] = self.big[np.searchsorted(self.at, at[large])]
        return x


@lru_cache(maxsize=4096)
def _mapped(folder: str, name: str, columns: tuple[str, ...]):
    if not os.path.exists(f"{folder}/{name}-keys.npy"):
        return None
    return np.load(f"{folder}/{name}-keys.npy", mmap_mode="r"), [_Counts(f"{folder}/{name}-{c}") for c in columns]


def look_up(folder: str, table: str, columns: tuple[str, ...], keys: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
    """The columns of ``keys`` in the mapped shards; 0 where a key isn't there."""
    out = [np.zeros(len(keys)) for _ in columns]
    order = np.lexsort((keys, shard))
    for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        found = _mapped(folder, f"{table}-{shard[part[0]]}", columns) if len(part) else None
        if found is None:
            continue
        have, counts = found
        at = np.minimum(np.searchsorted(have, keys[part]), len(have) - 1)
        hit = have[at] == keys[part]
        for o, c in zip(out, counts, strict=True):
            o[part[hit]] = c.take(at[hit])
    return out


def log_probabilities(model: Model, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the model's probability of each token after the one before it, and the tokens' training counts."""
    types, of_pair = np.unique(pair(before, tokens), return_index=True)
    back = np.searchsorted(types, pair(before, tokens))
    b, t = before[of_pair], tokens[of_pair]
    words = np.unique(np.concatenate([b, t]))
    count, follows, *runs = look_up(model.folder, "words", ("count", "follows", "once", "twice", "more"), words, _top(words, model.bits))
    ib, it = np.searchsorted(words, b), np.searchsorted(words, t)
    hot = np.array(model.hot, _U)
    c, = look_up(model.folder, "pairs", ("count",), types, pair_shard(b, types, hot, model.bits))
    total = np.where(b == END, 0.0, count[ib])
    low = model.word_p(follows[it])
    d = np.array([0.0, *model.pair_discounts])[np.minimum(c, 3).astype(np.int64)]
    spread = sum(x * r[ib] for x, r in zip(model.pair_discounts, runs, strict=True))
    p = np.where(total > 0, (c - d + spread * low) / np.maximum(total, 1), low)
    return np.log10(p)[back], np.where(t == BEGIN, 0.0, count[it])[back]


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            n_tokens, n_known, base, score = ([] for _ in range(4))
            for i, j in slices(offsets):
                tokens, before, first = sequences(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                logs, counts = log_probabilities(model, tokens, before)
                plain = np.log10((counts + 0.1) / (model.tokens + 0.1 * (model.words + 1)))
                n_tokens.append(np.diff(first))
                n_known.append(np.add.reduceat((counts > 0).astype(np.int64), first[:-1]))
                base.append(np.add.reduceat(plain, first[:-1]))
                score.append(np.add.reduceat(logs, first[:-1]))
            rows = [np.concatenate(x) if x else np.empty(0) for x in (n_tokens, n_known, base, score)]
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
                 pa.array(np.full(n, model.tokens), pa.int64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.float64()),
                 pa.array(10 ** (-rows[3] / np.maximum(rows[0], 1)), pa.float64())], OUT)
    return run


OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, held_out) with its token counts, the unigram score, the model's log10
    probability and its perplexity. Null and empty texts are one end token; repeated rows are scored each."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("held_out"))
    return slim.transform(in_batches, _score(model), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def score_held_out(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Learn from the rows whose crc32(doc_id as text) mod ``folds`` is not 0 and score all rows. A null doc_id counts
    as remainder 0; extra columns are ignored; an empty table gives no rows."""
    marked = docs.withColumn("held_out", crc_mod("doc_id", folds) == 0)
    return score(marked, train(marked.filter(~F.col("held_out"))))
