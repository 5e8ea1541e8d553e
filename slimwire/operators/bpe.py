"""T5 learn byte-pair merges from a corpus; T4 exact BPE token counts with a rank table.

Byte-level BPE: a word is its UTF-8 bytes, written as two-hex-digit symbols; a
merged symbol is the concatenation of its parts' hex. A rank table maps a token
(hex of its bytes) to its merge rank, or a pair of tokens where it has their columns;
the 256 single bytes are implicit.

T5 is an iterative Spark job over the *distinct word table* (pre-tokenize ->
``groupBy(word).count`` is the only pass over the corpus). It keeps two tables: counts by
adjacent pair, and an index from pair to the words that ever held it, in order of the pairs.
A round takes the best pairs (highest count, ties by smallest pair) as far as they are sure to
come next whatever the ones before them change, reads the index's rows of these pairs alone,
and adds to both tables what merging changes in those words: count deltas, and index rows of
the pairs that are new. Words are never rewritten: a word's symbols are its bytes with the merges
learned so far. Tables are written to the shared folder, so a lost executor loses no round.

T4 and U2 encode texts where they are, without a shuffle: pre-tokens in Python, a memo of short
ones a task, and a heap of merges over linked pieces, so that a pre-token of n bytes takes n log n.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from slimwire.session import store_table, stored

# Fixed value: GPT-2 style pre-tokenizer (contractions, letters, digits, other, spaces). White space is spelt out,
# so that it is the same for every engine.
SPACE = r"\t-\r\x{85}\p{Z}"
PRETOKEN_PATTERN = rf"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"""
MAX_RANKS_IN_TASK = 2_000_000        # rank tables above this are not shipped to tasks
MERGES_A_ROUND = 32                  # merges learned from one count of pairs, at most
PAIRS_A_ROUND = 2_000                # most frequent pairs looked at for that
PARTS = 48                           # deltas of the index until it is written as one
MEMO, MEMO_BYTES = 200_000, 64       # pre-tokens a task remembers, and how long they are at most
MEMO_TEXTS = 1 << 22                 # characters of the texts that a task remembers
WORDS_HELD = 300_000                 # distinct pre-tokens a task counts before it hands them on


def pretokens(text: Column) -> Column:
    """Array of pre-tokens of a text (every character lands in exactly one)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PRETOKEN_PATTERN), 0)


def hex_symbols(word: Column) -> Column:
    """UTF-8 bytes of a word as an array of two-hex-digit symbols."""
    h = F.lower(F.hex(F.encode(word, "UTF-8")))
    return F.filter(F.split(h, r"(?<=\G..)"), lambda s: s != "")


def _pattern():
    import regex  # the stdlib re has no \p{L}
    return regex.compile(PRETOKEN_PATTERN.replace(r"\x{85}", "\x85"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find, held = _pattern().findall, Counter()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            held.update(find(text.as_py() or ""))
            if len(held) >= WORDS_HELD:
                yield flush()
                held.clear()
    yield flush()


def word_table(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The heavy pass: distinct pre-tokens with their corpus frequency, as symbol arrays. Counted in the tasks first, so
    that a text's tokens are no rows."""
    counts = (texts.select(F.col(text_col).cast("string")).mapInArrow(_count_words, "word string, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")))
    return counts.select("word", "n", hex_symbols(F.col("word")).alias("syms"))


def _sure_merges(pairs: list[tuple[str, str, int]], most: int, whole: bool) -> list[tuple[str, str, int]]:
    """Of pairs in order of their counts: the first ones that one-by-one merging would take next, in this order.

    Merging (a, b) changes only counts of pairs with a or b, and a pair with the new symbol can't be more frequent than
    a pair (x, a) or (b, y) was. So the next pair is sure if it shares no symbol with those taken and every such pair of
    theirs is rarer than it. ``whole``: the list holds all pairs; else pairs beyond it count as its last."""
    taken: list[tuple[str, str, int]] = []
    used: set[str] = set()
    bound = 0
    floor = 0 if whole or not pairs else pairs[-1][2]
    for a, b, n in pairs:
        if taken and (a in used or b in used or n <= max(bound, floor)):
            break
        taken.append((a, b, n))
        used |= {a, b}
        bound = max([bound, *(c for x, y, c in pairs if (x, y) != (a, b) and (y == a or x == b))])
        if a == b or len(taken) == most:  # runs of one symbol change their own counts
            break
    return taken


class Encoder:
    """Byte-pair encoding with ranks by token (bytes) or by pair of tokens."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.by_pair = any(isinstance(k, tuple) for k in ranks)
        self.longest = max((len(k[0]) + len(k[1]) if self.by_pair else len(k) for k in ranks), default=0)

    def _rank(self, word: bytes, at: int, mid: int, end: int) -> int | None:
        if end - at > self.longest:
            return None
        return self.ranks.get((word[at:mid], word[mid:end]) if self.by_pair else word[at:end])

    def encode(self, word: bytes) -> list[bytes]:
        """Tokens of a pre-token: the pair of the lowest rank is merged first, the leftmost of equal ones."""
        n = len(word)
        end = list(range(1, n + 1))    # of the piece that starts at i; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := self._rank(word, i, i + 1, i + 2)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue  # one of the two has been merged otherwise
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                if (r := self._rank(word, i, k, end[k])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (h := before[i]) >= 0 and (r := self._rank(word, h, i, k)) is not None:
                heapq.heappush(heap, (r, h, i, k))
        out, i = [], 0
        while i < n:
            out.append(word[i:end[i]])
            i = end[i]
        return out


class _Counts(dict):
    """Token counts of pre-tokens, encoded when first asked for; long ones are not kept."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, pretoken: str) -> int:
        raw = pretoken.encode()
        got = len(self.encoder.encode(raw))
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[pretoken] = got
        return got


class TextEncoder:
    """Token counts of texts: pre-tokens are encoded once, and so are texts that come again soon, as re-sent blocks do."""

    def __init__(self, ranks: dict):
        self.find = _pattern().findall
        self.counts = _Counts(Encoder(ranks))
        self.texts: dict[str, int] = {}
        self.held = 0

    def total(self, text: str) -> int:
        got = self.texts.get(text)
        if got is None:
            got = sum(map(self.counts.__getitem__, self.find(text)))
            if self.held + len(text) > MEMO_TEXTS:
                self.texts.clear()
                self.held = 0
            if len(text) <= MEMO_TEXTS:
                self.texts[text] = got
                self.held += len(text)
        return got


# --------------------------------------------------------------------------- T5
INDEX = "a string, b string, word string, n long"
CHANGES = INDEX + ", more long, fresh boolean"


def _pairs(tokens: list[bytes]) -> Counter:
    return Counter(zip(tokens, tokens[1:]))


def _joined(words: pa.Array) -> np.ndarray:
    """The words' bytes one after the other as symbols (value + 1), a 0 behind each word."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(words.buffers()[1], kind, len(words) + 1, words.offset * np.dtype(kind).itemsize).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros(len(data) + len(size), np.int64)
    out[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.int64) + 1
    return out


def _merged(syms: np.ndarray, a: int, b: int, new: int) -> np.ndarray:
    """The symbols with each pair (a, b) as ``new``, from left to right."""
    at = np.flatnonzero(syms[:-1] == a)
    at = at[syms[at + 1] == b]
    if not len(at):
        return syms
    if a == b:   # in a run every second pair is there
        begins = np.concatenate([[True], np.diff(at) > 1])
        at = at[(np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]
    out = syms.copy()
    out[at] = new
    keep = np.ones(len(syms), bool)
    keep[at + 1] = False
    return out[keep]


def _word_pairs(syms: np.ndarray, width: int) -> np.ndarray:
    """A number for each adjacent pair: its word's place, its symbols."""
    both = np.flatnonzero((syms[:-1] != 0) & (syms[1:] != 0))
    return (np.cumsum(syms == 0)[both] * width + syms[both]) * width + syms[both + 1]


def _changes(known: dict, found: dict):
    """What merging ``found`` changes in the pairs of each word, after the merges ``known``; all words of a batch at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = [b"", *(bytes([v]) for v in range(256))]
        symbol = {t: k for k, t in enumerate(tokens) if t}

        def steps(ranks: dict) -> list[tuple[int, int, int]]:
            out = []
            for a, b in sorted(ranks, key=ranks.__getitem__):
                if a + b not in symbol:
                    symbol[a + b] = len(tokens)
                    tokens.append(a + b)
                out.append((symbol[a], symbol[b], symbol[a + b]))
            return out

        before, after = steps(known), steps(found)
        width, names = len(tokens), pa.array([t.hex() for t in tokens], pa.string())
        for batch in batches:
            words = batch.column("word")
            syms = _joined(words)
            for m in before:
                syms = _merged(syms, *m)
            was = _word_pairs(syms, width)
            for m in after:
                syms = _merged(syms, *m)
            key, where = np.unique(np.concatenate([was, _word_pairs(syms, width)]), return_inverse=True)
            old = np.bincount(where[:len(was)], minlength=len(key))
            more = np.bincount(where[len(was):], minlength=len(key)) - old
            some = np.flatnonzero(more)
            key, word = key[some], pa.array(key[some] // (width * width))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(key // width % width)), names.take(pa.array(key % width)), words.take(word), batch.column("n").take(word),
                                              pa.array(more[some], pa.int64()), pa.array(old[some] == 0)], ["a", "b", "word", "n", "more", "fresh"])
    return run


def learn_bpe_ranks(texts: DataFrame, merges: int, text_col: str = "text") -> DataFrame:
    """T5: ``merges`` byte-pair merges, the same as one by one; returns (rank, left, right, token, pair_count)."""
    spark = texts.sparkSession
    words = word_table(texts, text_col).where(F.size("syms") > 1)
    zipped = F.arrays_zip(F.slice("syms", 1, F.size("syms") - 1).alias("a"), F.slice("syms", 2, F.size("syms")).alias("b"))
    rows = words.select("word", "n", F.explode(zipped).alias("p")).select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "word", "n")
    by_word = rows.groupBy("a", "b", "word", "n").agg(F.count("*").alias("more"))

    def in_order(df: DataFrame) -> DataFrame:
        # a round then reads the files' parts of its pairs alone; the words of a frequent pair are split
        return stored(df.repartitionByRange("a", "b", "word").sortWithinPartitions("a", "b"), "bpe-index")

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("a", "b").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")

    held = in_order(by_word)
    index = held.drop("more")
    pairs = stored(summed(held.select("a", "b", (F.col("n") * F.col("more")).alias("cnt"))), "bpe-pairs")
    paths: list[str] = []     # of the changes since the index was written
    learned: list[tuple] = []
    known: dict[tuple[bytes, bytes], int] = {}
    while len(learned) < merges:
        whole = index
        if paths:
            changes = spark.read.schema(CHANGES).parquet(paths[-1])
            pairs = stored(summed(pairs.unionByName(changes.select("a", "b", (F.col("n") * F.col("more")).alias("cnt")))), "bpe-pairs")
            whole = index.unionByName(spark.read.schema(CHANGES).parquet(*paths).where("fresh").select(index.columns))
        if len(paths) == PARTS:
            index, paths = in_order(whole), []
            whole = index
        best = pairs.orderBy(F.col("cnt").desc(), "a", "b").limit(PAIRS_A_ROUND).collect()   # a bounded head of the list
        found = _sure_merges([(r["a"], r["b"], int(r["cnt"])) for r in best],
                             min(MERGES_A_ROUND, merges - len(learned)), len(best) < PAIRS_A_ROUND)
        if not found:
            break
        ranks = {(bytes.fromhex(a), bytes.fromhex(b)): len(learned) + i for i, (a, b, _) in enumerate(found)}
        learned += [(len(learned) + i, a, b, a + b, n) for i, (a, b, n) in enumerate(found)]
        if len(learned) < merges:
            one_of = " or ".join(f"(a = '{a}' and b = '{b}')" for a, b, _ in found)
            touched = whole.where(one_of).select("word", "n").distinct()
            paths.append(store_table(touched.mapInArrow(_changes(dict(known), ranks), CHANGES).sortWithinPartitions("a", "b"), "bpe-changes"))
            known.update(ranks)
    return spark.createDataFrame(learned, "rank long, left string, right string, token string, pair_count long")


# --------------------------------------------------------------------------- T4, U2
def ranks_from_table(ranks_df: DataFrame) -> dict:
    """A rank table as a dict, by pair of tokens where it has ``left`` and ``right``, else by token; refused above
    ``MAX_RANKS_IN_TASK`` entries (size bound)."""
    n = ranks_df.limit(MAX_RANKS_IN_TASK + 1).count()
    if n > MAX_RANKS_IN_TASK:
        raise ValueError(f"rank table has more than {MAX_RANKS_IN_TASK} entries")
    if {"left", "right"} <= set(ranks_df.columns):
        return {(bytes.fromhex(r["left"]), bytes.fromhex(r["right"])): int(r["rank"]) for r in ranks_df.select("left", "right", "rank").collect()}
    return {bytes.fromhex(r["token"]): int(r["rank"]) for r in ranks_df.select("token", "rank").collect()}


def bpe_tokenizer_udf(ranks: dict):
    """A ``Column -> Column`` tokenizer (Arrow-batched) for ``reduce_requests``; a null text has no tokens."""
    encoders: list[TextEncoder] = []  # one a task's process, made there

    @F.pandas_udf(LongType())
    def count(s: pd.Series) -> pd.Series:
        if not encoders:
            encoders.append(TextEncoder(ranks))
        return pd.Series([encoders[0].total(t or "") for t in s], dtype="int64")

    return count


def bpe_token_counts(texts: DataFrame, ranks_df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """T4: exact BPE token count of each text (``key`` identifies it), in one pass and without a shuffle."""
    return texts.select(key, bpe_tokenizer_udf(ranks_from_table(ranks_df))(F.col(text_col)).alias("tokens"))
