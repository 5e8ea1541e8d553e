"""Operator 7: benchmark decontamination by latent semantic retrieval.

Passages are overlapping windows of words, of documents and of benchmark items alike, weighted by tf-idf over the
benchmark's vocabulary without stop words (document frequencies counted over all documents). A randomised SVD, its
products computed in Spark over the passages of all documents and of the benchmark, gives the latent
space; every window of every document is projected into it and compared with all benchmark passages by cosine. Candidates
are checked on the words themselves: the idf-weighted longest common subsequence with the passage, and for middling ones
(paraphrases) whether the item's answer stands there too. An item is found by any of its passages, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructType

from slimwire.llm.common import BARE, buffers, in_batches, removed, shared_path, slices, word_hashes

_U = np.uint64
WINDOW, STRIDE = 32, 16   # words of a passage, and between the starts of two
RANK, MORE = 128, 16      # latent dimensions, and how many more the random projection has
ITEMS = 20_000            # windows of benchmark items searched in one pass, at most; a larger benchmark is searched block by block
TERMS = 50_000            # words of a block's vocabulary, at most (one passage more): bounds every matrix that is sent
LEAST_WORDS = 5           # words of an item that can be told from chance
STOP_SHARE = 0.05         # words in more documents than this are stop words in the latent space (an item's rarest words never are)
STOP_LEAST = 10           # documents that a stop word is in, at least
COSINE = 0.3              # of a candidate, at least
PART = 0.4                # of a benchmark passage's latent vector that a candidate's covers, at least
ENERGY = 0.3              # of a benchmark passage's weight that a candidate's window has, at least
SURE = 0.6                # weighted common subsequence from which an item's passage is found
MAYBE = 0.4               # from which it is found if its answer is there too
ANSWER = re.compile(r"(?:answer|antwort|réponse|respuesta)\s*[:=]\s*(.+)\Z", re.I | re.S)
ANSWER_WORDS = 5          # without such a mark, an item's last words are its answer
STEP = 1 << 20            # bytes of text handled at a time, more only for one longer text
TOGETHER = 2048           # windows projected at a time
FIT_TOGETHER = 128        # the same while the SVD is fitted: a small dense matrix over the terms in them
PIECE = 1 << 16           # windows in a row of the written passages, at most
TERMS_PART = 1024         # terms whose sums are a row between the tasks of the fit

MATCH = StructType().add("item_id", LongType()).add("cosine", DoubleType()).add("overlap", DoubleType()).add("answer", BooleanType())


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bare words (letters and digits, lower-cased) as hashes, and each text's first one."""
    return word_hashes(*buffers(pc.utf8_lower(pa.array(texts, pa.string()))), BARE)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the passages of the texts, and the text of each; a text without words has none."""
    counts = np.diff(first)
    many = np.where(counts > 0, np.maximum(1, -(-(counts - STRIDE) // STRIDE)), 0)
    text = np.repeat(np.arange(len(counts)), many)
    start = first[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    return start, np.minimum(start + WINDOW, first[text + 1]), text


@dataclass(frozen=True)
class Terms:
    """The benchmark's vocabulary with its weights."""

    vocabulary: np.ndarray   # sorted hashes
    idf: np.ndarray

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their terms."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == words)
        return hit, at[hit]

    def weight(self, words: np.ndarray) -> np.ndarray:
        """Weights of the words; 0 for those that are no terms."""
        hit, term = self.of(words)
        out = np.zeros(len(words))
        out[hit] = self.idf[term]
        return out


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(pc.utf8_lower(batch.column("text")))
    for i, j in slices(offsets, STEP):
        yield i, j, *word_hashes(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], BARE)


def _document_frequency(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        terms = Terms(vocabulary, np.empty(0))
        for batch in batches:
            for i, j, words, first in _slices(batch):
                hit, term = terms.of(words)
                text = np.searchsorted(first, hit, "right") - 1
                total += np.bincount(np.unique(text * len(vocabulary) + term) % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["term", "n"])
    return run


def projected(weighted: np.ndarray, hit: np.ndarray, term: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``weighted`` over the terms in each passage."""
    out = np.zeros((len(hit) + 1, weighted.shape[1]), weighted.dtype)
    np.cumsum(weighted[term], axis=0, out=out[1:])
    return out[np.searchsorted(hit, end)] - out[np.searchsorted(hit, start)]


def term_runs(terms: Terms, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' terms in order, and starts and ends of the passages in them; a passage without terms is left out, as its products are 0."""
    hit, term = terms.of(words)
    start, end, _ = windows(first)
    lo, hi = np.searchsorted(hit, start), np.searchsorted(hit, end)
    some = hi > lo
    return term, lo[some], hi[some]


def _written_runs(terms: Terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words, first in _slices(batch):
                term, lo, hi = term_runs(terms, words, first)
                for i in range(0, len(lo), PIECE):
                    a, b = lo[i:i + PIECE], hi[i:i + PIECE]
                    packed = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (term[a[0]:b[-1]], a - a[0], b - a[0])]
                    yield pa.RecordBatch.from_arrays(packed, ["term", "lo", "hi"])
    return run


def _add_products(z: np.ndarray, weighted: np.ndarray, term: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
    """Adds C'C w to ``z``, C the counts of terms in the passages (runs ``lo`` to ``hi`` of ``term``), w ``weighted``."""
    for i in range(0, len(lo), FIT_TOGETHER):
        a, many = lo[i:i + FIT_TOGETHER], (hi - lo)[i:i + FIT_TOGETHER]
        inside, own = np.unique(term[a[0]:a[-1] + many[-1]], return_inverse=True)
        row = np.repeat(np.arange(len(a)), many)
        at = np.arange(len(row)) + np.repeat(a - a[0] - (np.cumsum(many) - many), many)
        counts = np.bincount(row * len(inside) + own[at], minlength=len(a) * len(inside)).reshape(len(a), -1).astype(weighted.dtype)
        z[inside] += counts.T @ (counts @ weighted[inside])


def _products(weighted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros(weighted.shape)
        for batch in batches:
            for packed in zip(*(batch.column(c) for c in ("term", "lo", "hi")), strict=True):
                _add_products(z, weighted, *(np.frombuffer(x.as_buffer(), np.int32) for x in packed))
        task = TaskContext.get().partitionId()
        for part in range(-(-len(z) // TERMS_PART)):
            sums = pa.array([z[part * TERMS_PART:(part + 1) * TERMS_PART].tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), sums], ["part", "task", "sums"])
    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a part, from rows that are in the order of parts and tasks."""
    row = lambda part, total: pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])
    last, total = None, np.empty(0)
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
            more = np.frombuffer(sums.as_buffer())
            if part == last:
                total += more
                continue
            if last is not None:
                yield row(last, total)
            last, total = part, more.copy()
    if last is not None:
        yield row(last, total)


def summed_products(runs: DataFrame, weighted: np.ndarray) -> np.ndarray:
    """C'C w over all written passages: the tasks' sums are added up in Spark, part by part in the order of the tasks; the driver gets one row a part."""
    parts = runs.transform(in_batches, _products(weighted), "part int, task int, sums binary")
    total = parts.repartition("part").sortWithinPartitions("part", "task").transform(in_batches, _added, "part int, sums binary")
    z = np.zeros(weighted.shape)
    for r in total.collect():
        z[r["part"] * TERMS_PART:(r["part"] + 1) * TERMS_PART] = np.frombuffer(bytes(r["sums"])).reshape(-1, z.shape[1])
    return z


def latent_space(texts: DataFrame, terms: Terms, items: tuple[np.ndarray, np.ndarray], rank: int = RANK, seed: int = 5) -> np.ndarray:
    """Right singular vectors (terms x rank) of the tf-idf passages of all ``texts`` and the benchmark's ``items``.

    Randomised: one power step from a random projection, orthonormalised, then rotated by the small Gram matrix. The
    items weigh as much as the texts, so that the space holds what tells them apart. The passages' terms are written once
    to the shared folder, read by both steps and then removed; a repeated text's passages count as often as it is there."""
    n = len(terms.vocabulary)
    spark, idf = texts.sparkSession, terms.idf[:, None]
    path, kind = shared_path(spark, "passages"), "term binary, lo binary, hi binary"
    texts.transform(in_batches, _written_runs(terms), kind).write.parquet(path)
    runs, own = spark.read.schema(kind).parquet(path), term_runs(terms, *items)
    w = np.random.default_rng(seed).standard_normal((n, min(n, rank + MORE)))
    for last in (False, True):
        weighted = (idf * w).astype(np.float32)
        own_z = np.zeros(w.shape)
        _add_products(own_z, weighted, *own)
        z, own_z = idf * summed_products(runs, weighted), idf * own_z
        z += max(1.0, np.vdot(w, z) / max(np.vdot(w, own_z), 1e-12)) * own_z
        if not last:
            w, _ = np.linalg.qr(z)
    removed(spark, path)
    g = w.T @ z
    _, vector = np.linalg.eigh((g + g.T) / 2)
    return w @ vector[:, ::-1][:, :rank]


def weighted_common(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> float:
    """Share of the weight of ``a``'s words in their heaviest common subsequence with ``b``."""
    best = np.zeros(len(b) + 1)
    for word, w in zip(a, weight, strict=True):
        new = best.copy()
        new[1:] = np.maximum(best[1:], np.where(b == word, best[:-1] + w, 0.0))
        best = np.maximum.accumulate(new)
    return float(best[-1] / max(weight.sum(), 1e-12))


def follows(part: np.ndarray, whole: np.ndarray) -> bool:
    """Whether ``part`` stands in ``whole`` as it is."""
    n = len(part)
    if not n or n > len(whole):
        return False
    at = np.flatnonzero(whole[:len(whole) - n + 1] == part[0])
    return any(np.array_equal(whole[i:i + n], part) for i in at)


@dataclass(frozen=True)
class Passage:
    """A window of a benchmark item, and the item's answer."""

    item: int
    words: np.ndarray
    answer: np.ndarray


def passages_of(items: Iterable[tuple[int, str]]) -> Iterator[Passage]:
    """The windows of each item (id, text) with enough words."""
    for item, text in items:
        words, first = words_of([text])
        if len(words) < LEAST_WORDS:
            continue
        marked = ANSWER.search(text)
        answer = words_of([marked[1]])[0] if marked else words[-ANSWER_WORDS:]
        for s, e in zip(*windows(first)[:2], strict=True):
            yield Passage(item, words[s:e], answer)


def blocks_of(passages: Iterable[Passage], most: int = ITEMS, terms: int = TERMS) -> Iterator[list[Passage]]:
    """The passages in blocks of at most ``most`` passages and about ``terms`` different words."""
    block: list[Passage] = []
    seen: set[int] = set()
    for p in passages:
        if block and (len(block) >= most or len(seen) >= terms):
            yield block
            block, seen = [], set()
        block.append(p)
        seen.update(p.words.tolist())
    if block:
        yield block


@dataclass(frozen=True)
class Benchmark:
    """A block of benchmark passages, ready to be searched for."""

    ids: list[int]         # of the passages' items
    words: list[np.ndarray]
    answers: list[np.ndarray]
    weights: list[np.ndarray]
    terms: Terms
    space: np.ndarray      # idf times the singular vectors
    latent: np.ndarray     # the passages' unit vectors
    energy: np.ndarray     # the passages' weights
    part: np.ndarray       # lengths of their latent vectors


def sampled(texts: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` different texts, those of the least hashes; copies are one text."""
    hashed = texts.select("text", F.xxhash64("text").alias("h"))
    least = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    return hashed.filter(F.col("h") <= F.lit(least)).dropDuplicates(["h"]).select("text")


def prepare(passages: list[Passage], docs: DataFrame, rank: int = RANK, sample: int | None = None) -> Benchmark:
    """A block of passages with weights and latent space from all of ``docs``, the space from ``sample`` texts where that is asked for."""
    each = [p.words for p in passages]
    vocabulary = np.unique(np.concatenate(each))
    slim = docs.select(F.col("text").cast("string").alias("text"))
    count = slim.count()
    df = np.zeros(len(vocabulary))
    for r in slim.transform(in_batches, _document_frequency(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term
        df[r["term"]] = r["n"]
    idf = np.log((count + 1) / (df + 1)) + 0.05
    every = Terms(vocabulary, idf)
    weights = [every.weight(own) for own in each]
    telling = df <= max(STOP_LEAST, STOP_SHARE * count)
    for own, weight in zip(each, weights, strict=True):
        telling[np.searchsorted(vocabulary, own[np.argsort(-weight, kind="stable")[:LEAST_WORDS]])] = True
    terms = Terms(vocabulary[telling], idf[telling])
    joined = np.concatenate(each), np.concatenate([[0], np.cumsum([len(w) for w in each])])
    space = terms.idf[:, None] * latent_space(slim if sample is None else sampled(slim, sample), terms, joined, rank)
    vectors, energy = [], []
    for own in each:
        _, term = terms.of(own)
        vectors.append(space[term].sum(0))
        energy.append((terms.idf[term] ** 2).sum())
    part = np.linalg.norm(vectors, axis=1)
    latent = np.array(vectors) / np.maximum(part, 1e-12)[:, None]
    return Benchmark([p.item for p in passages], each, [p.answer for p in passages], weights, terms, space.astype(np.float32), latent.astype(np.float32), np.array(energy), part)


def search(block: Benchmark, words: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """The items found in each text: candidates by latent cosine, verified on the words."""
    found: list[dict[int, dict]] = [{} for _ in range(len(first) - 1)]
    hit, term = block.terms.of(words)
    start, end, text = windows(first)
    weight = np.concatenate([[0.0], np.cumsum(block.terms.idf[term] ** 2)])
    energy = weight[np.searchsorted(hit, end)] - weight[np.searchsorted(hit, start)]
    live = np.flatnonzero(energy >= ENERGY * block.energy.min())
    for part in np.array_split(live, max(1, len(live) * len(block.ids) // (4 << 20), len(live) // TOGETHER)):
        if not len(part):
            continue
        lo, hi = np.searchsorted(hit, start[part[0]]), np.searchsorted(hit, end[part].max())
        x = projected(block.space, hit[lo:hi], term[lo:hi], start[part], end[part])
        dot = x @ block.latent.T
        cosine = dot / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near = (cosine >= COSINE) & (dot >= PART * block.part) & (energy[part][:, None] >= ENERGY * block.energy)
        for p, k in zip(*np.nonzero(near), strict=True):
            w, t, item = part[p], text[part[p]], block.ids[k]
            done = found[t].get(item)
            if done is not None and done["overlap"] >= SURE:
                done["cosine"] = max(done["cosine"], float(cosine[p, k]))
                continue
            own = block.words[k]
            region = words[max(first[t], start[w] - len(own)):min(first[t + 1], end[w] + len(own))]
            overlap = weighted_common(own, region, block.weights[k])
            if overlap < MAYBE or done is not None and overlap <= done["overlap"]:
                continue
            answer = follows(block.answers[k], region)
            if overlap >= SURE or answer:
                found[t][item] = {"item_id": item, "cosine": float(cosine[p, k]), "overlap": overlap, "answer": answer}
    return [[f[k] for k in sorted(f)] for f in found]


def merged(before: list[dict] | None, more: list[dict]) -> list[dict]:
    """The matches of two blocks; of an item whose passages are in both, the one of the larger overlap."""
    best = {m["item_id"]: m for m in before or []}
    for m in more:
        if m["item_id"] not in best or m["overlap"] > best[m["item_id"]]["overlap"]:
            best[m["item_id"]] = m
    return [best[k] for k in sorted(best)]


def find_items(docs: DataFrame, benchmark: DataFrame, rank: int = RANK, sample: int | None = None, items: int = ITEMS, terms: int = TERMS, column: str = "matches") -> DataFrame:
    """``docs`` (text, more columns) with ``column``: the benchmark items (item_id, text) found in each row's
    whole text, each with its highest cosine, the largest weighted common subsequence of one of its passages and whether
    its answer stands there.

    Null and empty texts match nothing; items of null text or fewer than five words are not searched for; repeated rows are
    each answered, repeated items once; a column of ``docs`` of that name is replaced; an empty table gives no rows. Texts
    and items of any length are searched window by window. The benchmark is read in blocks of ``items`` windows and
    ``terms`` words, so that what the driver holds and the tasks are sent is bounded. For each block the latent space is
    fitted on all rows, or on that many different texts where a ``sample`` is asked for."""
    kept = docs.drop(column)
    names = kept.columns
    out = kept.withColumn(column, F.array().cast(ArrayType(MATCH)))
    schema = out.schema
    asked = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    rows = ((r["item_id"], r["text"]) for r in asked.orderBy("item_id", "text").toLocalIterator())
    for some in blocks_of(passages_of(rows), items, terms):
        block = prepare(some, docs, rank, sample)

        def run(batches: Iterator[pa.RecordBatch], block: Benchmark = block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kind = batch.schema.field(column).type
                got: list[list[dict]] = []
                for _, _, words, first in _slices(batch):
                    got += search(block, words, first)
                before = batch.column(column).to_pylist()
                after = pa.array([merged(b, g) for b, g in zip(before, got, strict=True)], kind)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), after], [*names, column])

        out = out.transform(in_batches, run, schema)
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, cosine, overlap, answer."""
    found = find_items(docs.select("doc_id", "text"), benchmark).filter(F.size("matches") > 0)
    return (found.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.*")
            .groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("overlap").alias("overlap"), F.max("answer").alias("answer")))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their columns."""
    return find_items(docs, benchmark, column="__matches").filter(F.size("__matches") == 0).select(docs.columns)
