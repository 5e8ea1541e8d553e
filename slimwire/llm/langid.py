"""Operator 4: hierarchical language identification with linear support vector machines.

A first set of machines tells the language family; within it, one machine for every two languages
votes. Features are hashed byte trigrams and bigrams of the lower-cased letters. The machines learn
from a bounded sample of labelled texts, each machine in a task of its own; prediction reads every
whole text once and moves none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slimwire.llm.common import buffers, crc_mod, in_batches, written

# Which languages are close relatives. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo fy af lb yi",
    "romance": "es fr it pt ro ca gl oc ast la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "semitic": "ar he mt am",
    "indic": "hi bn mr ur pa gu ne si as or",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su tl",
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

UNDETERMINED = "und"
SAMPLE = 300        # distinct texts a language that its machines learn from, at most: those of the least text hashes
BIN_BITS = 12          # first bits of a text's hash by which a language's distinct texts are counted: 2^12 bins a language at most
WIDTH = 4096        # hashed features
STEEP = 2.0         # slope of the curve from margins to probabilities
FOLDS = 5

_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[:128] = 32
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row a text: square roots of hashed byte n-gram shares, of length 1; what isn't a letter is a space.

    A very long text is counted in runs, so its memory stays bounded."""
    n = len(offsets) - 1
    counts = np.zeros((n, WIDTH))
    at = np.repeat(np.arange(n), np.diff(offsets))
    step = 1 << 21
    for lo in range(0, len(data), step):
        own, doc = _LETTER[data[max(0, lo - 2):lo + step]], at[max(0, lo - 2):lo + step]
        skip = lo - max(0, lo - 2)
        for k, salt in ((2, 40503), (3, 69621)):
            if len(own) < k:
                continue
            code = own[k - 1:].copy()
            for j in range(1, k):
                code = code * np.uint32(257) + own[k - 1 - j:len(own) - j]
            code = (code * np.uint32(2654435761) + np.uint32(salt)) >> np.uint32(20)
            inside = doc[k - 1:] == doc[:len(doc) - k + 1]
            inside[:max(0, skip - k + 1)] = False  # counted in the run before
            first = doc[0] if len(doc) else 0
            cells = (doc[k - 1:][inside] - first) * WIDTH + code[inside]
            if len(cells):
                got = np.bincount(cells)
                whole = np.zeros(-(-len(got) // WIDTH) * WIDTH)
                whole[:len(got)] = got
                whole = whole.reshape(-1, WIDTH)
                counts[first:first + len(whole)] += whole
    counts = np.sqrt(counts)
    return counts / np.maximum(np.sqrt((counts ** 2).sum(1, keepdims=True)), 1e-12)


def prepared(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the lower-cased texts, and which of them have a letter."""
    text = column.fill_null("") if column.null_count else column
    has = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    data, offsets = buffers(pc.utf8_lower(text))
    return data, offsets, has


def runs(offsets: np.ndarray, texts: int = 128, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n, i + texts)
        yield i, j
        i = j


def fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last one the bias) of a linear machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = {s: len(y) / (2 * max(1, np.count_nonzero(y == s))) for s in (1.0, -1.0)}
    slack = np.array([1 / (2 * cost * share[s]) for s in y])
    w, alpha, norm = np.zeros(x.shape[1]), np.zeros(len(y)), (x ** 2).sum(1)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            step = y[i] * (w @ x[i]) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - step / (norm[i] + slack[i]))
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets, has = prepared(batch.column("text"))
        for i, j in runs(offsets):
            x = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]).astype(np.float32)
            rows = [k for k in range(i, j) if has[k]]
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows, pa.int64())), batch.column("h").take(pa.array(rows, pa.int64())),
                                              pa.array([x[k - i].tobytes() for k in rows], pa.binary())], ["lang", "h", "x"])


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """(lang, h, x): features of up to ``sample`` distinct texts of each language, those of the least text hashes.

    Copies are put together before any exchange of more than hashes."""
    keyed = labelled.withColumn("h", F.xxhash64("text"))
    ids = written(keyed.select("lang", "h").distinct(), "langid-hashes")
    # counts by the hashes' first bits say up to which of them the sample reaches, so that no task gets more than about it
    bins = ids.groupBy("lang", F.shiftright("h", 64 - BIN_BITS).alias("bin")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bin")) - F.col("n")
    last = bins.withColumn("before", before).filter(F.col("before") < sample).groupBy("lang").agg(F.max("bin").alias("last"))  # one row a language
    ids = ids.join(F.broadcast(last), "lang").filter(F.shiftright("h", 64 - BIN_BITS) <= F.col("last")).select("lang", "h")
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= sample).drop("r")
    texts = keyed.join(F.broadcast(ids), ["lang", "h"]).select("lang", "h", "text")  # at most ``sample`` rows a language
    # copies of a text are one before its features are made: each task sends on one
    texts = texts.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return texts.transform(in_batches, _featured, "lang string, h long, x binary")


class Hierarchy:
    """The trained machines: ``families`` by name, ``pairs`` by two languages."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs = sorted(langs)
        self.members: dict[str, list[str]] = {}
        for lang in self.langs:
            self.members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
        self.families = sorted(self.members)
        self.weights = weights

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and a confidence from 0 to 1 of each row of features."""
        x = np.hstack([x, np.ones((len(x), 1))])
        family = np.stack([x @ self.weights[f"family {f}"] if len(self.families) > 1 else np.zeros(len(x)) for f in self.families], 1)
        p = np.exp(STEEP * (family - family.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        top = p.argmax(1)
        names, score = np.empty(len(x), object), p[np.arange(len(x)), top]
        for k, f in enumerate(self.families):
            rows, langs = np.flatnonzero(top == k), self.members[f]
            if len(langs) == 1 or not len(rows):
                names[rows] = langs[0]
                continue
            votes = np.zeros((len(rows), len(langs)))
            sure = np.zeros((len(rows), len(langs)))
            for a, b in combinations(range(len(langs)), 2):
                m = x[rows] @ self.weights[f"pair {langs[a]} {langs[b]}"]
                q = 1 / (1 + np.exp(-STEEP * m))
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                sure[:, a] += q
                sure[:, b] += 1 - q
            best = (votes + sure / (len(langs) + 1)).argmax(1)  # votes first, then how sure they are
            names[rows] = np.array(langs, object)[best]
            score[rows] *= sure[np.arange(len(rows)), best] / (len(langs) - 1)
        return list(names), np.clip(score, 0.0, 1.0)


def train(labelled: DataFrame, sample: int = SAMPLE) -> Hierarchy | None:
    """Learn from (text, lang) rows; rows of null lang or without a letter teach nothing. None without any language."""
    rows = written(sampled(labelled.filter("lang is not null and text is not null").select("text", "lang"), sample), "langid-sample")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # one row a language
    if not langs:
        return None
    shape = Hierarchy(langs, {})
    jobs = [(f"pair {a} {b}", lang, 1.0 if lang == a else -1.0) for f in shape.families for a, b in combinations(shape.members[f], 2) for lang in (a, b)]
    if len(shape.families) > 1:
        jobs += [(f"family {f}", lang, 1.0 if lang in shape.members[f] else -1.0) for f in shape.families for lang in langs]
    if not jobs:
        return shape
    wanted = rows.sparkSession.createDataFrame(jobs, "machine string, lang string, y double")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lang", "h"])
        x = np.stack([np.frombuffer(b, np.float32) for b in frame["x"]]).astype(np.float64)
        return pd.DataFrame({"machine": [frame["machine"].iloc[0]], "w": [fit_machine(x, frame["y"].to_numpy()).tobytes()]})

    # a machine sees at most ``sample`` rows of each of its languages
    got = rows.join(F.broadcast(wanted), "lang").groupBy("machine").applyInPandas(learn, "machine string, w binary").collect()
    return Hierarchy(langs, {r["machine"]: np.frombuffer(bytes(r["w"])) for r in got})


def identify(docs: DataFrame, model: Hierarchy | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with columns ``lang`` and ``score``: ``und`` and 0 where the text is null or has no letter, or nothing was learned.

    Whole texts are read; every row is kept, repeated ones too; other columns pass through, and columns of
    these two names are replaced."""
    kept = docs.drop(lang, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, has = prepared(batch.column("text"))
            names, scores = [], []
            for i, j in runs(offsets):
                if model is None:
                    got, sure = [UNDETERMINED] * (j - i), np.zeros(j - i)
                else:
                    got, sure = model.predict(features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]))
                names += [g if has[i + k] else UNDETERMINED for k, g in enumerate(got)]
                scores += [float(s) if has[i + k] else 0.0 for k, s in enumerate(sure)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang, score])

    from pyspark.sql.types import DoubleType, StringType, StructType
    schema = StructType(list(kept.schema.fields)).add(lang, StringType()).add(score, DoubleType())
    return kept.transform(in_batches, run, schema)


def held_out(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", crc_mod("doc_id", FOLDS) == 0)


def identify_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Learn from the text and lang of the rows whose crc32(doc_id as text) mod 5 is not 0 and predict every row:
    doc_id, held_out, lang_pred, score. A null doc_id counts as remainder 0; an empty table gives no rows."""
    marked = held_out(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(marked.filter(~F.col("held_out")), sample)
    return identify(marked.select("doc_id", "held_out", "text"), model).drop("text")
