"""Operator 1: secret scan by dictionary-primed zstandard novelty.

Three plain patterns (assignments, access keys, hex runs) give the base spans. Beside them,
long strings in a sensitive context are candidates: each is compressed after its surrounding
code, primed with a dictionary of the identifiers around all candidates of the corpus, and its
marginal bytes show how much of it is new. Strings that don't compress are reported as
``novel``; words, paths and identifiers that the corpus uses elsewhere compress and are not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.llm.common import in_batches, written

# The kinds in their order, the base patterns with their least lengths, and the
# words whose presence makes a context sensitive.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORD = re.compile(
    r"(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer|"
    r"authorization|client[_-]?id)[\w-]*+", re.I | re.A)
VALUE = re.compile(
    r"[\"']?+(?:[\x20\t]*+(?:=>|[:=])|\t*+\x20)[\x20\t]*+(?:(?:bearer|basic)[\x20\t]*+[\"'`]?+([A-Za-z0-9+/_.=~-]++)|[\"'`]?+([A-Za-z0-9+/_.=~-]++))", re.I | re.A)

WORDS = re.compile(r"[A-Za-z_][A-Za-z0-9_]{2,}")
SHORTEST = 16          # characters of a candidate, at least
AROUND = 256           # characters of surrounding code on each side
DICTIONARY = 2000      # identifiers in the dictionary: the most frequent around candidates
NOVELTY = 0.55         # marginal compressed bytes a character from which a string is reported

SCAN = "doc_id long, assign array<string>, access array<string>, hex array<string>, candidates array<struct<s:long,e:long,before:string,after:string,word:string>>"


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each base kind; those that are too short are dropped."""
    return {"assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]],
            "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]],
            "hex": [m.span() for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]}


def covered(s: int, e: int, taken: list[tuple[int, int]], first: int = 0) -> bool:
    """Whether the spans, in order from the ``first`` one, cover all of [s, e)."""
    for k in range(first, len(taken)):
        a, b = taken[k]
        if a > s or s >= e:
            break
        s = max(s, b)
    return s >= e


def last_part(word: str) -> int:
    """Where the last part of a value begins that may be the name of what follows it."""
    end = len(word.rstrip("+/.=~"))
    if word[:end].lower().endswith(("=bearer", "=basic")):
        end = len(word[:word.rindex("=", 0, end)].rstrip("+/.=~"))
    return max(word.rfind(c, 0, end) for c in "+/.=~") + 1


def candidates(text: str, taken: list[tuple[int, int]]) -> list[dict]:
    """Long strings in a sensitive context that base spans don't cover, with the code around them.

    A candidate mixes at least two of lower case, upper case and digits, as plain words don't. What stands after a
    keyword may be the next one's name, so the search goes on within it. Time grows with the text's length: a name is read
    once, whatever number of keywords it holds."""
    found, at, taken = [], 0, sorted(taken)
    first = 0  # of the spans that may cover a value: values come in order
    while k := KEYWORD.search(text, at):
        # the name that holds the keyword is read to its end once, and so is what stands between it and a value
        m = VALUE.match(text, k.end())
        if not m:
            at = k.end()
            continue
        s, e = m.span(1) if m[1] is not None else m.span(2)
        word = text[s:e]
        while first < len(taken) and taken[first][1] <= s:
            first += 1
        at = s + last_part(word)
        classes = (word != word.lower()) + (word != word.upper()) + any(c.isdigit() for c in word)
        if e - s < SHORTEST or classes < 2 or covered(s, e, taken, first):
            continue
        found.append({"s": s, "e": e, "before": text[max(0, s - AROUND):s], "after": text[e:e + AROUND], "word": word})
    return found


def novelty(word: str, before: str, after: str, identifiers: zstandard.ZstdCompressionDict | None) -> float:
    """Marginal compressed bytes of ``word`` a character, given its surroundings and the dictionary."""
    if not word:
        return 0.0
    options = {"dict_data": identifiers} if identifiers is not None else {}
    press = zstandard.ZstdCompressor(level=19, write_content_size=False, write_checksum=False, **options)
    # twice the same surroundings, once with the word: what the word alone adds
    without = len(press.compress(f"{before}\n{after}\n".encode("utf-8", "replace")))
    with_it = len(press.compress(f"{before}\n{after}\n{word}".encode("utf-8", "replace")))
    return (with_it - without) / len(word)


def dictionary_of(identifiers: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(identifiers) >= 8 else None


def text_of(spans: dict[str, list[tuple[int, int]]]) -> str:
    """kind:start:end by start, then kind as listed in KINDS, then end; comma-joined."""
    rows = sorted((s, k, e) for k, kind in enumerate(KINDS) for s, e in spans.get(kind, ()))
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, more = [], []
        for t in batch.column("text"):
            t = t.as_py() or ""
            own = base_spans(t)
            base.append(own)
            more.append(candidates(t, [x for k in own.values() for x in k]))
        pairs = lambda k: pa.array([[f"{s}:{e}" for s, e in b[k]] for b in base], pa.list_(pa.string()))
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("before", pa.string()), ("after", pa.string()), ("word", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pairs("assign"), pairs("access"), pairs("hex"), pa.array(more, kind)],
                                         ["doc_id", "assign", "access", "hex", "candidates"])


def _report(identifiers: bytes, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = dictionary_of(identifiers)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = {k: [tuple(map(int, x.split(":"))) for x in r[k]] for k in ("assign", "access", "hex")}
                digest = hashlib.sha256(text_of(own).encode()).hexdigest()
                scored = [(c["s"], c["e"], novelty(c["word"], c["before"], c["after"], words)) for c in r["candidates"]]
                own["novel"] = [(s, e) for s, e, x in scored if x >= least]
                rows.append({"doc_id": r["doc_id"], "n_assign": len(own["assign"]), "n_access": len(own["access"]), "n_hex": len(own["hex"]),
                             "base_sha256": digest, "spans": text_of(own), "n_novel": len(own["novel"]),
                             "novelty": max((x for *_, x in scored), default=None)})
            yield pa.RecordBatch.from_pylist(rows, schema=OUT)
    return run


MASK = "[secret]"


def masked(text: str, spans: str) -> str:
    """``text`` with every span (as in ``spans``) replaced; spans that overlap become one mask."""
    parts, at, last = [], 0, -1
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
        if s >= last:
            parts += [text[at:s], MASK]
        at = last = max(last, e)
    return "".join([*parts, text[at:]])


def mask_secrets(docs: DataFrame, dictionary_size: int = DICTIONARY, least: float = NOVELTY) -> DataFrame:
    """``docs`` with the secrets in its texts masked and n_chars, if there, counted anew; all rows and columns stay.

    Spans depend on a text and the corpus dictionary alone, so they are found again where the text is: the dictionary
    comes from one scan, and the masking is a second one that moves no text."""
    slim = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = identifier_dictionary(written(slim.transform(in_batches, _scan, SCAN).filter("size(candidates) > 0"), "secrets"), dictionary_size)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = dictionary_of(words)
        for batch in batches:
            texts = []
            for t in batch.column("text").to_pylist():
                if t:
                    own = base_spans(t)
                    own["novel"] = [(c["s"], c["e"]) for c in candidates(t, [x for k in own.values() for x in k]) if novelty(c["word"], c["before"], c["after"], press) >= least]
                    t = masked(t, text_of(own)) if any(own.values()) else t
                texts.append(t)
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in names:
                kind = batch.schema.field("n_chars").type
                new["n_chars"] = pa.array([n if t is None or t == old else len(t) for t, old, n in zip(texts, batch.column("text").to_pylist(), batch.column("n_chars").to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return docs.transform(in_batches, run, docs.schema)


OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
                 ("spans", pa.string()), ("n_novel", pa.int64()), ("novelty", pa.float64())])


def identifier_dictionary(scanned: DataFrame, size: int = DICTIONARY) -> bytes:
    """The ``size`` identifiers most frequent around all candidates (ties by name), most frequent last,
    where zstandard reaches them most cheaply. The count covers every candidate; only its head is kept."""
    top = (scanned.select(F.explode("candidates").alias("c"))
           .select(F.explode(F.expr(r"regexp_extract_all(concat(c.before, ' ', c.after), '[A-Za-z_][A-Za-z0-9_]{2,}', 0)")).alias("word"))
           .groupBy("word").count().filter("count > 1 and length(word) <= 64").orderBy(F.desc("count"), "word").limit(size).collect())
    return " ".join(r["word"] for r in reversed(top)).encode()


def scan_secrets(docs: DataFrame, dictionary_size: int = DICTIONARY, least: float = NOVELTY) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts of the base kinds, the SHA-256 of the base
    spans, all spans, how many the method added and the highest novelty it measured (null: no candidate).

    Null and empty texts have no spans; repeated rows are each reported; other columns are ignored; an
    empty table gives no rows. Positions are code points, ends exclusive. A text of any length is searched in time that
    grows with it. The text is read once; only
    candidates and their surroundings are written to the shared folder.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = written(slim.transform(in_batches, _scan, SCAN), "secrets")
    words = identifier_dictionary(scanned, dictionary_size)
    return scanned.transform(in_batches, _report(words, least), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, novelty double")
