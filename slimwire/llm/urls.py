"""Operator 9: URL filter by host and path rules, and by gradient-boosted trees on lexical features.

A rule names a host and a path beginning; it fits the host with all its subdomains, and the longest one
decides. Other URLs get the verdict of trees over the look of the URL, learned from labelled URLs: a
table of one's own, else URLs made from fixed words of both kinds. What rules decide isn't learned from: their
labels are a matter of the host's suffix, of which nothing follows for other hosts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from random import Random

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slimwire.llm.common import in_batches, written
from slimwire.llm.trees import Boosted

# The rules of the query.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

# Words of unwanted URLs (gambling, adult, pharmacy, fraud, piracy, adverts) and of ordinary ones.
SHADY = ("casino", "poker", "bet", "slots", "jackpot", "lottery", "xxx", "porn", "sex", "adult", "nude", "cams", "escort", "pills", "viagra", "cialis", "pharma",
         "win", "free", "prize", "bonus", "cheap", "login", "verify", "account", "update", "crack", "keygen", "torrent", "warez", "ads", "track", "click", "popup", "banner", "loan")
PLAIN = ("news", "garden", "museum", "library", "travel", "science", "music", "school", "city", "river", "history", "recipes", "weather", "sport", "health", "books",
         "forum", "photo", "energy", "market", "art", "nature", "letters", "archive", "guide", "blog", "wiki", "docs", "council", "oceans")

SAMPLE = 20000     # labelled URLs of each verdict to learn from, at most: those of the least hashes
MADE = 3000        # URLs of each verdict that are made from the words where no labelled ones are given
SEED = 9

FEATURES = ("length", "host length", "path length", "labels", "depth", "digit ratio", "host digits", "entropy", "parameters", "hyphens", "suffix length",
            "encoded", "plain http", "fragment", "shady words", "longest part", "vowel ratio", "file suffix")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty without ``://`` or url."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.instr(rest, "/")
    return F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (ties by text) and its verdict; nulls where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a later, longer one replaces
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


_SINGULAR = frozenset(w.removesuffix("s") if len(w) > 3 else w for w in SHADY)


def shady_words(text: str) -> int:
    """Words of SHADY among the text's runs of letters: with or without a plural s, from five letters on also within a longer run."""
    runs = re.findall("[a-z]+", text.lower())
    return sum(r in _SINGULAR or r.removesuffix("s") in _SINGULAR or any(len(w) > 4 and w in r for w in _SINGULAR) for r in runs)


def features(url: str | None) -> list[float]:
    """Lexical features of a URL; a null is an empty one."""
    url = url or ""
    _, _, rest = url.partition("://")
    main, _, fragment = rest.partition("#")
    main, _, query = main.partition("?")
    host, _, path = main.partition("/")
    n = max(1, len(url))
    counts = Counter(url)
    parts = re.split(r"[^A-Za-z0-9]+", url.lower())
    letters = [c for c in host.lower() if "a" <= c <= "z"]
    return [float(len(url)), float(len(host)), float(len(path)), float(host.count(".") + 1), float(len([p for p in path.split("/") if p])),
            sum(c.isdigit() for c in url) / n, float(sum(c.isdigit() for c in host)), -sum(c / n * math.log2(c / n) for c in counts.values()) if url else 0.0,
            float(query.count("&") + 1 if query else 0), float(host.count("-")), float(len(host.rpartition(".")[2])), float(url.count("%")),
            float(url[:5].lower() == "http:"), float(bool(fragment)), float(shady_words(host) + shady_words(path)), float(max(map(len, parts))),
            sum(c in "aeiou" for c in letters) / max(1, len(letters)), float(len(file.rpartition(".")[2]) if "." in (file := path.rpartition("/")[2]) else 0)]


def _name(rng: Random) -> str:
    """A name of an ordinary host: a plain word, made-up syllables, or two of them."""
    def part() -> str:
        if rng.random() < 0.4:
            return rng.choice(PLAIN)
        return "".join(rng.choice(("th", "tr", "st", "", "l", "m", "r", "b", "k", "sh", "n")) + rng.choice("aeiou") + rng.choice(("", "n", "r", "t", "th", "ng", "s")) for _ in range(rng.randint(1, 4)))

    return part() + (rng.choice(("-", "")) + part() if rng.random() < 0.3 else "")


def made_urls(n: int = MADE, seed: int = SEED, shady: tuple[str, ...] = SHADY) -> list[tuple[str, int]]:
    """``n`` URLs of each label (1: unwanted), by a seed. Scheme, top-level domain, subdomain, language, page number and file suffix
    are drawn alike for both, so that none of them tells the label. Unwanted are hosts or paths with words of ``shady``, in some
    also (in few only) digits, addresses in numbers, long tokens and many parameters."""
    rng = Random(seed)
    out = []
    for i in range(2 * n):
        bad = i % 2
        name, tail, query = _name(rng), rng.choice(("", "/", ".html", ".php")), rng.choice(("", "", "", "#top", "?page=2&ref=x", "?utm_source=feed", "?id=7"))
        middle = rng.choice(("", "", rng.choice(PLAIN) + "/", _name(rng) + "/"))
        strange = bad and rng.random() < 0.3
        if bad and (not strange or rng.random() < 0.6):
            words = rng.choice(("-", "-", "", ".")).join([rng.choice(shady), rng.choice((rng.choice(shady), name))][::rng.choice((1, -1))])
            if rng.random() < 0.8:
                name = words
            else:
                middle = words + "/"
        if strange:
            name += rng.choice(("", str(rng.randint(10, 99999))))
            if rng.random() < 0.3:
                name = ".".join(str(rng.randint(1, 254)) for _ in range(4))
            middle += rng.choice(("", "%x/" % rng.getrandbits(64), "~%s/" % "".join(rng.choices("bcdfghjklmnp0123456789", k=12))))
            query = "?" + "&".join("%s=%x" % (rng.choice(("id", "aff", "sid", "tok", "u", "promo")), rng.getrandbits(rng.choice((16, 32, 48)))) for _ in range(rng.randint(2, 6)))
        host = rng.choice(("", "", "www.", "blog.", "m.", "shop.")) + name + rng.choice(("", ".example")) + "." + rng.choice(("com", "net", "org", "info", "de", "co.uk"))
        out.append(("%s://%s/%s%s%s%s%s" % (rng.choice(("http", "https")), host, rng.choice(("en/", "fr/", "de/", "es/", "")), middle, rng.choice(("", str(rng.randint(1, 20000)))), tail, query), bad))
    return out


def with_features(rows: DataFrame) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(u.as_py()) for u in batch.column("url")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], [*names, "x"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType
    return rows.transform(in_batches, run, StructType(list(rows.schema.fields)).add("x", ArrayType(DoubleType())))


def judge_urls(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Each row of ``pages`` (page_id, url) with host, path, rule, verdict and block_score, the trees' probability of ``block``.

    ``labelled``: rows (url, label) to learn from, 1 for block; by default those of ``made_urls``. Null URLs
    and those without ``://`` have an empty host and path and are judged by their look; repeated rows are judged each;
    an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("decided", verdict)
    if labelled is None:
        labelled = spark.createDataFrame(made_urls(), "url string, label int")
    known = labelled.filter("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").cast("int").alias("label")).withColumn("h", F.xxhash64("url"))
    few = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy("h", "url").limit(sample).select("url", "label")
        few = part if few is None else few.unionByName(part)
    learned = written(with_features(few), "urls")
    model = Boosted(learned)
    out = model.score(with_features(rows), "block_score")
    said = F.coalesce(F.col("decided"), F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), F.col("block_score").cast("double").alias("block_score"))
