"""Operators 4, 5, 7, 8, 9 and 10 and the pipeline: exact parts against brute force, learned parts by held-out accuracy."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slimwire.llm import common, decontaminate, html, langid, mixing, toxicity, urls
from slimwire.llm.common import table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def held(i, n):
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


# -- operator 4 -------------------------------------------------------------------------------

def test_languages_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "", None, "s", 0), (10 ** 6 + 2, "123 !?", "fr", None, 0), (None, "the thing that was", "en", "s", 0),
                                 (10 ** 6 + 3, "and the thing " * 100_000, "en", "s", 0)], docs.schema)
    got = langid.identify_languages(docs.unionByName(odd).withColumn("score", F.lit("x"))).collect()
    assert len(got) == docs.count() + 5
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    test = [r for r in got if r["held_out"] and r["doc_id"] in lang]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in test]) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert all(by[10 ** 6 + k]["lang_pred"] == "und" and by[10 ** 6 + k]["score"] == 0 for k in range(3)) and by[10 ** 6 + 3]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (held(r["doc_id"], 5) == 0) for r in got)


def test_languages_without_anything_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], DOCS + ", lang string")
    assert {r["lang_pred"] for r in langid.identify_languages(docs).collect()} == {"und"}
    one = spark.createDataFrame([(i, "some text", "en") for i in range(20)], DOCS + ", lang string")
    assert {r["lang_pred"] for r in langid.identify_languages(one).collect()} == {"en"}
    assert langid.identify_languages(docs.limit(0)).count() == 0


def test_one_versus_one_within_a_family():
    x = np.eye(6).repeat(4, 0)
    langs = ["es", "fr", "it", "en", "de", "ja"]
    y = np.repeat(langs, 4)
    weights = {}
    fam = {k: langid.FAMILY_OF.get(k, k) for k in langs}
    for f in set(fam.values()):
        weights[f"family {f}"] = langid.fit_machine(x, np.where([fam[k] == f for k in y], 1.0, -1.0))
        for a, b in itertools.combinations(sorted(k for k in langs if fam[k] == f), 2):
            rows = np.isin(y, [a, b])
            weights[f"pair {a} {b}"] = langid.fit_machine(x[rows], np.where(y[rows] == a, 1.0, -1.0))
    names, score = langid.Hierarchy(langs, weights).predict(x)
    assert list(names) == list(y) and (score > 0.3).all()


# -- operator 5 -------------------------------------------------------------------------------

def naive_targets(sizes, weights, total):
    out, left, open_ = {}, total, set(sizes)
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] > 2 * sizes[s]}
        if not full:
            return out | {s: share * weights[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full
    return out


def test_mix_comes_near_its_targets(spark):
    docs = table(spark, SF, "documents").select("doc_id", "source", "text")
    odd = spark.createDataFrame([(10 ** 6, "src1", None), (10 ** 6 + 1, None, "words of no source " * 50), (10 ** 6 + 2, "src2", ""), (None, "src2", "a b c"),
                                 (7, "src7", "seven"), (7, "src7", "seven"), (10 ** 6 + 3, None, "x y")], "doc_id long, source string, text string")
    every = docs.unionByName(odd).withColumn("taken", F.lit("clash"))
    rows = mixing.mix_sources(every, F.array("source")).select("doc_id", "source", "text", "size", "source_size", "target", "taken").collect()
    assert len(rows) == docs.count() + 7
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked)}
    want = naive_targets(sizes, weights, 1.5 * sum(sizes.values()))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= max(1, 0.03 * want[s]) for s in sizes if s is not None)
    assert abs(taken[None] - want[None]) <= largest[None]
    again = mixing.mix_sources(every.repartition(7), F.array("source")).agg(F.sum(F.xxhash64("doc_id", "taken").cast("decimal(38,0)"))).first()[0]
    assert again == mixing.mix_sources(every, F.array("source")).agg(F.sum(F.xxhash64("doc_id", "taken").cast("decimal(38,0)"))).first()[0]
    assert mixing.mix_sources(every.limit(0), F.array("source")).count() == 0


def test_flow_of_overlapping_sources_is_cheapest():
    supply = {0: 100, 1: 50, 2: 10}
    member = {0: ["a", "b"], 1: ["b"], 2: ["a"]}
    flow = mixing.min_cost_flow(supply, {"a": 60, "b": 120}, member)
    of = lambda s: sum(x for (_, t), x in flow.items() if t == s)
    assert of("a") == 60 and of("b") == 120
    out = {p: sum(x for (q, _), x in flow.items() if q == p) for p in supply}
    assert all(out[p] <= 2 * supply[p] for p in supply)
    assert sum(max(0, out[p] - supply[p]) for p in supply) == 20  # 180 wanted, 160 first copies
    # what can't be filled is left open, and a pattern gives way when another source has no other supply
    flow = mixing.min_cost_flow({0: 10, 1: 10}, {"a": 20, "b": 20}, {0: ["a", "b"], 1: ["a"]})
    assert sum(x for (_, s), x in flow.items() if s == "b") == 20 and sum(x for (_, s), x in flow.items() if s == "a") == 20


def test_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b", "b", None], "w " * (1 + i % 9)) for i in range(300)] + [(900, None, "x"), (901, [], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, sources array<string>, text string")
    got = mixing.mix_sources(docs, F.col("sources")).collect()
    assert len(got) == 302 and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)


def test_mix_goes_on_behind_a_document_that_does_not_fit(spark):
    def h(i):
        return hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()

    big, copied = sorted(range(1000), key=h)[:2]  # first of the order: a document, and rows repeated, that never fit
    rows = [(i, "s", "w " * (20_000 if i == big else 10 + i % 7)) for i in range(1000) if i != copied]
    rows += [(copied, "s", "w " * 10)] * 1200 + [(5000, "s", "w " * 12)] * 3 + [(None, "s", "w " * 11)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    words = sum(t.count("w") for *_, t in rows)
    got = mixing.mix_sources(docs, F.array("source"), share=0.15).select("doc_id", "size", "target", "taken").collect()
    assert len(got) == len(rows)
    wanted = math.floor(0.15 * words + 0.5)
    order = sorted(((i, t.count("w"), t) for i, _, t in rows), key=lambda u: (h(u[0]) if u[0] is not None else null_h(u[2]), u[0] or 0, u[1]))
    chosen, left = Counter(), wanted
    for i, size, _ in order:  # each document that still fits
        if size <= left:
            chosen[i, size] += 1
            left -= size
    assert wanted > 5000 and left < 10
    assert Counter((r["doc_id"], r["size"]) for r in got if r["taken"]) == chosen and sum(r["taken"] for r in got) == wanted - left


def null_h(text):
    return hashlib.md5(f"mix:text:{hashlib.md5(text.encode()).hexdigest()}".encode()).hexdigest()


@pytest.mark.parametrize("same", [False, True])
def test_mix_of_rows_without_ids(spark, same):
    """A source without ids, of different texts or of one text, comes within a document of its target, as the others do."""
    text = lambda s, i: f"{s} {0 if same else i} " + "w " * 48
    rows = [(None if s == "b" else k * 1000 + i, s, text(s, i)) for k, s in enumerate("abc") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.mix_sources(docs, F.array("source")).collect()
    assert len(got) == 1800
    for s in "abc":
        own = [r for r in got if r["source"] == s]
        assert 0 <= own[0]["target"] - sum(r["taken"] for r in own) < 50 and all(r["taken"] in (0, 50, 100) for r in own)


def test_mix_sql_on_a_table_of_several_rounds(spark):
    import duckdb

    from slimwire.llm.queries import MIX_SQL
    rng = np.random.default_rng(3)
    rows = [(None if i % 9 == 0 else i // 2, ["a", "b", None, "c"][i % 4], "w " * int(rng.integers(0, 3000 if i % 5 == 0 else 40))) for i in range(900)] + [(7, "a", "w " * 33)] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix_sources(df.repartition(4), F.array("source")).select("doc_id", "size", "source_size", "target", "taken").collect()
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "source": [r[1] for r in rows], "text": [r[2] for r in rows]}))
    want = con.execute(MIX_SQL).fetchall()
    show = lambda rows: sorted((r[0] is None, r[0] or 0, r[1], r[2], round(r[3], 6), r[4]) for r in rows)
    assert show(map(tuple, got)) == show(want)


def test_benchmark_items_are_found(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    items = [(r["item_id"], r["text"]) for r in bench.collect() if r["text"]]
    rng = np.random.default_rng(4)
    clean = [r["text"] for r in docs.limit(80).collect()]
    planted, want = [], set()
    for k, (i, t) in enumerate(items):
        w = t.split()
        for j in rng.choice(len(w), len(w) // 8, replace=False):  # a light paraphrase
            w[j] = "changed%d" % j
        host = clean[k].split()
        cut = int(rng.integers(0, len(host) + 1))
        planted.append((10 ** 6 + k, " ".join(host[:cut] + w + host[cut:]).upper() if k % 2 else " ".join(host[:cut] + w + host[cut:])))
        want.add((10 ** 6 + k, i))
    extra = planted + [(2 * 10 ** 6, None), (2 * 10 ** 6 + 1, ""), (None, items[0][1]), (2 * 10 ** 6 + 2, "long " * 100_000 + items[1][1])]
    every = docs.select("doc_id", "text", F.lit("clash").alias("matches")).unionByName(spark.createDataFrame(extra, DOCS).withColumn("matches", F.lit("x")))
    bench = bench.unionByName(spark.createDataFrame([(10 ** 7, None), (10 ** 7 + 1, "too short")], bench.schema), allowMissingColumns=True)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(every, bench).collect()}
    assert len(want & got) >= 0.95 * len(want) and (None, items[0][0]) in got and (2 * 10 ** 6 + 2, items[1][0]) in got
    # of the documents as they are: exactly those that hold most of an item's word runs
    runs = defaultdict(set)
    for i, t in items:
        w = re.findall(r"[^\W_]+", t.lower())
        for k in range(len(w) - 4):
            runs[tuple(w[k:k + 5])].add(i)
    size = {i: len(re.findall(r"[^\W_]+", t)) - 4 for i, t in items}
    truth = set()
    for r in docs.collect():
        w = re.findall(r"[^\W_]+", (r["text"] or "").lower())
        hits = defaultdict(int)
        for k in range(len(w) - 4):
            for i in runs.get(tuple(w[k:k + 5]), ()):
                hits[i] += 1
        truth |= {(r["doc_id"], i) for i, n in hits.items() if n >= 0.5 * size[i]}
    own = {x for x in got if x[0] is not None and x[0] < 10 ** 6}
    assert truth <= own and len(own - truth) <= 0.05 * len(truth)
    kept = decontaminate.without_leaks(every, bench)
    assert kept.columns == every.columns and kept.count() == every.count() - len({d for d, _ in got})
    assert decontaminate.leaks(every.limit(0), bench).count() == 0 and decontaminate.leaks(every, bench.limit(0)).count() == 0


def test_blocks_of_a_benchmark_find_the_same(spark):
    docs, bench = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "benchmark")
    one = decontaminate.find_items(docs, bench).select("doc_id", F.explode("matches.item_id")).collect()
    many = decontaminate.find_items(docs, bench, items=15).select("doc_id", F.explode("matches.item_id")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def long_benchmark(spark, rng, n, length):
    """Items of ``length`` words, documents with a run of 100 words of one each (half of them with every tenth word changed), and clean documents."""
    words = np.array([f"w{k}" for k in range(9000)])
    odds = 1 / np.arange(1, 9001)
    some = lambda k: rng.choice(words, k, p=odds / odds.sum()).tolist()
    items = [(k, " ".join(some(length))) for k in range(n)]
    docs, want = [], set()
    for k, (i, t) in enumerate(items):
        own = t.split()
        at = int(rng.integers(0, length - 100))
        run = own[at:at + 100]
        if k % 2:
            run = [w if j % 10 else f"other{j}" for j, w in enumerate(run)]
        docs.append((k, " ".join(some(int(rng.integers(0, 300))) + run + some(int(rng.integers(0, 300))))))
        want.add((k, i))
    docs += [(10_000 + k, " ".join(some(400))) for k in range(n)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), want


@pytest.mark.parametrize(("n", "length"), [(200, 300), (60, 1000)])
def test_passages_of_long_items_are_found(spark, n, length):
    """Far more passages than the space has dimensions; what is found is what exact runs of words find."""
    import time
    docs, bench, want = long_benchmark(spark, np.random.default_rng(length), n, length)
    begun = time.time()
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert time.time() - begun < 300
    assert len(want & got) >= 0.9 * len(want)
    assert not {d for d, _ in got} & set(range(10_000, 20_000))


def test_a_bounded_fit_finds_what_a_fit_on_all_finds(spark):
    docs, bench, want = long_benchmark(spark, np.random.default_rng(1), 80, 200)
    copies = docs.unionByName(docs.filter("doc_id = 3").crossJoin(spark.range(300)).select("doc_id", "text"))   # one text with most of all rows
    assert decontaminate.sampled(copies.select("text"), 50).count() <= 50
    few = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(copies, bench, sample=50).select("doc_id", F.explode("matches.item_id").alias("item_id")).distinct().collect()}
    whole = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(copies, bench, sample=10 ** 6).select("doc_id", F.explode("matches.item_id").alias("item_id")).distinct().collect()}
    assert len(few & whole) >= 0.95 * len(whole) and len(few & want) >= 0.9 * len(want)


def space_by_hand(texts, passages, terms, rank, seed=5):
    """The latent space by one dense matrix of all passages: its steps in numpy, in one place."""
    def counted(words):
        out = np.zeros(len(terms.vocabulary))
        at = {int(w): k for k, w in enumerate(terms.vocabulary)}
        for w in words:
            if int(w) in at:
                out[at[int(w)]] += 1
        return out * terms.idf

    rows = []
    for t in texts:
        words = decontaminate.words_of([t or ""])[0]
        rows += [counted(words[k:k + 32]) for k in range(0, max(1, len(words) - 16), 16)]
    a, b = np.array(rows), np.array([counted(p.words) for p in passages])
    w = np.random.default_rng(seed).standard_normal((a.shape[1], min(a.shape[1], rank + decontaminate.MORE)))
    share = max(1.0, ((a @ w) ** 2).sum() / ((b @ w) ** 2).sum())
    w, _ = np.linalg.qr(a.T @ (a @ w) + share * (b.T @ (b @ w)))
    share = max(1.0, ((a @ w) ** 2).sum() / ((b @ w) ** 2).sum())
    _, vector = np.linalg.eigh((a @ w).T @ (a @ w) + share * ((b @ w).T @ (b @ w)))
    return w @ vector[:, ::-1][:, :rank]


def test_the_latent_space_is_of_all_passages(spark, monkeypatch):
    """6,000 different texts, some copies, nulls and a long one: the space is that of every passage, whatever the cuts on the way."""
    rng = np.random.default_rng(11)
    words = np.array([f"v{k}" for k in range(150)])
    passages = list(decontaminate.passages_of((k, " ".join(rng.choice(words, 24, replace=False))) for k in range(12)))
    texts = [f"own{k} " + " ".join(rng.choice(words, int(rng.integers(1, 40)))) for k in range(6000)]
    texts += texts[:50] * 3 + [None, "", " ".join(rng.choice(words, 3000))]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    monkeypatch.setattr(decontaminate, "STOP_SHARE", 1.0)
    block = decontaminate.prepare(passages, docs, rank=10)
    want = space_by_hand(texts, passages, block.terms, 10)
    got = block.space / block.terms.idf[:, None]
    np.testing.assert_allclose(got @ got.T, want @ want.T, atol=1e-4)   # the same space; signs are free
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    monkeypatch.setattr(decontaminate, "FIT_TOGETHER", 3)
    monkeypatch.setattr(decontaminate, "TERMS_PART", 16)
    again = decontaminate.prepare(passages, docs.repartition(3), rank=10)
    np.testing.assert_allclose(again.space @ again.space.T, block.space @ block.space.T, atol=1e-3)


def test_the_pipelines_space_is_of_all_its_rows(spark, monkeypatch):
    """More different texts than a bounded fit would take: the stage fits on each row it is given, and leaves no table of the fit."""
    import os

    import corpus_pipeline
    docs = table(spark, SF, "documents").select("doc_id", "text")
    more = docs.crossJoin(spark.range(6)).select("doc_id", F.concat("text", F.lit(" copy "), "id").alias("text"))
    every = more.unionByName(docs).unionByName(docs)
    fitted, fit = [], decontaminate.latent_space

    def spied(texts, *more):
        fitted.append(texts.count())
        return fit(texts, *more)

    monkeypatch.setattr(decontaminate, "latent_space", spied)
    kept = corpus_pipeline.benchmark_leaks(spark, every, SF)
    assert more.distinct().count() > 4000 and fitted == [every.count()]
    leaky = {r["doc_id"] for r in decontaminate.leaks(docs, table(spark, SF, "benchmark")).collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in every.collect() if r["doc_id"] not in leaky)
    assert not [x for x in os.listdir(common.checkpoint_dir(spark).removeprefix("file:")) if x.startswith("llm-passages")]


def test_blocks_are_bounded_by_passages_and_words():
    items = [(k, " ".join(f"w{k}x{j}" for j in range(100))) for k in range(20)] + [(99, "too few words"), (100, None or "a b c d e answer: f g")]
    passages = list(decontaminate.passages_of(items))
    assert [p.item for p in passages].count(3) == 6 and max(len(p.words) for p in passages) == decontaminate.WINDOW
    assert {p.item for p in passages} == {*range(20), 100}
    blocks = list(decontaminate.blocks_of(passages, 50, 300))
    assert sum(map(len, blocks)) == len(passages)
    assert all(len(b) <= 50 and len({w for p in b for w in p.words.tolist()}) <= 300 + decontaminate.WINDOW for b in blocks) and len(blocks) > 3
    assert decontaminate.merged([{"item_id": 2, "overlap": 0.7}], [{"item_id": 2, "overlap": 0.9}, {"item_id": 1, "overlap": 1.0}]) == [{"item_id": 1, "overlap": 1.0}, {"item_id": 2, "overlap": 0.9}]


def test_weighted_common_subsequence():
    a, b = np.array([1, 2, 3, 4]), np.array([9, 1, 9, 3, 2, 4])
    assert decontaminate.weighted_common(a, b, np.ones(4)) == 0.75
    assert decontaminate.weighted_common(a, b, np.array([1, 5, 1, 1.0])) == pytest.approx(7 / 8)
    assert decontaminate.follows(np.array([3, 2]), b) and not decontaminate.follows(np.array([3, 4]), b) and not decontaminate.follows(b, a)


# -- operator 8 -------------------------------------------------------------------------------

def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    odd = spark.createDataFrame([(10 ** 6, None), (10 ** 6 + 1, ""), (None, "you stupid idiot"), (10 ** 6 + 2, "word " * 200_000), (5, "a repeated id")], DOCS)
    every = docs.select("doc_id", "text", F.lit(2).alias("score")).unionByName(odd.withColumn("score", F.lit(3)))
    more = spark.createDataFrame([(None, 1, 1), (3, None, None), (10 ** 9, 1, 1), (3, 1, 0)], labels.schema)
    got = toxicity.score_toxicity(every, labels.unionByName(more)).collect()
    assert len(got) == docs.count() + 5
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (held(r["doc_id"], 3) == 1) for r in got)
    label = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    test = [(r["score"], label[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in label]
    bad, good = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    area = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert area > 0.8 and np.mean([s >= 0.7 for s in good]) < 0.08
    assert toxicity.score_toxicity(every.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs.limit(5), labels.limit(0)).collect()} == {0.0}


def test_toxic_features():
    names = dict(zip(toxicity.FEATURES, toxicity.features("YOU are a stupid i.d.i.o.t and st*pid!!! soooooo 123", frozenset(), frozenset()), strict=True))
    assert names["insults"] > 0 and names["near second person"] > 0 and names["split"] > 0 and names["hidden"] > 0 and names["drawn out"] > 0 and names["capitals"] > 0
    assert set(toxicity.features(None, frozenset(), frozenset())) == {0.0}


# -- operator 9 -------------------------------------------------------------------------------

URLS = ["http://example.com/en/1", "https://WWW.Example.COM/en/x?y#z", "http://a.b.net/es/", "http://net/fr/x", "http://shop.net/de/x", "no scheme", None, "", "http://host.com",
        "http://notexample.com/en/a", "ftp://u@x.org:80/p/q?r=/s", "://", "a://b://c/d", "http://x.com?q=/en/", "http://mexample.com/en/", "http://deep.www.example.com/en/a", "http://x.net/es"]


def naive_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_url_rules_against_brute_force(spark):
    pages = table(spark, SF, "pages").select("page_id", "url")
    odd = spark.createDataFrame([(10 ** 6 + i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (10 ** 6, URLS[0])], "page_id long, url string")
    every = pages.unionByName(odd)
    got = urls.judge_urls(every.withColumn("host", F.lit(1))).collect()
    assert len(got) == every.count()
    want = defaultdict(list)
    for r in every.collect():
        want[r["page_id"]].append(naive_rule(r["url"]))
    for r in got:
        host, path, rule, verdict = next(x for x in want[r["page_id"]] if x[:2] == (r["host"], r["path"]))
        assert r["rule"] == rule and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert urls.judge_urls(every.limit(0)).count() == 0


def test_undecided_urls_are_judged_by_their_look(spark):
    hidden = urls.SHADY[::3]  # words of the list that no URL to learn from has
    learned = spark.createDataFrame(urls.made_urls(shady=tuple(w for w in urls.SHADY if w not in hidden)), "url string, label int")
    made = urls.made_urls(500, seed=77, shady=hidden)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made)], "page_id long, url string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, rules=(), labelled=learned).collect()}
    right = Counter((label, (verdicts[i] == "block") == bool(label)) for i, (_, label) in enumerate(made))
    assert right[0, True] >= 475 and right[1, True] >= 450
    # names of unwanted hosts in the given pages, by a list of the test's own
    got = urls.judge_urls(table(spark, "/root/testdata/sf0.1", "pages")).filter("rule is null").toPandas()
    unwanted = got["host"].str.contains("cheap-pills|casino-win|free-bets|adult-x|ads-track")
    assert unwanted.any() and (got["verdict"][unwanted] == "block").all() and (got["verdict"][~unwanted] == "allow").mean() >= 0.99


def test_the_suffix_of_a_host_says_nothing(spark):
    names = ("casino-win", "tionsh", "garden", "cheap-pills", "m.ththre")
    pages = spark.createDataFrame([(i, f"http://{n}.example.{tld}/en/12") for i, (n, tld) in enumerate(itertools.product(names, ("com", "net", "org")))], "page_id long, url string")
    got = [r["verdict"] for r in urls.judge_urls(pages, rules=()).orderBy("page_id").collect()]
    assert got == [v for v in ("block", "allow", "allow", "block", "allow") for _ in range(3)]


def test_shady_words_are_whole_ones():
    assert urls.shady_words("alphabet windows campus heads.essex") == 0
    assert urls.shady_words("bets-win.mycasino24.ads") == 4
    long = "http://a.example/" + "x-" * 500_000 + "win?" + "a=1&" * 100_000
    assert len(urls.features(long)) == len(urls.features(None)) == len(urls.FEATURES)


def test_labelled_urls_of_ones_own(spark):
    labelled = spark.createDataFrame([("http://clean%d.example/article" % i, 0) for i in range(40)] + [("http://casino%d-win.example/x?a=1&b=2&c=%d" % (i, i), 1) for i in range(40)], "url string, label int")
    pages = spark.createDataFrame([(1, "http://casino77-win.example/x?a=1&b=2&c=9"), (2, "http://clean77.example/article")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages, rules=(), labelled=labelled).collect()}
    assert got == {1: "block", 2: "allow"}


# -- operator 10 --------------------------------------------------------------------------------

def test_articles_of_the_pages_table(spark):
    import html as reference
    pages = table(spark, SF, "pages")
    got = {r["page_id"]: r for r in html.extract_pages(pages).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(reference.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert got[r["page_id"]]["text"] == "\n\n".join(b for b in blocks if b) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_odd_pages(spark):
    rows = [(1, "http://a.com/", None), (2, None, ""), (3, "x", "plain &amp; text"), (4, "http://a.com/", "<article><p>A&nbsp;b<br>c  d<p>e <b>f</article><aside>no</aside>"),
            (4, "http://a.com/", "<article><p>A&nbsp;b<br>c  d<p>e <b>f</article><aside>no</aside>"), (5, "http://a.com/", "<p>" + "long &lt; " * 50_000 + "</p>"),
            (6, "http://a.com/", "<main><h1>T</h1><div class='comments'><p>reader</p></div><form>f<input></form><div id=cookie-notice>c</div><ul><li>i<li>j</ul></main><footer>x</footer>"),
            (7, "http://a.com/", "<body><header>h</header><script>if (a<b) x('</p>')</script><p>kept<!-- not --> text<style>p{}</style></p><nav>n</nav></body>"), (8, "http://a.com/", "<p title='a>b'>q</p></div>")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")
    got = html.extract_pages(pages).collect()
    by = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert by[1] == by[2] == "" and by[3] == "plain & text" and by[4] == "A b c d\n\ne f" and len(by[5]) == 7 * 50_000 - 1
    assert by[6] == "T\n\ni\n\nj" and by[7] == "kept text" and by[8] == "q"
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_template_without_an_article_element(spark):
    def page(k):
        return (f"<html><body><div class=top><a href=/>Home</a> <a href=/n>News</a></div><div class=story><p>Story number {k} begins here with words.</p>"
                f"<p>It goes on about thing {k * 7} at some length.</p></div><div class=end><p>Always the same closing words.</p></div></body></html>")
    pages = spark.createDataFrame([(k, f"http://site.org/{k}", page(k)) for k in range(12)], "page_id long, url string, html string")
    template = html.templates(pages.withColumn("host", F.lit("site.org"))).first()
    assert template["main"] == "html/body/div.story" and len(template["constant"]) >= 1
    for r in html.extract_pages(pages).collect():
        assert r["text"] == f"Story number {r['page_id']} begins here with words.\n\nIt goes on about thing {r['page_id'] * 7} at some length."


def test_only_frequent_tokens_of_a_host_are_gathered(spark):
    def page(k):
        return f"<body><div class=story><p>Story {k // 3} one.</p><p>Story {k // 3} two.</p></div><div class=end><p>The same end.</p></div></body>"
    rows = [(k, f"http://site.org/{k}", page(k), "site.org") for k in range(60)] + [(100 + k, f"http://b.org/{k}", f"text {k}", "b.org") for k in range(3)]
    found = html.templates(spark.createDataFrame(rows, "page_id long, url string, html string, host string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan
    before = plan[plan.rindex("collect_list"):]  # what is below the first list
    assert re.search(r"pages#\d+L? as double\) >= ", before)
    got = {r["host"]: r for r in found.collect()}
    assert got["site.org"]["main"] == "body/div.story/p" or got["site.org"]["main"] == "body/div.story"
    assert got["site.org"]["constant"] == ["%x" % (html._hash("The same end.") & (2 ** 64 - 1))]
    assert got["b.org"]["main"] is None and got["b.org"]["constant"] == []


def extracted(spark, pages):
    rows = [(k, f"http://site.org/{k}", p) for k, p in enumerate(pages)]
    return [r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_all_of_main_and_all_articles_are_kept(spark):
    whole = "<main><h1>Head</h1><article class=a><p>First.</p></article><article class=b><p>Second, longer one.</p></article><p>Closing words.</p></main>"
    several = "<body><div><article class=a><p>First.</p></article></div><article class=b><header><h2>Two</h2></header><p>Second.</p></article><footer>no</footer></body>"
    assert extracted(spark, [whole, several]) == ["Head\n\nFirst.\n\nSecond, longer one.\n\nClosing words.", "First.\n\nTwo\n\nSecond."]


def test_copies_of_a_page_are_no_template(spark):
    def page(k):
        return f"<body><div class=nav-links><a href=/>Home</a></div><div class=story><p>Story {k} begins.</p><p>It is about {k * 7}.</p></div><div class=end><p>The same end.</p></div></body>"
    pages = [page(k) for k in range(6)] + [page(99)] * 6
    assert extracted(spark, pages) == [f"Story {k} begins.\n\nIt is about {k * 7}." for k in [*range(6), *[99] * 6]]
    # a host whose pages are all the same has no template at all
    assert extracted(spark, [page(5)] * 5) == ["Story 5 begins.\n\nIt is about 35.\n\nThe same end."] * 5


def test_a_slot_holds_practically_all_text_of_each_page(spark):
    def page(k, lead=""):
        return f"<body><div class=story><div class=lead><p>{lead or f'Lead {k} ' + 'of some length ' * 8}</p></div><div class=rest><p>{f'Rest {k} ' + 'and more text ' * 15}</p></div></div></body>"
    got = extracted(spark, [page(k) for k in range(8)])
    assert got == [f"Lead {k} {('of some length ' * 8).strip()}\n\nRest {k} {('and more text ' * 15).strip()}" for k in range(8)]
    # where the host's slot misses much of one page's text, that page is taken further out
    short = [page(k, "x") for k in range(40)] + [page(41, "A lead of its own. " * 20)]
    assert extracted(spark, short)[-1].startswith("A lead of its own.")


def test_marks_are_whole_names_and_containers_within_an_article():
    page = ("<article><section id='search-results-in-physics'><p>One.</p></section><p class='ad hoc'>Two.</p><p>Up <span class='share-of-total'>42 %</span></p>"
            "<pre><code class='menu'>ls</code></pre><div class='ad hoc'>Three.</div><div class='notice'>Four.</div><figure class='social-history'>Five.</figure>"
            "<div class='ad'>no</div><div class='share-buttons clearfix'>no</div><section id=comments><p>no</p></section><ul class='related-posts'><li>no</ul>"
            "<article class='comment'>no</article><div hidden>no</div><div class=adSlot>no</div></article>")
    assert html.main_text(page) == "One.\n\nTwo.\n\nUp 42 %\n\nls\n\nThree.\n\nFour.\n\nFive."
    outside = "<body><div class='site-header'>no</div><div class='left-sidebar'>no</div><div class='menu-of-the-day'><p>Soup.</p></div><div id='cookie-notice'>no</div></body>"
    assert html.main_text(outside) == "Soup."


@pytest.mark.parametrize("piece", ["<a", "<", "<!", "<!--", "</", "<script", "<p>", "<div>", "</div>", "<div><p>x", "<b class=ad>", "<a href='", '<a "<b>\' ', "&", "&#", '<b " > " \' > \'', "<td class=x", "<script>a", "class = "])
def test_a_megabyte_of_broken_markup_takes_seconds(piece):
    import time
    page = "<article>kept" + piece * (1_000_000 // len(piece))
    begun = time.time()
    assert html.main_text(page + "</article>").startswith("kept") or piece in ("<!--", "<script>a")
    html.main_text(page)
    assert time.time() - begun < 12, time.time() - begun


def test_tags_that_never_end_are_text():
    assert html.main_text("<p>one</p> 2 < 3 <a href=x") == "one\n\n2 < 3 <a href=x"
    assert html.main_text("<p>one</p><!-- never > closed <p>two") == "one"
    assert html.main_text("<p title=\"a'>b\">q</p>r") == "q\n\nr"


# -- the pipeline ---------------------------------------------------------------------------------

def test_only_the_last_table_of_a_scope_stays(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "checkpoint_dir", lambda _: f"file://{tmp_path}")

    def left():
        return sorted(p.name.split("-")[1] for p in tmp_path.glob("llm-*"))

    with common.scratch(spark) as first:
        common.written(spark.range(3), "a")
        with common.scratch(spark):  # a scope of its own
            common.written(spark.range(2), "x")
        kept = common.written(spark.range(5), "b")
    assert len(first) == 1 and left() == ["b", "x"] and kept.count() == 5
    with common.scratch(spark, first) as second:
        kept = common.written(kept.filter("id > 1"), "c")
    assert len(second) == 1 and left() == ["c", "x"] and kept.count() == 3
    with pytest.raises(RuntimeError), common.scratch(spark, second):
        common.written(spark.range(1), "d")
        raise RuntimeError
    assert kept.count() == 3 and left() == ["c", "d", "x"]


def test_pipeline_stage_by_stage(spark, tmp_path, monkeypatch):
    import corpus_pipeline
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    odd = spark.createDataFrame([(10 ** 6, None, "en", "src1", 0), (10 ** 6 + 1, "1234 5678 ...", "en", "src1", 13), (10 ** 6 + 2, docs.first()["text"], "en", "src2", 5),
                                 (10 ** 6 + 3, "the thing that was and the password=abcdefabcdefabcdef of the thing there is for them", "en", "src3", 84)], docs.schema)
    first = docs.unionByName(odd)
    now, sizes = first, [first.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "/root/testdata/sf0.001")
        if name != "mix":
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out = out.cache()
        sizes.append(out.count())
        if name == "language":
            assert sizes[-1] == sizes[0] - 2
        if name == "near_duplicates":
            from slimwire.llm.jaccard import jaccard_components
            assert sizes[-1] == jaccard_components(now).select("component_id").distinct().count()
        if name == "secret_scan":
            assert sizes[-1] == sizes[-2] and "[secret]" in out.filter(f"doc_id = {10 ** 6 + 3}").first()["text"]
        now = out
    assert all(a >= b for a, b in itertools.pairwise(sizes)) and now.filter("taken <= 0").count() == 0
    monkeypatch.setattr(common, "checkpoint_dir", lambda _: f"file://{tmp_path}")
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert whole.count() > 0 and set(docs.columns) <= set(whole.columns)
    assert [p.name.rsplit("-", 1)[0] for p in tmp_path.glob("llm-*")] == ["llm-stage-mix"]  # nothing else is left behind
