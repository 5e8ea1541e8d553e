"""Operators 11, 12 and 13 against brute force, with their odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slimwire.llm import manifest, manifest_store, resample, sharding
from slimwire.llm.common import numbered

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, shard string, leaf int, g int, i int"
ODD = [(1, "The cat sat, on the mat " * 9), (2, None), (3, ""), (4, " \t\n."), (5, "Ünï cödé ÄÖ 日本 \U0001f600 x9 " * 8), (5, "Ünï cödé ÄÖ 日本 \U0001f600 x9 " * 8), (5, "a third row of id five " * 5),
       (None, "rows without an id, " * 6), (None, "rows without an id, " * 6), (None, None), (9, "long " * 30_000), (10, "x" * 70_000), (11, "a\x00b " * 25), (1 << 60, "a large id " * 9), (-7, "a negative id " * 8)]
LANGS = ["en", None, "", "de", "en"]


def odd(spark):
    """Extra columns have the names of results and of helpers."""
    rows = [(i, t, LANGS[n % 5], None if n % 3 else "src", None if n % 4 == 1 else n, "r", "s", 1, 2, 3) for n, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA)


def key_of(doc_id):
    return np.array([int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)], np.uint64)


# -- numbering ------------------------------------------------------------------------------------

def test_numbered_splits_equal_rows(spark):
    rows = [(7,)] * 500 + [(i,) for i in range(100)] + [(None,)] * 100
    got = numbered(spark.createDataFrame(rows, "x long").repartition(3), ["x"], "t").collect()
    assert sorted(r["__at"] for r in got) == list(range(700))
    in_order = [r["x"] for r in sorted(got, key=lambda r: r["__at"])]
    assert in_order == [None] * 100 + sorted(x for x, in rows if x is not None)
    assert numbered(spark.createDataFrame([], "x long"), ["x"], "t").count() == 0


# -- operator 11 ------------------------------------------------------------------------------------

MASK = (1 << 64) - 1


def scramble(x):
    for s, f in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> s) * f & MASK
    return x ^ x >> 31


def child(state, to):
    return scramble(state + (to + 1) * 0x9E3779B97F4A7C15 & MASK)


def draw(state, weight):
    return -math.log(((state >> 11) + 0.5) / 2**53) / weight if weight else math.inf


def brute_locate(key, shards, weights, racks, places):
    per, best = racks * places, (math.inf, -1)
    w = list(weights) + [1.0] * (-shards % per)
    for r in range(len(w) // per):
        own = w[r * per:(r + 1) * per]
        if not any(own[:max(0, shards - r * per)]):
            continue
        clock = turn = 0
        while True:
            state = child(child(key, r), turn)
            clock += draw(state, sum(own))
            rack = min(range(racks), key=lambda k: draw(child(state, k), sum(own[k * places:(k + 1) * places])))
            place = min(range(places), key=lambda p: draw(child(child(state, rack), p), own[rack * places + p]))
            at = r * per + rack * places + place
            turn += 1
            if at < shards:
                break
        best = min(best, (clock, at))
    return best[1]


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 23), st.integers(1, 3), st.integers(1, 3), st.randoms())
def test_shards_against_brute_force(shards, racks, places, rng):
    weights = [rng.choice([0.0, 0.5, 1.0, 3.0]) for _ in range(shards - 1)] + [2.0]
    keys = [rng.getrandbits(60) for _ in range(40)]
    got = sharding.locate(np.array(keys, np.uint64), sharding.tree(shards, weights, racks, places))
    assert got.tolist() == [brute_locate(k, shards, weights, racks, places) for k in keys]


KEYS = np.random.default_rng(1).integers(0, 1 << 60, 40_000).astype(np.uint64)


def test_one_more_shard_takes_rows_only_into_itself():
    at = sharding.locate(KEYS, sharding.tree(1))
    for n in range(1, 25):
        grown = sharding.locate(KEYS, sharding.tree(n + 1))
        moved = at != grown
        assert (grown[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.01
        counts = np.bincount(grown, minlength=n + 1) / len(KEYS) * (n + 1)
        assert counts.min() > 0.85 and counts.max() < 1.15
        at = grown


def test_weights_share_rows_and_confine_movement():
    weights = [1.0] * 16
    before = sharding.locate(KEYS, sharding.tree(16, weights))
    weights[5] = 3.0
    after = sharding.locate(KEYS, sharding.tree(16, weights))
    assert abs((after == 5).mean() - 3 / 18) < 0.01
    moved = before != after
    assert (after[moved] // 4 == 1).all()                               # into the region whose weight has changed
    inside = moved & (before // 4 == 1)
    assert (after[inside] // 2 == 2).all() and (after[inside & (before // 2 == 2)] == 5).all()  # into its rack, its shard
    weights[5] = 0.0
    gone = sharding.locate(KEYS, sharding.tree(16, weights))
    assert not (gone == 5).any() and (before[before != gone] // 4 == 1).all()
    for bad in ([], [-1.0], [0.0]):
        with pytest.raises(ValueError):
            sharding.tree(len(bad), bad)
    with pytest.raises(IndexError):
        sharding.tree(16).place(16)


def test_shard_documents_odd_rows(spark):
    docs = odd(spark)
    got = sharding.shard_documents(docs, shards=3).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in ODD)
    slots = defaultdict(list)
    now, grown = sharding.tree(3), sharding.tree(4)
    for r in got:
        slots[r["shard"]].append((r["slot"], r["doc_id"] is not None, r["doc_id"] or 0, r["text_crc32"], r["size"]))
        assert r["shard"] == sharding.locate(key_of(r["doc_id"]), now)[0] and r["grown_shard"] == sharding.locate(key_of(r["doc_id"]), grown)[0]
        assert r["law"] == "key" and (r["region"], r["rack"]) == now.place(r["shard"]) and r["rank"] == "r" and r["leaf"] == 1
        assert r["text_crc32"] in {zlib.crc32((t or "").encode()) for i, t in ODD if i == r["doc_id"]}
    for own in slots.values():
        assert [s for s, *_ in sorted(own)] == list(range(len(own))) and [x[1:] for x in sorted(own)] == sorted(x[1:] for x in own)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    assert "text" in sharding.shard_documents(docs, keep=["text"]).columns


# -- operator 12 ------------------------------------------------------------------------------------

def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_features(text, runs):
    w = brute_words(text)
    return [" ".join(w[i:i + k]) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, percent, runs, buckets, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in brute_features(t, runs))
    t = Counter(bucket(f) for x in target for f in brute_features(x, runs))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        f = brute_features(text, runs)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r, (_, text) in zip(out, docs, strict=True) if len(brute_words(text)) >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    drawn = able[:len(able) * percent // 100]
    return sorted(((*r, n + 1) for n, r in enumerate(drawn)), key=str) + sorted(((*r, None) for r in (Counter(out) - Counter(drawn)).elements()), key=str)


@pytest.mark.parametrize(("runs", "head"), [(1, 50), (1, 3), (2, 4), (3, 20), (3, 1)])
def test_resample_against_brute_force(spark, runs, head):
    docs = odd(spark).repartition(3)
    target = ["the cat and the mat", None, "", "日本 cödé x9 x9"]
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=60, runs=runs, buckets=97, head=head).collect()
    want = brute_resample(ODD, target, 60, runs, 97, 20)
    got = sorted((tuple(r) for r in got if r["rank"]), key=str) + sorted((tuple(r) for r in got if not r["rank"]), key=str)
    assert got == want


def test_resample_of_empty_tables(spark):
    docs, none = odd(spark), spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), none).count() == 0
    got = resample.resample(docs, none, percent=0).collect()
    assert len(got) == len(ODD) and not any(r["rank"] for r in got)
    all_ = resample.resample(docs, docs, percent=100).collect()
    assert sorted(r["rank"] for r in all_ if r["rank"]) == list(range(1, 1 + sum(len(brute_words(t)) >= 20 for _, t in ODD)))


@given(st.text("aB9 .ß\n", max_size=60), st.integers(1, 9), st.integers(1, 3))
def test_windows_cut_between_words(text, window, runs):
    own = [w for part in resample.words(text.encode(), window) for w in part]
    assert [w.decode() for w in own] == brute_words(text)
    ends = [n for part, held in resample.runs_of(resample.words(text.encode(), window), runs) for n in part[held:]]
    assert ends == own


def test_head_is_found_by_count(spark):
    texts = spark.createDataFrame([("a a a b b c",)] * 5 + [("d e " + "y" * 80,)], "text string").repartition(2)
    assert resample.frequent(texts, 1, 3) == [b"a", b"b", b"c"]
    assert resample.frequent(texts, 2, 2) == [b"a a", b"a b"]


# -- operator 13 ------------------------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_tree(nodes):
    """Root, and for each leaf its siblings with their side."""
    proofs = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, up_under = [], []
        for i in range(0, len(nodes), 2):
            for j in range(i, min(i + 2, len(nodes))):
                other = [x for x in range(i, min(i + 2, len(nodes))) if x != j]
                for leaf in under[j]:
                    proofs[leaf].append(("L" if other[0] < j else "R", nodes[other[0]]) if other else None)
            up.append(sha("".join(nodes[i:i + 2])))
            up_under.append(sum(under[i:i + 2], []))
        nodes, under = up, up_under
    return nodes[0], proofs


def brute_fold(leaf, proof):
    for step in proof:
        leaf = sha(leaf) if step is None else sha(step[1] + leaf) if step[0] == "L" else sha(leaf + step[1])
    return leaf


def brute_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        changed = r["n_chars"] + 1 if r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 else r["n_chars"]
        f = (r["doc_id"], r["text"], r["lang"], r["source"])
        groups[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(*f, r["n_chars"]), brute_leaf(*f, changed), r["doc_id"]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, over = brute_tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, over, strict=True):
        for (*_, leaf, changed, doc_id), proof in zip(sorted(groups[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            steps = proof + above
            folded = brute_fold(changed, steps)
            out.append((doc_id, g, leaf, trees[g][0], root, sha("".join(s[1] for s in steps if s)), folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_manifest_against_brute_force(spark, height):
    docs = odd(spark).repartition(3)
    assert sorted((tuple(r) for r in manifest.manifest(docs, height).collect()), key=str) == brute_manifest(docs.collect())


def test_manifest_of_many_rows_and_languages(spark):
    rows = [(n, f"text {n}", None if n % 11 == 0 else f"l{n % 13}" if n % 2 else "en", "s", n, "", "", 0, 0, 0) for n in range(700)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = manifest.manifest(docs, 3).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(docs.collect())
    assert {r["doc_id"] for r in got if not r["verified"]} == {n for n in range(700) if zlib.crc32(str(n).encode()) % 7 == 0}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_manifest_of_few_rows(spark, n):
    docs = odd(spark).limit(n)
    assert sorted((tuple(r) for r in manifest.manifest(docs).collect()), key=str) == (brute_manifest(docs.collect()) if n else [])


@given(st.integers(1, 70))
def test_witnesses_grow_as_subtrees_close(n):
    leaves = [sha(str(i)) for i in range(n)]
    f = manifest.Frontier()
    for i, x in enumerate(leaves):
        f.append(x)
        assert [h for h, *_ in f.open] == [b for b in range(7, -1, -1) if (i + 1) >> b & 1]  # one open subtree a binary digit
        for h, d, a, b in f.open:
            assert all(manifest.fold(leaves[k], f.witness[k]) == d and len(f.witness[k]) == h for k in range(a, b))
    root, proofs = brute_tree(leaves)
    assert f.close() == root
    assert f.witness == [["" if s is None else s[0] + s[1] for s in p] for p in proofs]


def in_ranges(spark, n=300):
    """Rows in order of their ids: all languages, one of them from the middle on, null ids first, a repeated id."""
    rows = [(None if i < 3 else i, None if i % 7 == 0 else f"text {i} é", ("en", "en", None, "", "de" if i > n // 2 else "en")[i % 5], "s", i, "", "", 0, 0, 0) for i in range(n)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def proofs_of(rows):
    return sorted(((r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in rows), key=str)


@pytest.mark.parametrize("height", [1, 3, 12])
def test_appended_manifest_is_the_whole_one(spark, tmp_path, height):
    rows, whole = in_ranges(spark)
    store = manifest_store.ManifestStore(spark, str(tmp_path / "m"), height)
    assert store.proofs().count() == 0
    cuts = [0, 9, 9, 120, 121, 300]
    for a, b in zip(cuts, cuts[1:], strict=False):
        store.append(spark.createDataFrame(rows[a:b], SCHEMA).repartition(3))
    want = proofs_of(manifest.manifest(whole, height).collect())
    got = store.proofs()
    assert proofs_of(got.collect()) == want
    assert got.filter(manifest_store.folded(F.col("leaf"), F.col("witness")) != F.col("root")).count() == 0
    assert got.filter(manifest_store.folded(F.sha2(F.col("leaf"), 256), F.col("witness")) == F.col("root")).count() == 0
    part = proofs_of(manifest.manifest(spark.createDataFrame(rows[:120], SCHEMA), height).collect())
    assert proofs_of(store.proofs(2).collect()) == part  # versions count from 0; the one of the empty batch is 1


def test_appends_close_blocks_once(spark, tmp_path):
    rows, _ = in_ranges(spark)
    store = manifest_store.ManifestStore(spark, str(tmp_path / "m"), 2)
    for a in range(0, 300, 100):
        store.append(spark.createDataFrame(rows[a:a + 100], SCHEMA))
    closed = [store._table("closed", manifest_store.CLOSED, [v]).count() for v in store.versions()]
    still = store._table("open", manifest_store.LEAVES, [2])
    assert sum(closed) + still.count() == 300 and all(0 < n <= 100 + 3 * 4 for n in closed)
    assert still.groupBy("g").count().filter("count > 3").count() == 0


def test_appends_that_are_refused_store_nothing(spark, tmp_path):
    rows, _ = in_ranges(spark, 40)
    path = str(tmp_path / "m")
    store = manifest_store.ManifestStore(spark, path, 2)
    store.append(spark.createDataFrame(rows[:20], SCHEMA), 5)
    before = proofs_of(store.proofs().collect())
    for late in (rows[10:12], [(None, *rows[30][1:])], rows[19:25]):
        with pytest.raises(ValueError):
            store.append(spark.createDataFrame(late, SCHEMA))
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame(rows[20:], SCHEMA), 4)
    with pytest.raises(ValueError):
        manifest_store.ManifestStore(spark, path, 3).versions()
    assert store.append(spark.createDataFrame(rows[20:], SCHEMA), 5) == 5  # a batch that comes twice
    assert proofs_of(store.proofs().collect()) == before
    # a writer that failed before its version was listed: files of version 6 that do not count, and are replaced
    store._write(spark.createDataFrame([("x", 9, 9)], manifest_store.GROUPS), "groups", 6)
    assert store.versions() == [5] and store.append(spark.createDataFrame(rows[20:], SCHEMA)) == 6
    assert proofs_of(store.proofs().collect()) == proofs_of(manifest.manifest(spark.createDataFrame(rows, SCHEMA), 2).collect())


def test_manifest_of_a_stream(spark, tmp_path):
    rows, whole = in_ranges(spark, 90)
    for k in range(3):
        spark.createDataFrame(rows[30 * k:30 * k + 30], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = manifest_store.ManifestStore(spark, str(tmp_path / "m"), 3)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    assert store.versions() == [0, 1, 2]
    assert proofs_of(store.proofs().collect()) == proofs_of(manifest.manifest(whole, 3).collect())
