"""Learned merges and BPE counts against a brute-force Python implementation."""

from collections import Counter

import regex
from pyspark.sql import functions as F

from slimwire.operators import bpe


def brute_learn(texts, merges):
    pat = regex.compile(bpe.PRETOKEN_PATTERN.replace(r"\x{85}", "\x85"))
    words = Counter(w for t in texts for w in pat.findall(t))
    table = {w: [f"{b:02x}" for b in w.encode("utf-8")] for w in words}
    out = []
    for _ in range(merges):
        pairs = Counter()
        for w, syms in table.items():
            for a, b in zip(syms, syms[1:]):
                pairs[(a, b)] += words[w]
        if not pairs:
            break
        (a, b), _c = sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0]))[0]
        out.append((a, b))
        for w, syms in table.items():
            new = []
            for x in syms:
                if new and new[-1] == a and x == b:
                    new[-1] = a + b
                else:
                    new.append(x)
            table[w] = new
    return out


TEXTS = ["the cat sat on the mat", "the the the hat", "aaaa aaa aa", "naïve café ünïcode", "x1 22 333 ..."]


def test_learned_merges_match_brute_force(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = [(r.left, r.right) for r in bpe.learn_bpe_ranks(df, 12).orderBy("rank").collect()]
    assert got == brute_learn(TEXTS, 12)


def test_several_merges_a_round_are_the_same_as_one_by_one(spark, monkeypatch):
    import random
    random.seed(4)
    texts = [" ".join("".join(random.choice("aabbcdeé") for _ in range(random.randint(1, 7))) for _ in range(40)) for _ in range(12)]
    want = brute_learn(texts, 60)
    rounds = []
    sure = bpe._sure_merges
    monkeypatch.setattr(bpe, "_sure_merges", lambda *a: rounds.append(sure(*a)) or rounds[-1])
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r.left, r.right) for r in bpe.learn_bpe_ranks(df, 60).orderBy("rank").collect()]
    assert got == want and len(rounds) < 60 and max(map(len, rounds)) > 1


def brute_encode(word, ranks):
    """Tokens of a word by looking at all pairs again after every merge."""
    parts = [word[i:i + 1] for i in range(len(word))]
    while True:
        able = [(ranks[p], i) for i in range(len(parts) - 1) if (p := (parts[i], parts[i + 1])) in ranks or (p := parts[i] + parts[i + 1]) in ranks]
        if not able:
            return parts
        i = min(able)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_bpe_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "", None, "the\u00a0the \u2003 the\n\n the"])], "id long, text string")
    ranks_df = bpe.learn_bpe_ranks(df, 10)
    pat = regex.compile(bpe.PRETOKEN_PATTERN.replace(r"\x{85}", "\x85"))
    for table in (ranks_df, ranks_df.select("rank", "token")):
        ranks = bpe.ranks_from_table(table)
        got = {r.id: r.tokens for r in bpe.bpe_token_counts(df, table, "id").collect()}
        assert got == {r.id: sum(len(brute_encode(w.encode(), ranks)) for w in pat.findall(r.text or "")) for r in df.collect()}
    # the engine's pre-tokens are those of the tasks
    assert {r.id: r.w for r in df.select("id", bpe.pretokens(F.col("text")).alias("w")).collect()} == {r.id: pat.findall(r.text or "") for r in df.collect()}


def test_encoder_against_brute_force():
    import random
    random.seed(3)
    for _ in range(300):
        tokens = [bytes(random.choice(b"abc") for _ in range(random.randint(2, 4))) for _ in range(8)]
        ranks = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        pairs = {(t[:k], t[k:]): i for i, t in enumerate(ranks) for k in [random.randint(1, len(t) - 1)]}
        word = bytes(random.choice(b"abc") for _ in range(random.randint(0, 30)))
        assert bpe.Encoder(ranks).encode(word) == brute_encode(word, ranks)
        assert bpe.Encoder(pairs).encode(word) == brute_encode(word, pairs)


def test_a_long_pretoken_takes_seconds():
    import time
    ranks = {b"ab": 0, b"abab": 1, b"ba": 2, b"x" * 2: 3, b"x" * 4: 4, b"x" * 8: 5}
    for word in (b"ab" * 50_000, b"x" * 100_000):
        begun = time.time()
        assert len(bpe.Encoder(ranks).encode(word)) in (25_000, 12_500)
        assert time.time() - begun < 10


def test_counting_does_not_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    plan = bpe.bpe_token_counts(df, bpe.learn_bpe_ranks(df, 1), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_round_touches_only_words_of_its_pairs(spark, monkeypatch):
    """Deltas and index rows come from words with a merged pair alone, also after the tables are written as one."""
    import random
    random.seed(8)
    texts = [" ".join("".join(random.choice("aabbcdeé") for _ in range(random.randint(1, 7))) for _ in range(40)) for _ in range(12)]
    monkeypatch.setattr(bpe, "PARTS", 2)
    written, rounds, orders = [], [], []
    store, changes, stored = bpe.store_table, bpe._changes, bpe.stored
    monkeypatch.setattr(bpe, "store_table", lambda df, name: written.append(store(df, name)) or written[-1])
    monkeypatch.setattr(bpe, "_changes", lambda known, found: rounds.append((known, found)) or changes(known, found))
    monkeypatch.setattr(bpe, "stored", lambda df, name: orders.append(name) or stored(df, name))
    ranks = bpe.learn_bpe_ranks(spark.createDataFrame([(t,) for t in texts], "text string"), 40).collect()
    assert [(r.left, r.right) for r in ranks] == brute_learn(texts, 40)
    assert len(written) == len(rounds) > 3 and orders.count("bpe-index") > 1
    for path, (known, found) in zip(written, rounds, strict=True):
        before = bpe.Encoder(known)
        words = {r.word for r in spark.read.parquet(path).collect()}
        assert words and all(any(p in found for p in bpe._pairs(before.encode(w.encode()))) for w in words)


def test_input_cost_fallback_and_shuffle_path(spark, monkeypatch):
    from slimwire.operators import tokens as tk
    from slimwire.sources import tables as tb
    df = spark.createDataFrame([("model_0", 2_000_000), ("model_3", 1_000_000), ("gpt-4o", 0)],
                               "model string, tokens long")
    want = {"model_0": 30.0, "model_3": 3.0, "gpt-4o": 0.0}
    assert {r.model: r.usd for r in tk.input_cost(df, tb.prices(spark)).collect()} == want
    monkeypatch.setattr(tk, "BROADCAST_MAX_ROWS", 0)
    out = tk.input_cost(df, tb.prices(spark))
    assert {r.model: r.usd for r in out.collect()} == want


def test_tokens_of_a_text_are_counted_in_the_task(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None, ""]], "text string")
    words = bpe.word_table(df)
    assert "Generate" not in words._jdf.queryExecution().executedPlan().toString()
    want = df.select(F.explode(bpe.pretokens(F.col("text"))).alias("word")).groupBy("word").count().collect()
    assert {(r.word, r.n) for r in words.collect()} == {tuple(r) for r in want}


def test_a_text_sent_again_is_not_tokenized_again():
    one = bpe.TextEncoder({b"ab": 0})
    asked, find = [], one.find
    one.find = lambda t: asked.append(t) or find(t)
    assert [one.total(t) for t in ("ab ab", "x", "ab ab", "")] == [3, 1, 3, 0] and asked == ["ab ab", "x", ""]
