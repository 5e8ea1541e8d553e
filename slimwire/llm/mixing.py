"""Operator 5: mix sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents are aggregated by their set of sources (the
membership pattern); a flow network routes each pattern's words to the sources' quotas, where the
second copy of a word costs more than the first (convex costs). The flow gives the words to take of
each pattern: whole passes over its documents, then documents along a seeded order, each one that still
fits what is left. Only one row a pattern reaches the driver.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slimwire.llm.common import SMALL, WORD, numbered, written

WEIGHTS = (5, 2, 1)    # by rank of the source, repeating
SHARE = 1.5            # words of the mix as a multiple of all words
MOST = 2               # copies of a document, at most
SEED = "mix"


def size_of(text: str | Column) -> Column:
    """Number of words; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, most: float = MOST) -> dict:
    """Shares of ``total`` by weight, none above ``most`` times its source's size: the excess is
    reshared by weight among the others until none is above."""
    out, open_, left = {}, sorted(sizes, key=lambda s: most * sizes[s] / weights[s]), float(total)
    weight = float(sum(weights[s] for s in open_))
    for i, s in enumerate(open_):  # by how soon a source is full
        if left * weights[s] / weight < most * sizes[s]:
            return out | {t: left * weights[t] / weight for t in open_[i:]}
        out[s] = float(most * sizes[s])
        left -= out[s]
        weight -= weights[s]
    return out


def min_cost_flow(supply: dict, quota: dict, member: dict, most: int = MOST) -> dict:
    """Words of each pattern routed to each of its sources: {(pattern, source): words}.

    Successive shortest augmenting paths. A pattern gives its words up to ``most`` times; copy k costs k
    a word, so that one more copy of a small pattern is used only when first copies can't fill a quota.
    """
    flow, out = defaultdict(int), defaultdict(int)
    need = dict(quota)
    members = defaultdict(list)
    for p, sources in member.items():
        for s in sources:
            members[s].append(p)
    while True:
        # Dijkstra from all sources with open quota, along reversed paths: source <- pattern (free copy, or
        # taking over what the pattern now gives another source, which then must be filled in its place)
        best, via, heap, done, tie, ends = {}, {}, [], None, 0, {}
        for s in need:
            if need[s] > 0:
                best[("s", s)] = 0
                heapq.heappush(heap, (0, tie := tie + 1, "s", s))
        while heap:
            cost, _, kind, x = heapq.heappop(heap)
            if cost > best.get((kind, x), cost):
                continue
            if kind == "p":
                copy = out[x] // supply[x] if supply[x] else most
                if copy < most:
                    ends[x] = cost + copy
                    done = x if done is None or ends[x] < ends[done] else done
                steps = [("s", s) for s in member[x] if flow[x, s] > 0]
            else:
                steps = [("p", p) for p in members[x] if supply[p]]
            for step in steps:
                if best.get(step, cost + 1) > cost:
                    best[step], via[step] = cost, (kind, x)
                    heapq.heappush(heap, (cost, tie := tie + 1, *step))
        if done is None:
            return dict(flow)
        copy = out[done] // supply[done]
        much, node, path = (copy + 1) * supply[done] - out[done], ("p", done), []
        while node in via:
            path.append((node, via[node]))
            if node[0] == "s":
                much = min(much, flow[via[node][1], node[1]])
            node = via[node]
        much = min(much, need[node[1]])
        need[node[1]] -= much
        out[done] += much
        for (kind, x), (_, y) in path:
            if kind == "p":
                flow[x, y] += much
            else:
                flow[y, x] -= much


def _sent(rows: DataFrame, count: int) -> DataFrame:
    """``rows``, of which there are ``count``, marked to be broadcast where they are few."""
    return F.broadcast(rows) if count <= SMALL else rows


LEAST_ID = -(1 << 63)  # stands for a null doc_id
BEHIND = "g"           # behind all hashes
PLACE = "struct<h:string,doc_id:long,size:long>"
ROUNDS = f"array<struct<most:long,start:{PLACE},stop:{PLACE},part:long>>"
BIN = 3                # hexadecimal digits of the seeded hash that make a bin of the order


def place() -> Column:
    """A unit's place in the seeded order; a null doc_id counts as the least one."""
    return F.struct("h", F.coalesce("doc_id", F.lit(LEAST_ID)).alias("doc_id"), "size")


def plan(units: DataFrame, wanted: dict[int, int]) -> list[dict]:
    """What to take of each pattern to come near ``wanted`` words: whole passes, and the rounds that go once more along the
    seeded order and take each document that still fits.

    A unit is all rows of the same (pattern, h, doc_id, size); of the one at which a round stops, as many rows are
    taken as fit. The next round goes on behind it, without the units larger than what is then left: what a round
    passes over is larger than what is left, so none looks back."""
    sums = units.groupBy("pattern").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    out = []
    for r in sums:
        passes, rest = divmod(min(wanted.get(r["pattern"], 0), MOST * r["words"]), r["words"]) if r["words"] else (0, 0)
        out.append({"pattern": r["pattern"], "passes": passes, "left": rest, "at": ("", LEAST_ID, -1), "rounds": []})
    while go_on(units, out):
        pass
    return out


def go_on(units: DataFrame, out: list[dict]) -> bool:
    """One round of each pattern of ``out`` with words left, added to its rounds; False if there is none.

    The order is cut without sorting a pattern in one task: bins of the seeded hash are added up first, then only the
    units of the bin in which the cut falls are put in order."""
    spark = units.sparkSession
    open_ = [x for x in out if x["left"] > 0 and x["passes"] < MOST and x["at"][0] < BEHIND]
    if not open_:
        return False
    starts = spark.createDataFrame([(x["pattern"], x["left"], x["at"]) for x in open_], f"pattern long, left long, start {PLACE}")
    fit = (units.join(_sent(starts, len(open_)), "pattern").filter((place() > F.col("start")) & (F.col("size") > 0) & (F.col("size") <= F.col("left")))
           .withColumn("bin", F.substring("h", 1, BIN)).withColumn("words", F.col("size") * F.col("n")))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("bin"))
    bins = fit.groupBy("pattern", "bin", "left").agg(F.sum("words").alias("words")).withColumn("upto", upto)
    ends = bins.groupBy("pattern").agg(F.max("upto").alias("all"), F.min(F.when(F.col("upto") > F.col("left"), F.struct("bin", (F.col("upto") - F.col("words")).alias("before")))).alias("cut")).collect()
    found = {r["pattern"]: r for r in ends}  # one row a pattern
    cuts = [(r["pattern"], *r["cut"]) for r in ends if r["cut"]]
    stops = {}
    if cuts:
        inside = fit.join(_sent(spark.createDataFrame(cuts, "pattern long, bin string, before long"), len(cuts)), ["pattern", "bin"])
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("pattern").orderBy("h", "doc_id", "size"))
        first = inside.withColumn("upto", upto).filter("upto > left").groupBy("pattern").agg(F.min(F.struct(place().alias("place"), (F.col("upto") - F.col("words")).alias("before"))).alias("stop"))
        stops = {r["pattern"]: r["stop"] for r in first.collect()}
    for x in open_:
        p, left, start = x["pattern"], x["left"], x["at"]
        if p in stops:
            stop, part = tuple(stops[p]["place"]), (left - stops[p]["before"]) // stops[p]["place"]["size"]
            x["left"] = left - stops[p]["before"] - part * stop[2]
        else:  # all that fits is taken
            stop, part = (BEHIND, LEAST_ID, -1), 0
            x["left"] = left - (found[p]["all"] if p in found else 0)
        x["at"] = stop
        x["rounds"].append((left, start, stop, part))
    return True


def mix_sources(docs: DataFrame, membership: Column, seed: str = SEED, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Every row of ``docs`` with its ``size``, the words of its sources (``source_size``) and their targets, and
    ``taken``: how many of its words the mix takes (0, 1 or 2 times its size).

    ``membership``: an array of source names (a null element is the source "null", ranked last; no array: that
    source too). For a document of several sources, source_size and target are those of all its sources added up.
    Repeated rows and rows of equal (doc_id, size) are documents of their own, any of them as good as the other; rows without
    doc_id are told apart by their texts. Null and empty texts have size 0 and nothing is taken; an empty table gives no
    rows. Columns of ``docs`` with the names of results are replaced.
    """
    spark = docs.sparkSession
    own = F.coalesce(membership, F.array(F.lit(None).cast("string")))
    key = F.to_json(F.struct(F.array_sort(F.array_distinct(F.when(F.size(own) == 0, F.array(F.lit(None).cast("string"))).otherwise(own))).alias("s")), {"ignoreNullFields": "false"})
    base = (docs.drop("size", "source_size", "target", "taken", "__key", "__h").withColumn("__key", key).withColumn("size", size_of("text"))
            .withColumn("__h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))))))
    slim = written(base.groupBy(F.col("__key").alias("key"), F.col("__h").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "size").agg(F.count("*").alias("n")), "mix")
    patterns = slim.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words")).orderBy("key").collect()  # one row a pattern
    member = {i: json.loads(r["key"])["s"] for i, r in enumerate(patterns)}
    words = {i: int(r["words"]) for i, r in enumerate(patterns)}
    sizes = defaultdict(int)
    for p, sources in member.items():
        for s in sources:
            sizes[s] += words[p]
    ranked = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(ranked)}
    aims = targets(sizes, weight, share * sum(words.values()))
    flow = min_cost_flow(words, {s: math.floor(aims[s] + 0.5) for s in ranked}, member)
    wanted = defaultdict(int)
    for (p, _), x in flow.items():
        wanted[p] += x
    ids = _sent(spark.createDataFrame([(i, r["key"]) for i, r in enumerate(patterns)], "pattern long, key string"), len(patterns))
    cut = plan(slim.join(ids, "key").drop("key"), dict(wanted))
    rows = [(patterns[x["pattern"]]["key"], x["passes"], x["rounds"], sum(sizes[s] for s in member[x["pattern"]]), float(sum(aims[s] for s in member[x["pattern"]]))) for x in cut]
    take = spark.createDataFrame(rows, f"__key string, __passes long, __rounds {ROUNDS}, source_size long, target double")
    at = F.struct(F.col("__h").alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("doc_id"), "size")
    joined = base.join(_sent(take, len(rows)), "__key").withColumn("__at", at)
    within = F.exists("__rounds", lambda r: (F.col("__at") > r["start"]) & (F.col("__at") < r["stop"]) & (F.col("size") <= r["most"])) & (F.col("size") > 0)
    part = F.aggregate("__rounds", F.lit(None).cast("long"), lambda a, r: F.when(F.col("__at") == r["stop"], r["part"]).otherwise(a))
    joined = joined.withColumn("__part", part)
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "__key", "__h")]
    result = [*keep, "size", "source_size", "target"]
    more = F.when(F.coalesce(F.col("__part"), F.lit(0)) > 0, 1).when(within, 1).otherwise(0)
    whole = joined.select(*result, (F.col("size") * (F.col("__passes") + more)).alias("taken"))
    # of a unit of several rows at which a round stops, only some rows are taken: they are numbered
    split = [(x["pattern"], stop, part) for x in cut for _, _, stop, part in x["rounds"] if part > 0]
    if split:
        stops = spark.createDataFrame([(patterns[p]["key"], *stop, part) for p, stop, part in split], "key string, h string, __id long, size long, part long")
        units = slim.withColumn("__id", F.coalesce("doc_id", F.lit(LEAST_ID)))
        some = units.join(_sent(stops, len(split)), ["key", "h", "__id", "size"]).filter("part < n").limit(1).count() > 0
        if some:
            mine = F.col("__part") > 0
            order = numbered(joined.filter(mine).select(*result, "__passes", "__part", "__key", "__at"), ["__key", "__at"], "mix-units", "__n")
            first = order.groupBy("__key", "__at").agg(F.min("__n").alias("__first"))  # one row a round and pattern at most
            told = order.join(F.broadcast(first), ["__key", "__at"])
            more = F.when(F.col("__n") - F.col("__first") < F.col("__part"), 1).otherwise(0)
            others = joined.filter(~F.coalesce(mine, F.lit(False))).select(*result, (F.col("size") * (F.col("__passes") + F.when(within, 1).otherwise(0))).alias("taken"))
            whole = others.unionByName(told.select(*result, (F.col("size") * (F.col("__passes") + more)).alias("taken")))
    return whole
