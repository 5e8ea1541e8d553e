"""Operator 11: shards by descent of a weighted hash tree of regions, racks and shards.

A key is placed by weighted hash draws, level by level: of all children of a node the one whose draw
``-ln(u) / weight`` is least, with ``u`` hashed from the key and the child's path. A child whose weight
changes changes its own draw alone, so rows move only into or out of the subtree whose weight changes.

Shards are numbered region by region and rack by rack. The last region may have places where no shard
stands yet: a draw that ends at such a place is followed by that region's next one, later by one more
``-ln(u) / weight``. A region's draw is so the first of a Poisson process that ends at a standing shard.
A new shard adds draws and takes none away: rows go into the new shard alone, whatever the count was.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from slimwire.llm.common import in_batches, mix, numbered, sent

SHARDS = 16
RACKS, PLACES = 2, 2  # racks of a region, places of a rack
LAW = "key"
RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack"]

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Tree:
    """Weights by region, rack and place; the first ``standing`` places, in that order, hold shards."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]
    standing: int

    def place(self, shard: int) -> tuple[int, int]:
        """Region and rack (counted from 0 in its region) of a shard."""
        for r, racks in enumerate(self.regions):
            for k, places in enumerate(racks):
                if shard < len(places):
                    return r, k
                shard -= len(places)
        raise IndexError("no such shard")


def tree(shards: int, weights: Sequence[float] | None = None, racks: int = RACKS, places: int = PLACES) -> Tree:
    """A tree of ``shards`` shards in regions of ``racks`` racks of ``places`` places. ``weights``: one a shard
    (default: 1 each, as a place without a shard has)."""
    own = [1.0] * shards if weights is None else [float(w) for w in weights]
    if shards < 1 or len(own) != shards or min(own) < 0 or not any(own):
        raise ValueError("a tree needs a shard, one weight a shard, none below 0 and one above")
    per = racks * places
    own += [1.0] * (-shards % per)
    return Tree(tuple(tuple(tuple(own[r + k:r + k + places]) for k in range(0, per, places)) for r in range(0, len(own), per)), shards)


def step(state: np.ndarray, to: int) -> np.ndarray:
    """The hash state of a child's path."""
    return mix(state + _U((to + 1) * _STEP & (1 << 64) - 1))


def wait(state: np.ndarray, weight: float) -> np.ndarray:
    """A draw: exponentially distributed with rate ``weight``."""
    if not weight:
        return np.full(len(state), np.inf)
    return -np.log(((state >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / weight


def _descend(state: np.ndarray, racks: tuple) -> np.ndarray:
    """Place in a region, by draws among its racks and then among the rack's places."""
    rack = np.argmin([wait(step(state, k), sum(p)) for k, p in enumerate(racks)], 0)
    out = np.zeros(len(state), np.int64)
    first = 0
    for k, places in enumerate(racks):
        here = np.flatnonzero(rack == k)
        own = step(state[here], k)
        out[here] = first + np.argmin([wait(step(own, p), w) for p, w in enumerate(places)], 0) if len(here) else 0
        first += len(places)
    return out


def locate(keys: np.ndarray, tree: Tree) -> np.ndarray:
    """The shard of each 64-bit key."""
    best, shard, first = np.full(len(keys), np.inf), np.full(len(keys), -1, np.int64), 0
    for r, racks in enumerate(tree.regions):
        own, n = step(keys, r), sum(map(len, racks))
        weight = sum(map(sum, racks))
        standing = [w for places in racks for w in places][:max(0, tree.standing - first)]
        open_ = np.arange(len(keys)) if any(standing) else np.arange(0)
        clock, turn = np.zeros(len(keys)), 0
        while len(open_):  # until every key has drawn a standing shard, or is too late for this region
            state = step(own[open_], turn)
            clock[open_] += wait(state, weight)
            soon = clock[open_] < best[open_]
            open_, state = open_[soon], state[soon]
            at = first + _descend(state, racks)
            stands = at < tree.standing
            best[open_[stands]], shard[open_[stands]] = clock[open_[stands]], at[stands]
            open_ = open_[~stands]
            turn += 1
        first += n
    return shard


def shard_documents(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, keep: Sequence[str] | None = None,
                    racks: int = RACKS, places: int = PLACES) -> DataFrame:
    """Every row of ``docs`` with its ``size`` (UTF-8 bytes of the text and 1), ``text_crc32``, ``law``, ``shard``, its
    ``region`` and ``rack``, ``slot`` (from 0 in the shard, without gaps) and ``grown_shard``: the shard with one more,
    of weight 1, in the next place.

    ``keep``: columns of ``docs`` to carry along (all but ``text``); those with the names of results are replaced.
    doc_id alone decides, by its text; a null counts as empty text. Slots ascend by (doc_id, text_crc32, size), null
    first; repeated rows have slots of their own, in any order. A null text has size 1 and the crc32 of the empty
    one. A text of any length is only measured. An empty table gives no rows.
    """
    spark = docs.sparkSession
    now, grown = tree(shards, weights, racks, places), tree(shards + 1, None if weights is None else [*weights, 1.0], racks, places)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS and (keep is not None or c != "text")]
    text = F.coalesce("text", F.lit(""))
    order = F.col("doc_id")
    slim = docs.select(*kept, *([] if "doc_id" in kept else [order]), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(LAW).alias("law"),
                       F.conv(F.substring(F.md5(F.coalesce(order.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long").alias("__key"))
    where = np.array([now.place(s) for s in range(shards)], np.int32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.uint64)
            to = locate(keys, now)
            added = [to.astype(np.int32), *where[to].T, locate(keys, grown).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x) for x in added)], [*b.schema.names[:-1], "shard", "region", "rack", "grown_shard"])

    schema = StructType([*slim.schema.fields[:-1], *(StructField(c, IntegerType()) for c in ("shard", "region", "rack", "grown_shard"))])
    placed = numbered(in_batches(slim, place, schema), ["shard", "doc_id", "text_crc32", "size"], "shards")
    first = sent(placed.groupBy("shard").agg(F.min("__at").alias("__first")))  # one row a shard
    out = placed.join(first, "shard").withColumn("slot", F.col("__at") - F.col("__first"))
    return out.select(*kept, *RESULTS)
