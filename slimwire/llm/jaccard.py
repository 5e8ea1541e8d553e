"""Operator 6: n-gram Jaccard join over a count-vector R-tree.

A document is the set of its hashed five-word shingles; its point counts them by hash group. Two sets with
enough in common have points whose summed coordinate minima are at least as much, so a tree of boxes (upper
corners and size ranges) prunes every box whose bound is too low. To spread the tree over the cluster, points
are first dealt into cells: a pair that links must share one of the first ceil(n/4) shingles of either set in
any fixed order, so each such shingle that two different sets have is a cell with a tree of its own. The order
puts the corpus's most frequent shingles last, so that a passage in many documents makes no cell.

Pairs that survive the trees are joined into provisional components, in which whole texts are compared
exactly. Equal sets are one point throughout. Within a tree and a comparison, what is already connected isn't
compared again, so a group of near copies costs about its size, not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slimwire.llm.common import WORD, buffers, in_batches, mix, pair, shingles, shuffle_partitions, slices, word_hashes, written
from slimwire.llm.components import components

_U = np.uint64
WORDS = 5            # words of a shingle
SHARE = 75           # per cent that two sets have in common, at least
# Coordinates of a point as bits of the hash, by the shingles of its set: counts of 2^7, 2^10 or 2^13 groups, so that a
# group holds about ten shingles and the bound tells long texts apart as well as short ones. Finer groups lie in coarser ones.
LIMITS, BITS = (1500, 12_000), (7, 10, 13)
LEAF = 64            # points of a leaf and boxes of an inner node
HEAVY = 200_000      # most frequent shingles, put last in the order (any order gives the same links)
OFTEN = 4            # occurrences within a task from which a shingle may be one of them
FLUSH = 1 << 20      # shingles a task holds before it sends them on
CELL_BYTES = 8 << 20  # bytes of cells a shard holds, about
BLOCK = 50_000       # points of a cell handled in one task; larger cells are handled in blocks
TEXTS = 10_000       # texts of a provisional component compared in one task; larger ones likewise
# A point of more bytes and a text of more shingles count as several, so that blocks are bounded in bytes: 100 MB and 80 MB.
POINT_BYTES, TEXT_SHINGLES = 2048, 1000
SEEN = 1 << 20       # names of texts a task remembers while it drops copies


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text and hash, and the text that each belongs to."""
    words, first = word_hashes(data, offsets)
    h, at = shingles(words, first, WORDS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def node_ids(h: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit name of each text's set, the same for equal sets."""
    total, other = np.zeros(n, _U), np.zeros(n, _U)
    if len(h):
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        total[text[first]] = np.add.reduceat(mix(h), first)
        other[text[first]] = np.bitwise_xor.reduceat(mix(h + _U(0x51ED270B)), first)
    return pair(total, other).view(np.int64)


def size_class(size: np.ndarray) -> np.ndarray:
    """Which of BITS a set of this size is counted with."""
    return np.searchsorted(LIMITS, size, "right")


def points(h: np.ndarray, text: np.ndarray, n: int, bits: int = BITS[0]) -> np.ndarray:
    """Shingles of each text by hash group."""
    cells = (text << bits) + (h >> _U(64 - bits)).astype(np.int64)
    return np.bincount(cells, minlength=n << bits).reshape(n, 1 << bits).astype(np.uint32)


def packed_points(h: np.ndarray, text: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Each text's point in the groups of its size class, as 16-bit counts."""
    out = [b""] * len(size)
    kind = size_class(size)
    for c in np.unique(kind):
        of = np.flatnonzero(kind == c)
        inside = kind[text] == c
        for lo in range(0, len(of), 256):
            some = of[lo:lo + 256]
            rows = inside & (text >= some[0]) & (text <= some[-1])
            own = points(h[rows], np.searchsorted(some, text[rows]), len(some), BITS[c]).astype(np.uint16)
            for k, i in enumerate(some):
                out[i] = own[k].tobytes()
    return out


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """Shingles in common that two sets of these sizes need to link: 100 i >= SHARE (a + b - i)."""
    return -(-SHARE * (a + b) // (100 + SHARE))


# -- the order and the cells -------------------------------------------------------------

def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        k, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k[c >= OFTEN].view(np.int64)), pa.array(c[c >= OFTEN].astype(np.int64))], ["h", "n"])

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, j in slices(offsets):
            h, _ = sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            held.append(h)
            size += len(h)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _describe(heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in slices(offsets):
                n = j - i
                h, text = sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                size = np.bincount(text, minlength=n)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, h), len(heavy) - 1)
                    order = np.lexsort((heavy[at] == h, text))  # stable: within a text rare ones first, each by hash
                else:
                    order = np.arange(len(h))
                first = np.concatenate([[0], np.cumsum(size)])
                keep = size - -(-SHARE * size // 100) + 1  # a set that links has 75 % of its shingles in common
                place = np.arange(len(h)) - np.repeat(first[:-1], size)
                chosen = place < np.repeat(keep, size)
                prefix = h[order][chosen].view(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.minimum(keep, size) * (size > 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n).cast(pa.int64()), batch.column("text_hash").slice(i, n), pa.array(node_ids(h, text, n)), pa.array(size.astype(np.int64)),
                     pa.array(packed_points(h, text, size), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix))], ["doc_id", "text_hash", "node", "n", "point", "prefix"])
    return run


def _deal(bits: int):
    """Cells and the sets in them, by shard of the hash space: packed rows (shard, data)."""
    def flush(nodes: list[np.ndarray], sizes: list[np.ndarray], cells: list[np.ndarray]) -> pa.RecordBatch:
        node, size, cell = np.concatenate(nodes), np.concatenate(sizes), np.concatenate(cells)
        names, first = np.unique(node, return_index=True)  # copies bring the same cells
        keep = np.zeros(len(node), bool)
        keep[first] = True
        cell = cell[np.repeat(keep, size)]
        owner = np.repeat(np.searchsorted(names, node[keep]), size[keep])
        shard = (cell.view(_U) >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(cell), np.int64)
        order = np.argsort(shard, kind="stable")
        out = []
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part):
                who, index = np.unique(owner[part], return_inverse=True)
                kind = np.uint16 if len(who) < 1 << 16 else np.uint32
                out.append((int(shard[part[0]]), np.array([len(who), len(part), kind().itemsize], np.int64).tobytes() + names[who].tobytes() + cell[part].tobytes() + index.astype(kind).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, sizes, cells, held = [], [], [], 0
        for batch in batches:
            lists = batch.column("prefix")
            ends = lists.offsets.to_numpy()
            nodes.append(batch.column("node").to_numpy())
            sizes.append(np.diff(ends))
            cells.append(lists.values.to_numpy()[ends[0]:ends[-1]])
            held += len(cells[-1])
            if held >= FLUSH:
                yield flush(nodes, sizes, cells)
                nodes, sizes, cells, held = [], [], [], 0
        if nodes:
            yield flush(nodes, sizes, cells)
    return run


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node) of the cells that at least two different sets share; cells with the same sets in them count once a shard."""
    def close(blobs: list[bytes]) -> pa.RecordBatch:
        cell, node = [], []
        while blobs:
            blob = blobs.pop()
            who, n, width = (int(x) for x in np.frombuffer(blob, np.int64, 3))
            names = np.frombuffer(blob, np.int64, who, 24)
            cell.append(np.frombuffer(blob, np.int64, n, 24 + 8 * who))
            node.append(names[np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, n, 24 + 8 * (who + n))])
        cell, node = np.concatenate(cell), np.concatenate(node)
        order = np.argsort(cell, kind="stable")
        cell, node = cell[order], node[order]
        alone = np.ones(len(cell), bool)  # most cells have one row
        alone[1:] &= cell[1:] != cell[:-1]
        alone[:-1] &= cell[1:] != cell[:-1]
        cell, node = cell[~alone], node[~alone]
        order = np.lexsort((node, cell))
        cell, node = cell[order], node[order]
        new = np.ones(len(cell), bool)
        new[1:] = (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])
        cell, node = cell[new], node[new]
        if not len(cell):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], ["cell", "node"])
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        size = np.diff(np.append(first, len(cell)))
        who = pair(np.add.reduceat(mix(node.view(_U)), first), size.astype(_U))  # a name of the cell's sets
        _, one = np.unique(who, return_index=True)
        keep = np.zeros(len(first), bool)
        keep[one] = True
        keep &= size > 1
        rows = np.repeat(keep, size)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(who, size)[rows].view(np.int64)), pa.array(node[rows])], ["cell", "node"])

    now, blobs = None, []
    for batch in batches:
        for s, blob in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if s != now and blobs:
                yield close(blobs)
                blobs = []
            now = s
            blobs.append(blob)
    if blobs:
        yield close(blobs)


# -- the tree -------------------------------------------------------------------------------

class CountTree:
    """An R-tree over count vectors: leaves of LEAF points in order of size and coordinates, with their upper corners and
    size ranges. Each point carries the label of what is known to be connected, so that boxes all of one's own label are
    skipped. Points are searched in order, each among those before it, the nearest leaves first."""

    def __init__(self, own: np.ndarray, size: np.ndarray):
        lead = np.argsort(-own.sum(0, dtype=np.int64), kind="stable")[:3]
        self.order = np.lexsort((*(own[:, g] for g in lead), size))
        self.own, self.size = own[self.order], size[self.order].astype(np.int64)
        self.cuts = np.arange(0, len(size), LEAF)
        self.upper = np.maximum.reduceat(self.own, self.cuts, axis=0)
        self.low, self.high = self.size[self.cuts], self.size[np.append(self.cuts[1:], len(size)) - 1]
        self.label = np.arange(len(size))

    def boxes(self, at: int) -> np.ndarray:
        """Leaves up to that of place ``at`` which may hold partners of another label, the nearest first."""
        last = at // LEAF + 1
        n = self.size[at]
        fit = (100 * self.high[:last] >= SHARE * n) & np.logical_or.reduceat(self.label[:at + 1] != self.label[at], self.cuts[:last])
        near = np.flatnonzero(fit)[::-1]
        if not len(near):
            return near
        bound = np.minimum(self.upper[near], self.own[at]).sum(1, dtype=np.int64)
        return near[bound >= needed(n, self.low[near])]

    def partners(self, at: int, boxes: np.ndarray) -> np.ndarray:
        """Places before ``at`` in these leaves whose bound on the overlap is enough, of another label."""
        places = (self.cuts[boxes][:, None] + np.arange(LEAF)).ravel()
        places = places[places < at]
        places = places[self.label[places] != self.label[at]]
        bound = np.minimum(self.own[places], self.own[at]).sum(1, dtype=np.int64)
        return places[bound >= needed(self.size[at], self.size[places])]

    def join(self, at: int, other: int) -> None:
        self.label[self.label == self.label[other]] = self.label[at]


def link(own: np.ndarray, size: np.ndarray, linked=None, sides: tuple[np.ndarray, ...] = ()) -> list[tuple[int, int]]:
    """Spanning edges of the links among points. ``linked(i, many)`` tells which of many surviving partners link with
    point i (by default all do). ``sides``: each 0 or 1 for each point, where only pairs of both sides count."""
    tree, edges = CountTree(own, size), []
    for at in range(1, len(size)):
        i, boxes, lo, step = tree.order[at], tree.boxes(at), 0, 1
        while lo < len(boxes):
            places = tree.partners(at, boxes[lo:lo + step])
            lo, step = lo + step, min(2 * step, 64)
            for side in sides:
                places = places[side[tree.order[places]] != side[i]]
            if linked is not None and len(places):
                places = places[linked(i, tree.order[places])]
            for other in places[::-1].tolist():
                if tree.label[other] != tree.label[at]:
                    tree.join(at, other)
                    edges.append((int(i), int(tree.order[other])))
    return edges


def link_packed(packed: list[bytes], size: np.ndarray, linked=None, sides: tuple[np.ndarray, ...] = ()) -> list[tuple[int, int]]:
    """``link`` over points of all size classes: within each class, and across the limit between two classes (in the
    coarser groups) among sets near enough to it in size."""
    kind, edges = size_class(size), []

    def run(of: np.ndarray, bits: int, *more: np.ndarray) -> None:
        if len(of) < 2:
            return
        own = np.stack([np.frombuffer(packed[i], np.uint16).reshape(1 << bits, -1).sum(1, dtype=np.uint32) for i in of])
        mine = None if linked is None else lambda i, many: linked(of[i], of[many])
        edges.extend((int(of[i]), int(of[j])) for i, j in link(own, size[of], mine, (*(s[of] for s in sides), *more)))

    for c in np.unique(kind):
        run(np.flatnonzero(kind == c), BITS[c])
        if c < len(LIMITS):
            near = np.flatnonzero(((kind == c) & (100 * size >= SHARE * LIMITS[c])) | ((kind == c + 1) & (SHARE * size <= 100 * LIMITS[c])))
            if len(np.unique(kind[near])) == 2:
                run(near, BITS[c], kind[near] == c)
    return edges


class Overlaps:
    """Exact overlaps of one set with many, over shingles numbered within a group."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        names, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.mine = np.zeros(len(names), bool)

    def linked(self, i: int, many: np.ndarray) -> np.ndarray:
        own = self.ids[self.first[i]:self.first[i + 1]]
        self.mine[own] = True
        size = self.size[many]
        starts = np.cumsum(size) - size
        at = np.repeat(self.first[many] - starts, size) + np.arange(size.sum())
        common = np.add.reduceat(self.mine[self.ids[at]].astype(np.int64), starts)
        self.mine[own] = False
        return 100 * common >= SHARE * (size + self.size[i] - common)


# -- blocks of large groups -------------------------------------------------------------------

def in_blocks(rows: DataFrame, key: str, node: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with columns x, y and side: groups of at most ``block`` nodes are one block (0, 0); larger ones are dealt
    into blocks by hash and every two blocks (x <= y) meet in a task of their own, so no task gets more than two. A node
    counts as its ``weight``, if ``rows`` has that column."""
    weight = F.sum("weight") if "weight" in rows.columns else F.count("*")
    large = rows.groupBy(key).agg(weight.alias("rows")).filter(F.col("rows") > block)
    parts = large.select(key, F.ceil(F.col("rows") / block).cast("int").alias("parts"))
    marked = rows.join(parts, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    marked = marked.withColumn("mine", F.pmod(F.xxhash64(node), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("mine", o).alias("x"), F.greatest("mine", o).alias("y")))
    return marked.withColumn("b", F.explode(others)).select(*rows.columns, F.col("b.x").alias("x"), F.col("b.y").alias("y"), (F.col("mine") == F.col("b.y")).cast("int").alias("side"))


def grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Rows of equal keys in turn, from input sorted by them."""
    now, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            k = tuple(r[c] for c in keys)
            if k != now and rows:
                yield rows
                rows = []
            now = k
            rows.append(r)
    if rows:
        yield rows


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without those of a text that the task has sent on: copies of a text are one in its block."""
    seen: set[tuple] = set()
    for batch in batches:
        kept = []
        for k, name in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "comp", "x", "y")), strict=True)):
            if name not in seen:
                seen.add(name)
                kept.append(k)
        if len(seen) > SEEN:
            seen.clear()
        yield batch if len(kept) == batch.num_rows else batch.take(pa.array(kept, pa.int64()))


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = []
    for rows in grouped(batches, ("cell", "x", "y")):
        size = np.array([r["n"] for r in rows], np.int64)
        sides = (np.array([r["side"] for r in rows]),) if rows[0]["x"] != rows[0]["y"] else ()
        out += [(rows[i]["node"], rows[j]["node"]) for i, j in link_packed([r["point"] for r in rows], size, sides=sides)]
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    yield _edges(out)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of the exact links within each provisional component, from whole texts."""
    now, members, out = None, {}, []

    def close() -> list[tuple[int, int]]:
        names = sorted(members)
        sets_ = [members[k][0] for k in names]
        size = np.array([len(x) for x in sets_], np.int64)
        packed = [packed_points(x, np.zeros(len(x), np.int64), np.array([len(x)]))[0] for x in sets_]
        sides = (np.array([members[k][1] for k in names]),) if now[1] != now[2] else ()
        return [(names[i], names[j]) for i, j in link_packed(packed, size, Overlaps(sets_).linked, sides)]

    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        cols = [batch.column(c).to_pylist() for c in ("comp", "x", "y", "side", "node")]
        for i, j in slices(offsets):
            h, text = sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            ids = node_ids(h, text, j - i)
            first = np.searchsorted(text, np.arange(j - i + 1))
            for k in range(i, j):
                key = (cols[0][k], cols[1][k], cols[2][k])
                if key != now:
                    if len(members) > 1:
                        out += close()
                    now, members = key, {}
                if ids[k - i] == cols[4][k]:  # another row of the same id may have another text
                    members[cols[4][k]] = (h[first[k - i]:first[k - i + 1]].copy(), cols[3][k])
        if len(out) > 50_000:
            yield _edges(out)
            out = []
    if len(members) > 1:
        out += close()
    yield _edges(out)


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): n_shingles and component_id, the least doc_id that links reach;
    also text_hash (xxhash64 of the text) and group_id, a name of the component (null without shingles).

    Words are runs without white space, A-Z lower-cased; texts of fewer than five words are one shingle; null, empty and
    blank texts have no shingle, link with nothing and are their own component. Repeated rows and equal sets are in one
    component; a null doc_id has the component of its copies and partners (null if it has none); other columns are
    ignored; an empty table gives no rows. Links are exact up to collisions of 64-bit hashes.
    """
    spark = docs.sparkSession
    tasks = shuffle_partitions(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    top = (slim.transform(in_batches, _frequent, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).select("h"))
    heavy = np.sort(np.array(top.toPandas()["h"], np.int64).view(_U))  # at most HEAVY numbers
    rows = written(slim.transform(in_batches, _describe(heavy), "doc_id long, text_hash long, node long, n long, point binary, prefix array<long>"), "shingles")
    sized = rows.filter("n > 0")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("one")  # a row of each set, of the least doc_id, nulls last
    nodes = written(sized.groupBy("node").agg(one, F.first("n").alias("n"), F.first("point").alias("point"))
                    .select("node", "one.doc_id", "one.text_hash", "n", "point"), "sets")

    total = rows.agg(F.sum(F.size("prefix"))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, total * 10 / CELL_BYTES)))))
    cells = sized.select("node", "prefix").transform(in_batches, _deal(bits), "shard long, data binary").repartition(max(tasks, (1 << bits) // 4), "shard").sortWithinPartitions("shard")
    point = sum((F.when(F.col("n") >= limit, 2 << more).otherwise(0) for limit, more in zip(LIMITS, BITS[1:], strict=True)), F.lit(2 << BITS[0]))
    sizes = nodes.select("node", "n", F.greatest(F.lit(1), point / POINT_BYTES).cast("long").alias("weight"))
    live = written(cells.transform(in_batches, _live, "cell long, node long").distinct().join(sizes, "node"), "cells")
    at = in_blocks(live, "cell", "node").join(nodes.select("node", "point"), "node")
    survivors = at.repartition(tasks, "cell", "x", "y").sortWithinPartitions("cell", "x", "y").transform(in_batches, _survivors, "a long, b long")
    lengths = nodes.select("node", F.greatest(F.lit(1), F.col("n") / TEXT_SHINGLES).cast("long").alias("weight"))
    near = written(components(survivors).select("node", F.col("label").alias("comp")).join(lengths, "node"), "near")

    members = in_blocks(near, "comp", "node", TEXTS).join(nodes.select("node", "doc_id", "text_hash"), "node")
    wanted = ["comp", "x", "y", "side", "node", "text"]
    # rows without an id are found by their text alone, copies once
    nameless = slim.filter("doc_id is null").groupBy("text_hash").agg(F.first("text").alias("text")).join(members.filter("doc_id is null"), "text_hash")
    texts = slim.join(members, ["doc_id", "text_hash"]).select(wanted).unionByName(nameless.select(wanted))
    texts = in_batches(texts, _once, texts.schema)
    exact = texts.repartition(tasks, "comp", "x", "y").sortWithinPartitions("comp", "x", "y").transform(in_batches, _verified, "a long, b long")
    label = written(components(exact), "labels")
    least = label.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("component"))
    of_node = nodes.select("node", "doc_id").join(label.join(least, "label").select("node", "label", "component"), "node", "left")
    of_node = of_node.select("node", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("label", "node").alias("group_id"))
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "text_hash", "group_id"]
    out = sized.join(of_node, "node").select(names)
    return out.unionByName(rows.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("group_id", F.lit(None).cast("long")).select(names))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the least doc_id (nulls last), then text hash; of
    repeated rows one. Rows without words link with nothing and all stay. Columns are those of ``docs``."""
    found = jaccard_components(docs.select("doc_id", "text")).filter("group_id is not null")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    kept = found.groupBy("group_id").agg(F.min(key).alias("k")).select("k.*").distinct()
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct(docs.columns).alias("row"), id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("id"),
                        F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("words"))
    chosen = keyed.filter("words").join(kept, ["none", "id", "text_hash"], "left_semi").groupBy("none", "id", "text_hash").agg(F.first("row").alias("row"))
    return chosen.select("row.*").unionByName(keyed.filter(~F.col("words")).select("row.*"))
