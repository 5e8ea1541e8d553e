"""Operator 13: a Merkle manifest of a dataset with a witness (the proof) for every row, built by appending.

Rows of a language are leaves in order of their ids. Aligned blocks of them are built apart, each by streaming
appends: a new leaf is an open subtree of height 0; when an open subtree's sibling is complete, both become one
and the witnesses of all leaves below are extended by the other one's root. So witnesses grow bottom up as
subtrees close, and no tree is walked again. A block's root is then appended like a leaf to the next layer, which
is cut into blocks in turn, until one node a language remains; the languages' roots are appended last. A task
holds one block and its layer's witness, whatever the number of rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from slimwire.llm.common import crc_mod, numbered, sent, written

BLOCK = 12        # height of a block: 4,096 nodes
TAMPERED = 7      # rows whose crc32 of the id is divisible by this are tampered with, to test the proofs
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Frontier:
    """Open subtrees of an appended sequence and the witnesses of its leaves so far.

    A witness's steps are ``L`` or ``R`` (the sibling's side) and the sibling's digest, or empty where there is none."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, int, int]] = []  # height, digest, first leaf, end of leaves
        self.witness: list[list[str]] = []

    def _join(self, right: tuple[int, str, int, int]) -> None:
        """Complete subtrees as long as the last two are siblings."""
        while self.open and self.open[-1][0] == right[0]:
            left = self.open.pop()
            for w in self.witness[left[2]:left[3]]:
                w.append("R" + right[1])
            for w in self.witness[right[2]:right[3]]:
                w.append("L" + left[1])
            right = (right[0] + 1, digest(left[1] + right[1]), left[2], right[3])
        self.open.append(right)

    def append(self, leaf: str) -> None:
        n = len(self.witness)
        self.witness.append([])
        self._join((0, leaf, n, n + 1))

    def close(self, height: int = 0) -> str:
        """Raise what is open to one node, ``height`` high at least; a node without a sibling becomes its own hash."""
        while len(self.open) > 1 or self.open[0][0] < height:
            h, d, a, b = self.open.pop()
            for w in self.witness[a:b]:
                w.append("")
            self._join((h + 1, digest(d), a, b))
        return self.open[0][1]


def built(leaves: list[str], block: int, height: int) -> tuple[str, list[list[str]]]:
    """Root and witnesses of a block. Only a group's first block may end below its ``height``: it is then the only one."""
    f = Frontier()
    for x in leaves:
        f.append(x)
    return f.close(height if block else 0), f.witness


def fold(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and its witness give."""
    for s in steps:
        leaf = digest(s[1:] + leaf if s[:1] == "L" else leaf + s[1:])
    return leaf


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by("i")


def climb(nodes: DataFrame, height: int = BLOCK) -> list[DataFrame]:
    """Layers of nodes (g: group, i: place in it, digest), from the given one to one node a group."""
    def roots(key: tuple, t: pa.Table) -> pa.Table:
        block = key[1].as_py()
        root, _ = built(_sorted(t)["digest"].to_pylist(), block, height)
        return pa.table({"g": pa.array([key[0].as_py()], pa.string()), "i": pa.array([block], pa.int64()), "digest": pa.array([root], pa.string())})

    layers = [nodes]
    while (layers[-1].agg(F.max("i")).first()[0] or 0) > 0:
        blocks = layers[-1].select("g", "i", "digest").groupBy("g", F.shiftright("i", height).alias("b"))
        layers.append(written(blocks.applyInArrow(roots, "g string, i long, digest string"), "layer"))
    return layers


def descend(layers: list[DataFrame], top: DataFrame, height: int = BLOCK) -> DataFrame:
    """(g, i, above, subroot, root) of the lowest blocks: ``above``, the rest of the witness of a block's leaves.

    ``top``: such rows of the groups' last nodes (i 0)."""
    def extend(key: tuple, t: pa.Table, up: pa.Table) -> pa.Table:
        t = _sorted(t)
        _, witness = built(t["digest"].to_pylist(), key[1].as_py(), height)
        rest = up["above"][0].as_py()
        n = t.num_rows
        return pa.table({"g": t["g"], "i": t["i"], "above": pa.array([w + rest for w in witness], pa.list_(pa.string())),
                         "subroot": pa.array([up["subroot"][0].as_py()] * n, pa.string()), "root": pa.array([up["root"][0].as_py()] * n, pa.string())})

    for layer in reversed(layers[1:-1]):
        own = layer.withColumn("b", F.shiftright("i", height)).groupBy("g", "b")
        top = own.cogroup(top.withColumnRenamed("i", "b").groupBy("g", "b")).applyInArrow(extend, "g string, i long, above array<string>, subroot string, root string")
    return top


def _places(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with ``i``: the place in the group ``g``, from 0."""
    at = numbered(rows, ["g", *order], name)
    first = sent(at.groupBy("g").agg(F.min("__at").alias("__first")))
    return at.join(first, "g").withColumn("i", F.col("__at") - F.col("__first")).drop("__at", "__first")


def leaf_of(fields: list[Column]) -> Column:
    """sha256 of the fields, each as its byte count and value, or ``-`` for a null."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields)), 256)


def over_groups(layers: list[DataFrame], height: int = BLOCK) -> DataFrame:
    """(g, i, above, subroot, root) of the lowest blocks of all groups, by the groups' layers; ``above`` goes on through the tree of groups."""
    if len(layers) == 1:  # no group has two leaves: each is a block of its own
        layers = [*layers, layers[0].select("g", "i", "digest")]
    # the groups' roots, in order of their names, are the leaves of the last tree, a group "" of its own
    ends = layers[-1].select(F.lit("").alias("g"), F.col("g").alias("own"), "digest")
    tops = written(_places(ends, ["own"], "subroots"), "subroots")
    over = climb(tops, height)
    if len(over) == 1:
        over.append(tops.select("g", "i", "digest"))
    root = over[-1].select("g", "i", F.array().cast("array<string>").alias("above"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def join_groups(key: tuple, t: pa.Table, up: pa.Table) -> pa.Table:
        t = _sorted(t)
        _, witness = built(t["digest"].to_pylist(), key[1].as_py(), height)
        rest, n = up["above"][0].as_py(), t.num_rows
        return pa.table({"g": t["own"], "i": pa.array([0] * n, pa.int64()), "above": pa.array([w + rest for w in witness], pa.list_(pa.string())),
                         "subroot": t["digest"], "root": pa.array([up["root"][0].as_py()] * n, pa.string())})

    own = tops.withColumn("b", F.shiftright("i", height)).groupBy("g", "b")
    last = own.cogroup(descend(over, root, height).withColumnRenamed("i", "b").groupBy("g", "b")).applyInArrow(join_groups, "g string, i long, above array<string>, subroot string, root string")
    return descend(layers, written(last, "subroots"), height)


def manifest(docs: DataFrame, height: int = BLOCK, tampered: int = TAMPERED) -> DataFrame:
    """Every row's ``doc_id``, ``lang``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of its witness's digests), and a test of
    the proofs: ``folded_root``, from the leaf (of the row with one more in n_chars where ``tampered`` divides the crc32 of
    doc_id) and the original witness, and whether it is ``verified`` as the root.

    Leaves ascend by doc_id in their language, null first, equal ids by leaf; repeated rows are leaves of their own.
    A null field counts as ``-``, a null language is a group of its own before all others; a row without doc_id or n_chars
    is not tampered with. A row without siblings has the proof of the empty text. An empty table gives no rows.
    Other columns of ``docs``, whatever their names, are not looked at.
    """
    group = F.coalesce(F.concat(F.lit("."), F.col("lang")), F.lit(""))
    more = F.when(F.col("doc_id").isNotNull() & (crc_mod("doc_id", tampered) == 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    rows = docs.select("doc_id", "lang", group.alias("g"), leaf_of([F.col(c) for c in FIELDS]).alias("digest"),
                       leaf_of([more if c == "n_chars" else F.col(c) for c in FIELDS]).alias("changed"))
    leaves = written(_places(rows, ["doc_id", "digest"], "leaves"), "leaves")
    layers = climb(leaves, height)
    above = over_groups(layers, height)

    id_type = docs.schema["doc_id"].dataType
    schema = StructType([StructField("doc_id", id_type), docs.schema["lang"], *StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])

    def prove(key: tuple, t: pa.Table, up: pa.Table) -> pa.Table:
        t = _sorted(t)
        own = t["digest"].to_pylist()
        _, witness = built(own, key[1].as_py(), height)
        rest, subroot, root = up["above"][0].as_py(), up["subroot"][0].as_py(), up["root"][0].as_py()
        proofs = [digest("".join(s[1:] for s in w + rest)) for w in witness]
        folded = [fold(x, w + rest) for x, w in zip(t["changed"].to_pylist(), witness, strict=True)]
        n = t.num_rows
        return pa.table({"doc_id": t["doc_id"], "lang": t["lang"], "leaf": pa.array(own, pa.string()), "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})

    blocks = leaves.withColumn("b", F.shiftright("i", height)).groupBy("g", "b")
    return blocks.cogroup(above.withColumnRenamed("i", "b").groupBy("g", "b")).applyInArrow(prove, schema)
