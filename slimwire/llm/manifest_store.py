"""Operator 13, kept up: a stored Merkle manifest to which rows are appended, in batches or from a stream.

Leaves of a language go on where the stored ones end. A block that an append completes is closed: its root is appended
to the block roots, and the witnesses of its leaves, final up to that root, are never made again. What remains open,
less than a block a language, is read with the next append. So an append costs its own rows and the open ones, whatever
is stored. ``proofs`` extends the witnesses from block roots to the root, which is all that later appends change.

Every version adds files and none is written over. The list of versions comes last, so a writer that fails leaves the
version before; the same version, written anew, replaces what the failed one left.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slimwire.llm.common import sent, written
from slimwire.llm.manifest import BLOCK, FIELDS, _places, _sorted, built, climb, leaf_of, over_groups

LEAVES = "doc_id long, lang string, g string, i long, digest string"
CLOSED = LEAVES + ", witness array<string>, block_root string"
GROUPS = "g string, n long, last long"


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness give: a step's first letter is its sibling's side, without a letter there is none."""
    return F.aggregate(witness, leaf, lambda at, s: F.sha2(F.when(s.startswith("L"), F.concat(F.substring(s, 2, 64), at)).otherwise(F.concat(at, F.substring(s, 2, 64))), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, g, digest): each row's language as the name of its group, and its leaf."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.coalesce(F.concat(F.lit("."), F.col("lang")), F.lit("")).alias("g"), leaf_of([F.col(c) for c in FIELDS]).alias("digest"))


def blocks_of(leaves: DataFrame, height: int) -> DataFrame:
    """``leaves`` (LEAVES) with their witnesses within their blocks; a block's first leaf has its root."""
    def build(key: tuple, t: pa.Table) -> pa.Table:
        t = _sorted(t)
        root, witness = built(t["digest"].to_pylist(), key[1].as_py(), height)
        return pa.table({**{c: t[c] for c in ("doc_id", "lang", "g", "i", "digest")}, "witness": pa.array(witness, pa.list_(pa.string())),
                         "block_root": pa.array([root] + [None] * (t.num_rows - 1), pa.string())})

    return leaves.withColumn("b", F.shiftright("i", height)).groupBy("g", "b").applyInArrow(build, CLOSED)


class ManifestStore:
    """A manifest below ``path``, a folder that driver and executors share, in blocks of 2 ** ``height`` leaves."""

    def __init__(self, spark: SparkSession, path: str, height: int = BLOCK):
        self.spark, self.path, self.height = spark, path.rstrip("/"), height

    def versions(self) -> list[int]:
        """The whole versions, oldest first. Raises ValueError where the store has blocks of another height."""
        try:
            rows = self.spark.read.schema("version long, height int").json(f"{self.path}/_versions").distinct().collect()  # one row an append
        except AnalysisException:
            return []
        if any(r["height"] != self.height for r in rows):
            raise ValueError(f"the manifest at {self.path} has blocks of another height than {self.height}")
        return sorted(r["version"] for r in rows)

    def _table(self, kind: str, schema: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{kind}/{v}" for v in versions))

    def append(self, docs: DataFrame, version: int | None = None) -> int:
        """Append the rows of ``docs`` (columns FIELDS, others aren't looked at) and return the version.

        In each language the new doc_ids must be greater than all stored ones, null being least: a ValueError otherwise, and
        nothing is stored. Within ``docs`` any order, repeated rows and ids, nulls and languages not seen before are fine; an
        empty table gives a version like the one before. A given ``version`` that is stored already is left as it is,
        so that a stream's batch can come twice; else it must be greater than the last."""
        stored = self.versions()
        last = stored[-1:]
        version = last[0] + 1 if version is None and last else version or 0
        if version in stored:
            return version
        if last and version < last[0]:
            raise ValueError(f"version {version} comes before the last one, {last[0]}")
        groups = self._table("groups", GROUPS, last)
        rows = _places(leaves_of(docs), ["doc_id", "digest"], "appended").join(sent(groups), "g", "left")
        new = written(rows.withColumn("i", F.col("i") + F.coalesce("n", F.lit(0))), "appended")
        late = new.filter(F.col("n").isNotNull() & (F.col("doc_id").isNull() | F.coalesce(F.col("doc_id") <= F.col("last"), F.lit(False)))).first()
        if late is not None:
            raise ValueError(f"doc_id {late['doc_id']} of language {late['lang']} is not above the stored ones (last: {late['last']})")
        added = new.select("g", (F.col("i") + 1).alias("n"), F.col("doc_id").alias("last"))
        now = written(groups.unionByName(added).groupBy("g").agg(F.max("n").alias("n"), F.max("last").alias("last")), "groups")  # one row a language
        names = ["doc_id", "lang", "g", "i", "digest"]
        pending = self._table("open", LEAVES, last).unionByName(new.select(*names)).join(sent(now.select("g", "n")), "g")
        full = F.shiftleft(F.shiftright("i", self.height) + 1, self.height) <= F.col("n")
        self._write(blocks_of(pending.filter(full).select(*names), self.height), "closed", version)
        closed = self._table("closed", CLOSED, [version])
        self._write(closed.filter("block_root is not null").select("g", F.shiftright("i", self.height).alias("i"), F.col("block_root").alias("digest")), "roots", version)
        self._write(pending.filter(~full).select(*names), "open", version)
        self._write(now, "groups", version)
        self.spark.createDataFrame([(version, self.height)], "version long, height int").coalesce(1).write.mode("append").json(f"{self.path}/_versions")
        return version

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/{version}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``: each batch is the version of its number, once."""
        def batch(docs: DataFrame, n: int) -> None:
            self.append(docs, n)

        return batch

    def proofs(self, version: int | None = None) -> DataFrame:
        """Every row's doc_id, lang, leaf, subroot, root, witness (steps from the leaf to the root, as ``folded`` takes them) and
        proof_sha256, of a version (default: the last). Closed blocks aren't hashed again. An empty store gives no rows."""
        stored = [v for v in self.versions() if version is None or v <= version]
        open_ = written(blocks_of(self._table("open", LEAVES, stored[-1:]), self.height), "open")
        block = F.shiftright("i", self.height)
        roots = self._table("roots", "g string, i long, digest string", stored)
        roots = written(roots.unionByName(open_.filter("block_root is not null").select("g", block.alias("i"), F.col("block_root").alias("digest"))), "roots")
        # the layer of the leaves itself isn't needed above the block roots
        above = over_groups([roots, *climb(roots, self.height)], self.height).withColumnRenamed("i", "b")
        rows = self._table("closed", CLOSED, stored).unionByName(open_).withColumn("b", block).join(above, ["g", "b"])
        whole = rows.withColumn("witness", F.concat("witness", "above"))
        proof = F.sha2(F.array_join(F.transform("witness", lambda s: F.substring(s, 2, 64)), ""), 256)
        return whole.select("doc_id", "lang", F.col("digest").alias("leaf"), "subroot", "root", "witness", proof.alias("proof_sha256"))
