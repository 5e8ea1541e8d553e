"""Stores that are kept up: a delta is merged into the stored version, bucket by bucket.

A store is a Parquet table of states, one row a key, in a fixed number of buckets by a hash of the key. A version
names for each bucket the version that wrote it last, so that merging a delta reads and writes the buckets of
the delta's keys alone and all others go on as they are. A version is there once its line of the manifest
is; a writer that is lost leaves the version before it. One writer at a time.

States merge by aggregates that don't care how a log was cut (sums, first and last by order), so a log put in
pieces gives what the whole log gives. Registry ids go on from the stored sequence.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from slimwire.functions import text as tx
from slimwire.operators.context import CTX_PREFIX
from slimwire.operators.sessions import ORDER
from slimwire.session import stored

BUCKETS = 64
_MANIFEST_COLUMNS = "version long, state string"


@dataclass(frozen=True)
class Version:
    """What a manifest line says: the store's buckets, which version wrote each one last, and the next free number."""

    version: int
    buckets: int
    written: dict[int, int]
    next_id: int = 0


class KeyedStore:
    """A kept-up table below ``base``. ``merge`` turns states of equal keys, old and new ones together, into one a key."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, keys: Sequence[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.base, self.schema, self.keys, self.merge, self.buckets = spark, base.rstrip("/"), schema, list(keys), merge, buckets

    def versions(self) -> list[Version]:
        """All versions, oldest first; one line each."""
        try:
            lines = self.spark.read.schema(_MANIFEST_COLUMNS).json(f"{self.base}/_manifest").collect()
        except AnalysisException:
            return []
        out = []
        for r in sorted(lines, key=lambda r: r["version"]):
            s = json.loads(r["state"])
            out.append(Version(r["version"], s["buckets"], {int(b): v for b, v in s["written"].items()}, s["next_id"]))
        return out

    def newest(self) -> Version:
        return (self.versions() or [Version(0, self.buckets, {})])[-1]

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _read(self, at: Version, buckets: Sequence[int] | None = None) -> DataFrame:
        by_version: dict[int, list[int]] = {}
        for b, v in at.written.items():
            if buckets is None or b in buckets:
                by_version.setdefault(v, []).append(b)
        out = self.spark.createDataFrame([], self.schema)
        full = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        for v, own in sorted(by_version.items()):
            # only the named buckets' folders are listed
            part = self.spark.read.schema(full).option("basePath", f"{self.base}/version={v}").parquet(*(f"{self.base}/version={v}/bucket={b}" for b in sorted(own)))
            out = out.unionByName(part.select(*self.schema.names))
        return out

    def read(self) -> DataFrame:
        """The newest version's states; empty where there is no version."""
        return self._read(self.newest())

    def put(self, delta: DataFrame, number: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> Version:
        """Merge ``delta`` (states, any number a key) into the newest version; returns the new one.

        ``number``: called with the delta, the touched buckets' states and the next free number, returns the delta's new
        states with their numbers in column ``seq``."""
        old = self.newest()
        delta = stored(delta.select(*(c for c in self.schema.names if c in delta.columns), *(c for c in delta.columns if c not in self.schema.names))
                       .withColumn("bucket", self._bucket(old.buckets)), "delta")
        touched = sorted(r["bucket"] for r in delta.select("bucket").distinct().collect())  # no more than the buckets
        if not touched:
            return old
        before = self._read(old, touched)
        fresh, next_id = delta.drop("bucket"), old.next_id
        if number is not None:
            fresh = stored(number(fresh, before, old.next_id), "numbered")
            next_id = max(next_id, (fresh.agg(F.max("seq")).first()[0] or -1) + 1)
        version = max(time.time_ns() // 1000, old.version + 1)
        merged = self.merge(before.unionByName(fresh.select(*self.schema.names))).select(*self.schema.names)
        path = f"{self.base}/version={version}"
        merged.withColumn("bucket", self._bucket(old.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)
        try:
            there = {r["bucket"] for r in self.spark.read.parquet(path).select("bucket").distinct().collect()}
        except AnalysisException:  # nothing is left of the touched keys
            there = set()
        written = {b: v for b, v in old.written.items() if b not in touched} | dict.fromkeys(sorted(there), version)
        new = Version(version, old.buckets, written, next_id)
        self._note(new)
        return new

    def _note(self, v: Version) -> None:
        state = json.dumps({"buckets": v.buckets, "written": v.written, "next_id": v.next_id})
        self.spark.createDataFrame([(v.version, state)], _MANIFEST_COLUMNS).coalesce(1).write.mode("append").json(f"{self.base}/_manifest")

    def clear(self) -> Version:
        """A new, empty version; numbers begin anew."""
        v = Version(max(time.time_ns() // 1000, self.newest().version + 1), self.buckets, {})
        self._note(v)
        return v


def _schema(columns: str) -> StructType:
    kinds = {"string": StringType(), "long": LongType()}
    return StructType([StructField(name, kinds[kind]) for name, kind in (c.split() for c in columns.split(", "))])


# -- C1: the context store --------------------------------------------------------------------

CONTEXT = _schema("id string, sha string, content string, bytes long, label string, label_ms long, last_put_ms long, puts long")


def merge_contexts(states: DataFrame) -> DataFrame:
    named = F.max(F.when(F.col("label").isNotNull(), F.struct("label_ms", "label")))
    same = [F.first(c).alias(c) for c in ("id", "content", "bytes") if c in states.columns]   # what a content fixes
    return (states.groupBy("sha").agg(*same, named.alias("_l"), F.max("last_put_ms").alias("last_put_ms"), F.sum("puts").alias("puts"))
                  .withColumn("label", F.col("_l.label")).withColumn("label_ms", F.col("_l.label_ms")))


def context_store(spark: SparkSession, base: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, base, CONTEXT, ["sha"], merge_contexts, buckets)


def put_contexts(store: KeyedStore, puts: DataFrame) -> Version:
    """Merge puts (content, label, at_ms) into the store. Empty contents are left out; the newest label that isn't empty stays."""
    some = puts.where(F.coalesce(F.length("content"), F.lit(0)) > 0)
    label = F.when(F.col("label") != "", F.col("label"))
    states = some.select(tx.content_key("content").alias("sha"), "content", label.alias("label"), F.when(label.isNotNull(), F.col("at_ms")).alias("label_ms"),
                         F.col("at_ms").alias("last_put_ms"), F.lit(1).cast("long").alias("puts"))
    # ids and lengths are made once a content, not once a put
    merged = (merge_contexts(states).withColumn("id", F.concat(F.lit(CTX_PREFIX), tx.fnv1a32("content")))
              .withColumn("bytes", tx.utf16_len("content").cast("long")))
    return store.put(merged.select(*CONTEXT.names))


# -- F1: the newest version of each file ----------------------------------------------------------

FILES = _schema("session_id string, path string, text string, at_ms long, request_id long, msg_idx long, block_idx long, puts long")
_SENT = ["at_ms", "request_id", "msg_idx", "block_idx"]


def merge_files(states: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("text", *_SENT), F.struct(*_SENT)).alias("_last")
    return states.groupBy("session_id", "path").agg(last, F.sum("puts").alias("puts")).select("session_id", "path", "_last.*", "puts")


def file_store(spark: SparkSession, base: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, base, FILES, ["session_id", "path"], merge_files, buckets)


def put_files(store: KeyedStore, versions: DataFrame) -> Version:
    """merge sent files (session_id, path, text and when they were sent) into the store."""
    sent = [(F.col(c) if c in versions.columns else F.lit(0)).cast("long").alias(c) for c in _SENT]
    return store.put(merge_files(versions.select("session_id", "path", "text", *sent, F.lit(1).cast("long").alias("puts"))))


# -- H1: the state of each session -----------------------------------------------------------------

def session_schema(turns: DataFrame) -> StructType:
    messages = turns.schema["messages"].dataType.simpleString()
    return StructType.fromDDL(f"session_id string, messages {messages}, model string, first_seen long, first_request long, last_active long, last_request long, total_tokens long, turns long")


def merge_sessions(states: DataFrame) -> DataFrame:
    first = F.min(F.struct("first_seen", "first_request")).alias("_first")
    last = F.max_by(F.struct("messages", "model", "last_active", "last_request"), F.struct("last_active", "last_request")).alias("_last")
    return (states.groupBy("session_id").agg(first, last, F.sum("total_tokens").alias("total_tokens"), F.sum("turns").alias("turns"))
                  .select("session_id", "_first.*", "_last.*", "total_tokens", "turns"))


def session_store(spark: SparkSession, base: str, turns: DataFrame, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, base, session_schema(turns), ["session_id"], merge_sessions, buckets)


def put_turns(store: KeyedStore, turns: DataFrame) -> Version:
    """H1: append turns (as ``build_turns`` makes them) to their sessions."""
    at, request = ORDER
    states = turns.select("session_id", "messages", "model", F.col(at).alias("first_seen"), F.col(request).alias("first_request"), F.col(at).alias("last_active"),
                          F.col(request).alias("last_request"), F.col("tokens").cast("long").alias("total_tokens"), F.lit(1).cast("long").alias("turns"))
    return store.put(merge_sessions(states).select(*store.schema.names))


# -- R1: the registry ------------------------------------------------------------------------------

REGISTRY = _schema("session_id string, hash string, seq long")


def registry_store(spark: SparkSession, base: str, buckets: int = BUCKETS) -> KeyedStore:
    return KeyedStore(spark, base, REGISTRY, ["session_id", "hash"], lambda s: s.groupBy("session_id", "hash").agg(F.min("seq").alias("seq")), buckets)


def register_hashes(store: KeyedStore, seen: DataFrame, order: Sequence[str]) -> Version:
    """Pairs (session_id, hash) that the store doesn't have get the next numbers in order of their first sight; others keep theirs."""
    from slimwire.plans.ordered import numbered

    first = seen.groupBy("session_id", "hash").agg(F.min(F.struct(*order)).alias("_first"))

    def number(delta: DataFrame, before: DataFrame, next_id: int) -> DataFrame:
        new = delta.join(before.select("session_id", "hash"), ["session_id", "hash"], "left_anti")
        at = numbered(new, ["_first", "session_id", "hash"], "_at", "registry")
        return at.select("session_id", "hash", (F.col("_at") + next_id).alias("seq"))

    return store.put(first, number)


def registry_ids(store: KeyedStore) -> DataFrame:
    """The registry with its ids."""
    return store.read().withColumn("ctx_id", F.concat(F.lit(CTX_PREFIX), F.lower(F.conv(F.col("seq").cast("string"), 10, 36))))
