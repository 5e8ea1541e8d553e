"""Versioned snapshots of state tables (metrics, sessions, dictionaries).

A snapshot is a Parquet table partitioned by ``version`` under one base path plus a
small JSON manifest (``_manifest``, hidden from partition discovery) listing the
versions. Writing never overwrites: each write adds a version, so a failed or
lost writer leaves the previous version readable. Reading picks the newest
version from the manifest and prunes to its partition; a missing base path or
an empty version reads as an empty DataFrame with the given schema.

JSON state files (the shape of the reference's two files) are read with an
explicit schema in PERMISSIVE mode; corrupt records are dropped, not fatal.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

METRICS_SCHEMA = StructType([
    StructField("id", LongType()), StructField("at_ms", LongType()),
    StructField("provider", StringType()), StructField("model", StringType()),
    StructField("session_id", StringType()), StructField("tokens_before", LongType()),
    StructField("tokens_after", LongType()), StructField("saved", LongType()),
    StructField("duration_ms", DoubleType()),
])

BLOCK_STRUCT = StructType([
    StructField("msg_idx", LongType()), StructField("block_idx", LongType()),
    StructField("role", StringType()), StructField("type", StringType()),
    StructField("text", StringType()),
])

SESSION_SCHEMA = StructType([
    StructField("session_id", StringType()), StructField("model", StringType()),
    StructField("messages", ArrayType(BLOCK_STRUCT)),
    StructField("first_seen", LongType()), StructField("last_active", LongType()),
    StructField("total_tokens", LongType()),
])

# Session timelines are stored in long form next to the session rows.
TIMELINE_SCHEMA = StructType([
    StructField("session_id", StringType()), StructField("request_id", LongType()),
    StructField("index", LongType()), StructField("model", StringType()),
    StructField("tokens", LongType()), StructField("at_ms", LongType()),
])

MANIFEST = "_manifest"


def _new_version() -> int:
    return time.time_ns() // 1000


def write_snapshot(df: DataFrame, base: str) -> str:
    """Append ``df`` as a new version; returns the version id."""
    spark = df.sparkSession
    v = _new_version()
    df.withColumn("version", F.lit(v).cast("bigint")).write.mode("append").partitionBy("version").parquet(base)
    try:
        n = spark.read.parquet(base).where(F.col("version") == v).count()
    except AnalysisException:  # an empty first version writes no data files
        n = 0
    spark.createDataFrame([(v, n)], "version long, rows long").coalesce(1).write.mode("append").json(
        f"{base}/{MANIFEST}")
    return str(v)


def latest_version(spark: SparkSession, base: str) -> int | None:
    try:
        m = spark.read.schema("version long, rows long").json(f"{base}/{MANIFEST}")
        row = m.agg(F.max("version").alias("v")).first()
    except AnalysisException:
        return None
    return None if row is None else row["v"]


def read_snapshot(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """Newest version, or empty with ``schema`` when nothing (readable) is there."""
    empty = spark.createDataFrame([], schema)
    v = latest_version(spark, base)
    if v is None:
        return empty
    full = StructType(schema.fields + [StructField("version", LongType())])
    try:
        data = spark.read.schema(full).parquet(base).where(F.col("version") == v)
    except AnalysisException:
        return empty
    return data.select(*[f.name for f in schema.fields])


def read_json_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON-lines state file: explicit schema, corrupt records dropped (DROPMALFORMED);
    a missing path gives an empty DataFrame."""
    try:
        df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
        df.schema  # resolve now so a missing path surfaces here
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_json_state(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


__all__ = ["METRICS_SCHEMA", "SESSION_SCHEMA", "BLOCK_STRUCT", "write_snapshot", "read_snapshot",
           "latest_version", "read_json_state", "write_json_state", "BooleanType"]
