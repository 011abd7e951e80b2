"""Shared schemas."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

# One result shape for every rule-style operator.
FINDING_SCHEMA = StructType([
    StructField("server_name", StringType()),
    StructField("database_name", StringType()),
    StructField("check_ts", TimestampNTZType()),
    StructField("check_id", IntegerType()),
    StructField("priority", IntegerType()),
    StructField("findings_group", StringType()),
    StructField("finding", StringType()),
    StructField("details", StringType()),
    StructField("value", DoubleType()),
])

FINDING_COLUMNS = [f.name for f in FINDING_SCHEMA.fields]

COUNTER_SNAPSHOT_SCHEMA = StructType([
    StructField("server_name", StringType()),
    StructField("check_ts", TimestampNTZType()),
    StructField("metric", StringType()),
    StructField("cum_value", LongType()),
    StructField("cum_count", LongType()),
])

SESSION_SCHEMA = StructType([
    StructField("server_name", StringType()),
    StructField("session_id", LongType()),
    StructField("blocking_session_id", LongType()),
    StructField("wait_duration_ms", LongType()),
    StructField("wait_type", StringType()),
    StructField("status", StringType()),
    StructField("login_name", StringType()),
    StructField("database_name", StringType()),
])

INDEX_CATALOG_SCHEMA = StructType([
    StructField("server_name", StringType()),
    StructField("database_name", StringType()),
    StructField("table_name", StringType()),
    StructField("index_id", LongType()),
    StructField("index_name", StringType()),
    StructField("keys", ArrayType(StringType())),
    StructField("includes", ArrayType(StringType())),
    StructField("user_seeks", LongType()),
    StructField("user_scans", LongType()),
    StructField("user_lookups", LongType()),
    StructField("user_updates", LongType()),
    StructField("size_mb", LongType()),
    StructField("is_unique", BooleanType()),
])
