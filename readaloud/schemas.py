"""Declared schemas of the application tables (stored as Parquet).

Reads of stored tables use these instead of inference; a file written before
a column existed reads with that column NULL (the additive migration).
"""
from __future__ import annotations

from pyspark.sql.types import (BooleanType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampNTZType)

CONTENT = StructType([
    StructField("id", LongType(), False),
    StructField("url", StringType(), False),
    StructField("title", StringType()),
    StructField("content_hash", StringType()),
    StructField("original_text", StringType()),
    StructField("processed_text", StringType()),
    StructField("word_count", LongType()),
    StructField("filename", StringType()),
    StructField("file_path", StringType()),
    StructField("duration", DoubleType()),
    StructField("voice", StringType()),
    StructField("feed_id", LongType()),
    StructField("created_at", TimestampNTZType()),
    StructField("user_id", LongType()),
    StructField("is_processing", BooleanType()),
    StructField("is_processed", BooleanType()),
    StructField("error", StringType()),
])

USER = StructType([
    StructField("id", LongType(), False),
    StructField("username", StringType()),
    StructField("email", StringType()),
    StructField("is_active", BooleanType()),
    StructField("preferred_voice", StringType()),
    StructField("created_at", TimestampNTZType()),
    StructField("last_login", TimestampNTZType()),
    StructField("conversion_count", IntegerType()),
])

FEED = StructType([
    StructField("id", LongType(), False),
    StructField("url", StringType(), False),
    StructField("title", StringType()),
    StructField("description", StringType()),
    StructField("last_checked", TimestampNTZType()),
    StructField("last_updated", TimestampNTZType()),
    StructField("error_count", IntegerType()),
    StructField("is_active", BooleanType()),
    StructField("created_at", TimestampNTZType()),
    StructField("user_id", LongType()),
])

# Declared column lengths (advisory in some stores, enforced in others).
LENGTHS = {
    "content": {"url": 1024, "title": 255, "content_hash": 64, "filename": 255, "file_path": 1024, "voice": 50},
    "user": {"username": 64, "email": 120, "preferred_voice": 50},
    "feed": {"url": 1024, "title": 255},
}
