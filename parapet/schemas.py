"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCK = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("raw", T.VariantType()),
])
CONTENT = T.ArrayType(BLOCK)

PII_SPAN = T.StructType([
    T.StructField("s", T.IntegerType()),
    T.StructField("e", T.IntegerType()),
    T.StructField("ptype", T.StringType()),
    T.StructField("value", T.StringType()),
])

# A policy as written in a config: every section and field may be missing.
RAW_POLICY = T.StructType([
    T.StructField("tenant_id", T.StringType(), False),
    T.StructField("input", T.StructType([
        T.StructField("pii", T.StructType([
            T.StructField("enabled", T.BooleanType()),
            T.StructField("action", T.StringType()),
            T.StructField("types", T.ArrayType(T.StringType())),
        ])),
        T.StructField("prompt_injection", T.StructType([
            T.StructField("enabled", T.BooleanType()),
            T.StructField("action", T.StringType()),
            T.StructField("threshold", T.DoubleType()),
        ])),
        T.StructField("topic_filter", T.StructType([
            T.StructField("enabled", T.BooleanType()),
            T.StructField("action", T.StringType()),
            T.StructField("blocked_topics", T.ArrayType(T.StringType())),
        ])),
    ])),
    T.StructField("output", T.StructType([
        T.StructField("max_length", T.IntegerType()),
        T.StructField("toxicity", T.StructType([
            T.StructField("enabled", T.BooleanType()),
            T.StructField("provider", T.StringType()),
            T.StructField("threshold", T.DoubleType()),
        ])),
        T.StructField("json_schema", T.StringType()),
    ])),
    T.StructField("rate_limit", T.StructType([
        T.StructField("enabled", T.BooleanType()),
        T.StructField("requests_per_minute", T.IntegerType()),
        T.StructField("requests_per_hour", T.IntegerType()),
    ])),
    T.StructField("webhook", T.StructType([
        T.StructField("enabled", T.BooleanType()),
        T.StructField("url", T.StringType()),
        T.StructField("on", T.ArrayType(T.StringType())),
    ])),
])

PROXY_KEY = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
])

PLAN = T.StructType([
    T.StructField("plan", T.StringType(), False),
    T.StructField("price_monthly", T.IntegerType()),
    T.StructField("monthly_requests", T.LongType()),
    T.StructField("rpm", T.IntegerType()),
    T.StructField("rph", T.IntegerType()),
])

AUDIT_LOG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("tenant_id", T.StringType()),
    T.StructField("api", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("completion_tokens", T.LongType()),
    T.StructField("messages", T.ArrayType(T.StructType([
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))),
])

CHUNK = T.StructType([
    T.StructField("stream_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("line", T.StringType()),
])
