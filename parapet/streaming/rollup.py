"""Live outcome counts of the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

LATE = "tenant_id string, minute timestamp, outcome string, requests long"


def audit_rollup(log: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counts per tenant, minute and outcome; rows later than the delay are dropped.

    Dropped rows show up in the query's progress as ``numRowsDroppedByWatermark``.
    """
    return (log.withWatermark("ts", delay)
            .groupBy(F.window("ts", width).alias("w"), "tenant_id", "outcome")
            .agg(F.count("*").alias("requests"))
            .select(F.col("w.start").alias("minute"), "tenant_id", "outcome", "requests"))


def _late(key, batches, state):
    """Rows whose window had closed before their micro-batch began."""
    closed = state.getCurrentWatermarkMs()
    for pdf in batches:
        own = pdf[pdf["end_ms"] <= closed]
        counts = own.groupby(["minute", "outcome"], sort=False).size().reset_index(name="requests")
        yield counts.assign(tenant_id=key[0])[["tenant_id", "minute", "outcome", "requests"]]


def late_rows(log: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Counts of the rows that ``audit_rollup`` of the same stream leaves out, by tenant, minute and outcome.

    A minute may come in several rows, one for each micro-batch that brought late rows of it.
    """
    d = log.withWatermark("ts", delay).withColumn("w", F.window("ts", width)).select(
        "tenant_id", "outcome", F.col("w.start").alias("minute"), F.unix_millis("w.end").alias("end_ms"), "ts")
    return d.groupBy("tenant_id").applyInPandasWithState(_late, LATE, "seen boolean", "append", GroupStateTimeout.NoTimeout)
