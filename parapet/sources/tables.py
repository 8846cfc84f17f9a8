"""Reading and appending the audit log and the alert table.

The log grows by numbered batches.  A batch owns its folders (day, batch) and a folder with
its size; writing it again replaces exactly these, so a batch that failed half-way or is
replayed after a restart counts once.  Entries get increasing ids in order of arrival: batch by
batch, and inside a batch by time and request.  Rows that the log cannot hold are set aside
with the reason, and never stop the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import schemas
from parapet.operators.scan import numbered

OUTCOMES = ("passed", "input_blocked", "output_blocked", "rate_limited")


def _replace(df: DataFrame, path: str, *parts: str) -> None:
    """Write the frame over the partitions that it has rows in, in one commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _logged(spark: SparkSession, path: str, part: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/{part}")


def next_batch(spark: SparkSession, path: str) -> int:
    sizes = _logged(spark, path, "sizes")
    return 0 if sizes is None else int(sizes.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]) + 1


def write_audit(outcomes: DataFrame, path: str, batch: int | None = None, order: tuple[str, ...] = ("ts", "request_id")) -> None:
    """Write one batch of outcome rows; without a number, the next one.

    Batches are written in the order of their numbers, each by one writer at a time.  ``order`` names what
    rows of a batch arrive by; columns that the rows lack are left out.
    """
    spark = outcomes.sparkSession
    batch = next_batch(spark, path) if batch is None else batch
    sizes = _logged(spark, path, "sizes")
    before = 0 if sizes is None else int(sizes.where(F.col("batch") < batch).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    fault = (F.when(F.col("ts").isNull(), "no time").when(F.col("tenant_id").isNull(), "no tenant")
             .when(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)), "unknown outcome"))
    rows = outcomes.drop("id").withColumn("fault", fault)
    known = numbered(rows, [c for c in order if c in rows.columns], "id", "audit-batch").withColumn("batch", F.lit(batch))
    # faulty rows take a number too: their places show up as gaps
    known = known.withColumn("id", F.col("id") + before)
    _replace(known.where("fault IS NOT NULL"), f"{path}/aside", "batch")
    _replace(known.where("fault IS NULL").drop("fault").withColumn("dt", F.to_date("ts")), f"{path}/log", "dt", "batch")
    # the size comes last: a batch without one is not part of the log yet
    _replace(known.groupBy("batch").agg(F.count("*").alias("n")), f"{path}/sizes", "batch")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log's whole batches; columns added later are null (api: ``openai``) in older files."""
    d = _logged(spark, path, "log")
    if d is None:
        return spark.createDataFrame([], schemas.AUDIT_LOG)
    # one row per batch
    d = d.join(F.broadcast(_logged(spark, path, "sizes").select("batch").distinct()), "batch", "left_semi")
    for field in schemas.AUDIT_LOG.fields:
        if field.name not in d.columns:
            d = d.withColumn(field.name, F.lit(None).cast(field.dataType))
    return d.withColumn("api", F.coalesce("api", F.lit("openai")))


def read_set_aside(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows that could not be logged, with their ``fault``."""
    return _logged(spark, path, "aside")


def stream_audit(outcomes: DataFrame, path: str, checkpoint: str, **trigger):
    """Append a stream of outcome rows, each micro-batch under its own number."""
    trigger = trigger or {"availableNow": True}
    return (outcomes.writeStream.foreachBatch(lambda rows, n: write_audit(rows, path, n))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def write_alerts(alerts: DataFrame, path: str, form: str = "json") -> None:
    alerts.write.mode("append").format(form).save(path)
