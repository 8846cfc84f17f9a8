"""Small frames for the tests."""

from pyspark.sql import functions as F


def content(*texts):
    return [("text" if t is not None else "image", t, None) for t in texts]


def message_frame(spark, rows):
    """rows: (request_id, msg_idx, role, [texts]); None stands for an image block."""
    schema = ("request_id long, tenant_id string, msg_idx int, role string, "
              "content array<struct<type:string,text:string>>")
    data = [(r, t, i, role, [("text" if x is not None else "image", x) for x in texts]) for r, t, i, role, texts in rows]
    d = spark.createDataFrame(data, schema)
    return d.withColumn("content", F.transform("content", lambda b: F.struct(
        b["type"].alias("type"), b["text"].alias("text"), F.lit(None).cast("variant").alias("raw"))))
