"""Exact deduplication as a stateful stream (DataFrame and SQL functions only).

A stream over the documents keeps one state row per digest of the normalised text:
the digest, the identifier that stays, the locator (file and row) of its content and
the number of rows seen.  The state lives in RocksDB under the stream's checkpoint in
the shared folder and never expires, so a later run over new files goes on from it.
The stream's state is then read as a table and every row meets it again; rows with
one digest are held against each other byte by byte, and should two texts ever share
a digest, the rows of that digest are grouped by their text instead.

Defined results: a null text counts as empty; the smallest id stays, a null id only if
its group has no other; of rows that repeat an id, the first by file and row stays; an
empty table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet.llm.texts import apart, spaced
from parapet.storage import new_path, remove, written

#: disk-backed state; a store is closed as soon as its task has committed, since each holds some MB of disk
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def located(rows: DataFrame, digest: Callable[[Column], Column], id_col: str, text_col: str, *more: Column) -> DataFrame:
    norm = spaced(F.col(text_col))
    return rows.select(
        digest(norm).alias("_digest"), F.col(id_col).alias("_id"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), *more)


def update_state(spark: SparkSession, path: str, checkpoint: str, digest=sha256, id_col: str = "doc_id",
                 text_col: str = "text", files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over what ``path`` holds beyond earlier runs; return the state as a table.

    Columns: _digest, _keep (orderable struct of the row that stays: no_id, id, file, row), _n.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    keep = F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"),
                          F.col("_file").alias("file"), F.col("_row").alias("row")))
    # as a pattern, because a stream takes a single file by pattern only
    state = located(reader.parquet(f"{path[:-1]}[{path[-1]}]"), digest, id_col, text_col).groupBy("_digest").agg(
        keep.alias("_keep"), F.count(F.lit(1)).alias("_n"))
    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    try:
        for k, v in STATE_SETTINGS.items():
            spark.conf.set(k, v)
        query = (state.writeStream.outputMode("update").format("noop")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    stored = spark.read.format("statestore").load(checkpoint)
    fields = stored.schema["value"].dataType.names
    return stored.select(F.col("key._digest").alias("_digest"), F.col("value")[fields[0]].alias("_keep"),
                         F.col("value")[fields[1]].alias("_n"))


def exact_groups(spark: SparkSession, path: str, digest=sha256, id_col: str = "doc_id", text_col: str = "text",
                 checkpoint: str | None = None) -> DataFrame:
    """One row per row of the Parquet table at ``path``.

    Columns: _id, _file, _row, keep_id, group_size, kept, _digest.
    """
    given = spark.read.parquet(path)
    if not given.limit(1).count():
        kind = given.schema[id_col].dataType.simpleString()
        return spark.createDataFrame([], f"_id {kind}, _file string, _row long, keep_id {kind}, group_size long, "
                                         "kept boolean, _digest binary")
    at = checkpoint or new_path(spark, "seen")
    state = written(update_state(spark, path, at, digest, id_col, text_col), "seen-table")
    if checkpoint is None:
        remove(spark, at)
    docs = spark.read.parquet(path)
    # full bytes as grouping keys: copies fold before the shuffle, so a hot text is one row a task
    texts = located(docs, digest, id_col, text_col, spaced(F.col(text_col)).alias("_norm")).groupBy(
        "_digest", "_norm").agg(F.count(F.lit(1)).alias("_n"))
    shared = texts.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts")).where("_texts > 1").select("_digest")
    shared = written(shared, "shared-digest")
    rows = located(docs, digest, id_col, text_col)
    at_place = (F.col("_file") == F.col("_keep.file")) & (F.col("_row") == F.col("_keep.row"))
    cols = ["_id", "_file", "_row", F.col("_keep.id").alias("keep_id"), F.col("_n").alias("group_size"),
            at_place.alias("kept"), "_digest"]
    if shared.isEmpty():
        return rows.join(state, "_digest").select(*cols)
    # exact way for digests of more than one text
    good = rows.join(state.join(shared, "_digest", "left_anti"), "_digest").select(*cols)
    again = located(docs, digest, id_col, text_col, spaced(F.col(text_col)).alias("_norm")).join(
        shared, "_digest", "left_semi")
    own = again.groupBy("_digest", "_norm").agg(
        F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_file").alias("file"),
                       F.col("_row").alias("row"))).alias("_keep"), F.count(F.lit(1)).alias("_n"))
    return good.unionByName(again.join(own, ["_digest", "_norm"]).select(*cols))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The frame without rows whose text another row has already; all its columns stay.

    The frame is written to the shared folder first, so that the stream has files to read.
    """
    spark = docs.sparkSession
    own, own_id, own_text = apart(docs, id_col, text_col)
    place = written(own, "dedup-input")
    path = place.inputFiles()[0].rsplit("/", 1)[0] if place.inputFiles() else None
    if path is None:
        return docs
    gone = exact_groups(spark, path, id_col=own_id, text_col=own_text).where(~F.col("kept")).select("_file", "_row")
    rows = place.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(gone, ["_file", "_row"], "left_anti").select(*own.columns).toDF(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_groups(spark, f"{sf_dir}/documents.parquet").select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
