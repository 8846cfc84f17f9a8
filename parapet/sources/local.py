"""Small driver-side tables (configs, plans) with a size that Catalyst knows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A frame of a few rows.  Handed over as Arrow it becomes a local relation,
    whose exact size lets lookups on it be broadcast."""
    if isinstance(schema, str):
        schema = _parse_datatype_string(schema)

    def shaped(value, kind):
        if value is not None and isinstance(kind, T.StructType):
            return {f.name: shaped(v, f.dataType) for f, v in zip(kind.fields, value)}
        return value

    items = [shaped(row, schema) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(items, schema=to_arrow_schema(schema)), schema)
