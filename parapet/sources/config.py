"""Policy and key files: small configs read once on the driver into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parapet import fixed_values as fv
from parapet import schemas
from parapet.sources.local import local_table


def _pick(section, schema, rename=None):
    """Fields of a config section by schema; a missing section stays null."""
    if section is None:
        return None
    out = []
    for field in schema.fields:
        value = section.get(field.name)
        if value is None and rename and field.name in rename:
            value = section.get(rename[field.name])
        if hasattr(field.dataType, "fields"):
            value = _pick(value, field.dataType)
        elif field.name == "json_schema" and value is not None and not isinstance(value, str):
            import json
            value = json.dumps(value)
        elif field.name == "threshold" and value is not None:
            value = float(value)
        out.append(value)
    return tuple(out)


def policies_from_dict(spark: SparkSession, config: dict) -> DataFrame:
    """Raw policies of a parsed config: ``{"tenants": {name: sections}}``.

    An ``on`` key that a YAML reader turned into ``true`` is accepted.
    """
    rows = []
    for tenant, cfg in (config.get("tenants") or {}).items():
        cfg = cfg or {}
        row = [tenant]
        for field in schemas.RAW_POLICY.fields[1:]:
            row.append(_pick(cfg.get(field.name), field.dataType, {"on": True}))
        rows.append(tuple(row))
    return local_table(spark, rows, schemas.RAW_POLICY)


def _yaml(path: str) -> dict:
    import yaml
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Raw policies from a YAML file, or from a JSON or Parquet table."""
    if path.endswith((".yaml", ".yml")):
        return policies_from_dict(spark, _yaml(path))
    reader = spark.read.schema(schemas.RAW_POLICY)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def keys_from_dict(spark: SparkSession, config: dict) -> DataFrame:
    """Proxy keys from a map (key to settings) or a list of entries with a ``key``."""
    keys = config.get("keys") or {}
    entries = keys.items() if isinstance(keys, dict) else ((k.get("key"), k) for k in keys)
    rows = [(key, (cfg or {}).get("name", "unnamed"), (cfg or {}).get("tenant_id", fv.DEFAULT_TENANT),
             (cfg or {}).get("enabled", True)) for key, cfg in entries if key]
    return local_table(spark, rows, schemas.PROXY_KEY)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith((".yaml", ".yml")):
        return keys_from_dict(spark, _yaml(path))
    keys = spark.read.schema(schemas.PROXY_KEY)
    keys = keys.json(path) if path.endswith((".json", ".jsonl")) else keys.parquet(path)
    return keys.withColumn("enabled", F.coalesce("enabled", F.lit(True)))
