"""Labelled scenarios from YAML, where a YAML reader is installed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

try:
    import yaml
except ImportError:
    yaml = None

SCHEMA = "name string, expected_status string, expected_rule string, expected_reasons array<string>, payload string"


def load_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """A row for each scenario; the whole case as JSON in payload. A few dozen rows, read on the driver."""
    import json

    if yaml is None:
        raise RuntimeError("reading scenarios needs PyYAML")
    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f)
    cases = doc["scenarios"] if isinstance(doc, dict) and "scenarios" in doc else doc
    rows = [(c["name"], c.get("expected_status"), c.get("expected_rule"), c.get("expected_reasons") or [], json.dumps(c, default=str, sort_keys=True)) for c in cases]
    return spark.createDataFrame(rows, SCHEMA)
