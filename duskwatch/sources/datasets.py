"""Scans of flow datasets stored as CSV."""

from __future__ import annotations

from collections.abc import Iterable
import csv

from pyspark.sql import DataFrame, SparkSession

from duskwatch.functions import rules


def column_names(header: Iterable[str]) -> list[str]:
    """Trimmed header names; a repeated name gets the suffix ``.1``, ``.2``, ..."""
    seen: dict[str, int] = {}
    names = []
    for raw in header:
        name = raw.strip()
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return names


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under trimmed, distinct names. A missing file is an error.

    Only the header line is read ahead, to name the columns.
    """
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError(f"{path} is empty")
    names = column_names(next(csv.reader([first[0]])))
    schema = ", ".join(f"`{n}` STRING" for n in names)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def read_unsw_csv(spark: SparkSession, path: str) -> DataFrame:
    """UNSW rows; the id, category, label and categorical columns must be there."""
    df = read_flow_csv(spark, path)
    missing = {*rules.UNSW_NON_FEATURES, *rules.UNSW_CATEGORICAL} - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    return df
