"""Rows as JSON lines: payloads as objects, times as milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import COLUMNS

_WIRE = "scope string, docId string, aType string, aUid string, axbType string, bType string, bUid string, data variant, v int, createdAt long, updatedAt long"


def to_wire(rows: DataFrame) -> DataFrame:
    """One column `value`, a JSON object for each row."""
    flat = rows.withColumns({c: F.unix_millis(c) for c in ("createdAt", "updatedAt")})
    return flat.select(F.to_json(F.struct(*COLUMNS)).alias("value"))


def from_wire(lines: DataFrame) -> DataFrame:
    """Rows of the triple table from a column `value`; lines that aren't such objects fail the job."""
    rows = lines.select(F.from_json("value", _WIRE, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.withColumns({c: F.timestamp_millis(c) for c in ("createdAt", "updatedAt")}).select(*COLUMNS)


def export_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    to_wire(rows).write.mode(mode).text(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    return from_wire(spark.read.text(path))
