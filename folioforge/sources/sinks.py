"""Tables and files that a run leaves behind."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.survey import extension_breakdown, folder_rollup, headline


def review_table(rows: DataFrame, path: str, order: str = "item_id") -> None:
    """The canonical review table, with empty columns for the reviewer."""
    for c in ("approval", "reviewer_comment"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    rows.sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def review_csv(rows: DataFrame, path: str) -> None:
    """The review table as CSV with a header, replacing what is there."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def rename_log(log: DataFrame, path: str) -> None:
    """Add a log to those below ``path``, as JSON and as CSV."""
    log.write.mode("append").json(f"{path}/json")
    log.write.mode("append").option("header", True).csv(f"{path}/csv")


def rollback_map(rollback: DataFrame, path: str, site_url: str = "") -> bool:
    """Written only if there is something to undo."""
    if rollback.isEmpty():
        return False
    rollback.withColumn("site_url", F.lit(site_url)).write.mode("overwrite").json(path)
    return True


def summary_json(row: DataFrame) -> str:
    """A one-row aggregate as JSON text."""
    return json.dumps(row.first().asDict(), default=str)


def mapping_csv(pairs: DataFrame, path: str) -> None:
    """Original and changed names of :func:`records.name_pairs`, for another program."""
    pairs.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_lines(rows: DataFrame, path: str) -> None:
    """Rows as a client downloads them: one JSON object on a line, nulls included."""
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def survey_cache(files: DataFrame, path: str) -> None:
    """The survey of an inventory, to be shown again without a scan: its headline, folders and extensions."""
    headline(files).write.mode("overwrite").json(f"{path}/headline")
    folder_rollup(files).write.mode("overwrite").parquet(f"{path}/folders")
    extension_breakdown(files).write.mode("overwrite").parquet(f"{path}/extensions")


def cache(rows: DataFrame, path: str, version: int) -> None:
    """Results under their key, partitioned by schema version; other versions stay."""
    rows.withColumn("schema_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema_version").parquet(path)
