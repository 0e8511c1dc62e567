"""Rename and rollback as plans: what would happen to each row, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.paths import in_rollback_scope
from folioforge.functions.text import valid_file_name
from folioforge.operators.delta import last_of, running
from folioforge.operators.survey import with_seq


def approved(rows: DataFrame, column: str = "approval") -> DataFrame:
    """Rows that a person has approved, with a Y in any case; null is no approval."""
    return rows.filter(F.upper(F.trim(F.col(column))) == "Y")


def plan(rows: DataFrame, inventory: DataFrame, limit: int = 240) -> DataFrame:
    """``seq, item_id, path, new_path, status`` of approved rows.

    Checks in order: invalid name, source missing, path too long, target taken
    by another file or by an earlier row of the plan.  Two equi-joins with the
    inventory's paths.
    """
    p = approved(rows).withColumn("new_path", F.concat_ws("/", "folder", "suggested"))
    here = inventory.select("path", F.lit(True).alias("here"))
    there = inventory.select(F.col("path").alias("new_path"), F.lit(True).alias("there"))
    j = p.join(here, "path", "left").join(there, "new_path", "left")
    nth = F.row_number().over(Window.partitionBy("new_path").orderBy("seq"))
    status = (
        F.when(~valid_file_name(F.col("suggested")), "invalid_filename")
        .when(F.col("here").isNull(), "source_missing")
        .when(F.length("new_path") > limit, "path_too_long")
        .when(F.col("there") & (F.col("new_path") != F.col("path")), "target_exists")
        .when(nth > 1, "target_exists")
        .otherwise("success")
    )
    return j.select("seq", "item_id", "path", "new_path", status.alias("status"))


def chunks(rows: DataFrame, size: int = 20, order: str = "seq") -> DataFrame:
    """Batch number of each row, from 0."""
    return with_seq(rows, order, name="chunk").withColumn("chunk", F.floor((F.col("chunk") - 1) / size))


def outcome(log: DataFrame) -> DataFrame:
    """``processed, success`` of a log in one row."""
    return log.agg(F.count("*").alias("processed"), F.count_if(F.col("status") == "success").alias("success"))


def rename_progress(log: DataFrame) -> DataFrame:
    """``seq, processed, success, failed``: what a reader of the progress sees after each row of the log."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    return running(log.select("seq", "status"), {"processed": F.lit(1), "success": ok, "failed": ~ok}, "seq").drop("status")


def last_attempts(attempts: DataFrame, limit: int = 3) -> DataFrame:
    """What became of each item of a remote batch: ``item_id, tries, status, ok``.

    An item is tried until it is not throttled, ``limit`` times at most; the
    status after that many throttled tries is 0.
    """
    nth = F.row_number().over(Window.partitionBy("item_id").orderBy("ts", "attempt_id"))
    made = attempts.withColumn("n", nth).filter(F.col("n") <= limit)
    first_ok = made.groupBy("item_id").agg(F.min(F.when(F.col("status") != 429, F.struct("n", "status"))).alias("f"), F.max("n").alias("m"))
    status = F.coalesce(F.col("f.status"), F.when(F.col("m") >= limit, 0).otherwise(429))
    return first_ok.select("item_id", F.coalesce(F.col("f.n"), F.col("m")).alias("tries"), status.alias("status"), status.isin(200, 204).alias("ok"))


def retry(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows without a success in the log."""
    return rows.join(log.filter("status = 'success'").select("item_id").distinct(), "item_id", "left_anti")


def merged_results(files: DataFrame, key: str = "item_id", *order: str) -> DataFrame:
    """Result rows of several files, the last of each item."""
    return last_of(files.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), key, *(order or ("file_no", "line_no")))


def with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Names that a person has given, one for a path, replace the suggested ones: ``manually_edited`` is added."""
    j = rows.alias("r").join(edits.select("path", "name").alias("e"), F.col("r.path") == F.col("e.path"), "left")
    kept = [F.col(f"r.{c}") for c in rows.columns if c not in ("manually_edited", "suggested")]
    return j.select(*kept, F.col("e.path").isNotNull().alias("manually_edited"), F.coalesce("e.name", "r.suggested").alias("suggested"))


def rollback_rows(log: DataFrame) -> DataFrame:
    """What is needed to undo the successes of a log."""
    return log.filter("status = 'success'").select("seq", "item_id", "path", "new_path")


def rollback_plan(rollback: DataFrame, inventory: DataFrame, folders: list[str]) -> DataFrame:
    """``seq, step, item_id, path, new_path, status``: undo in reverse order what is in scope."""
    r = rollback.filter(in_rollback_scope(F.col("path"), folders))
    taken = inventory.select("path", F.lit(True).alias("taken"))
    there = inventory.select(F.col("path").alias("new_path"), F.lit(True).alias("there"))
    j = r.join(taken, "path", "left").join(there, "new_path", "left")
    status = F.when(F.col("there").isNull(), "skipped").when(F.col("taken"), "skipped").otherwise("restored")
    return with_seq(j.withColumn("back", -F.col("seq")), "back", name="step").select("seq", "step", "item_id", "path", "new_path", status.alias("status"))


def rollback_preview(rollback: DataFrame, folders: list[str]) -> DataFrame:
    """``total, filtered`` in one row: what could be undone, and what of it lies in the folders."""
    return rollback.agg(F.count("*").alias("total"), F.count_if(in_rollback_scope(F.col("path"), folders)).alias("filtered"))


def candidate_approval(rows: DataFrame) -> DataFrame:
    """Approve what has another name, is no collision and has an identifier."""
    ok = (F.col("name") != F.col("suggested")) & ~F.col("conflict") & F.col("item_id").isNotNull()
    return rows.withColumn("approval", F.when(ok, "Y").otherwise(""))


def affected_folders(log: DataFrame, ts: Column) -> DataFrame:
    """``folder, renamed, last``: folders with a success, how many and when the last."""
    done = log.filter("status = 'success'")
    return done.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("renamed"), F.max(ts).alias("last"))


def rollback_history(maps: DataFrame, runs: DataFrame) -> DataFrame:
    """Rollback files, newest first by ``mtime``, with how often and when last each was carried out."""
    done = runs.groupBy("file").agg(F.count("*").alias("times"), F.max("ts").alias("last"), F.sum("restored").alias("restored"))
    told = maps.join(done, "file", "left").withColumns({"times": F.coalesce("times", F.lit(0)), "restored": F.coalesce("restored", F.lit(0))})
    return told.orderBy(F.desc("mtime"), "file")
