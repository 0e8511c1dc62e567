"""Inventory, extraction and change-feed views derived from the benchmark tables.

The engine's operators take inventories of files; these views make such
inventories from the tables at hand, deterministically, so that the same rows can
be derived in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".pdf", ".docx", ".xlsx", ".png", ".eml", ".zip", ""]
STATUSES = ["success"] * 7 + ["empty_text", "ocr_empty_text", "manual_review_required", "error:parse"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], n: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, folder, name, ext, path, size, modified`` of a file for each document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    d = d.withColumn("ext", _pick(EXTENSIONS, i))
    d = d.withColumn("folder", F.concat_ws("/", "lang", "source", F.concat((i % 5 + 1).cast("string"), F.lit(". cat"))))
    d = d.withColumn("name", F.concat(F.when(i % 13 == 0, "~$").otherwise(""), F.col("source"), F.lit("_"), i.cast("string"), F.col("ext")))
    modified = F.date_format(F.timestamp_seconds(F.lit(1704067200) + i * 60), "yyyy-MM-dd'T'HH:mm:ss")
    return d.select(F.col("doc_id").alias("item_id"), "folder", "name", "ext", F.concat_ws("/", "folder", "name").alias("path"), F.col("n_chars").alias("size"), modified.alias("modified"))


#: The same view for an SQL engine.
FILES_SQL = """
v_ext AS (SELECT *, CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.xlsx' WHEN 3 THEN '.png' WHEN 4 THEN '.eml' WHEN 5 THEN '.zip' ELSE '' END AS ext FROM documents),
v_named AS (SELECT *, lang || '/' || source || '/' || (doc_id % 5 + 1) || '. cat' AS folder, CASE WHEN doc_id % 13 = 0 THEN '~$' ELSE '' END || source || '_' || doc_id || ext AS name FROM v_ext),
v_files AS (SELECT doc_id AS item_id, folder, name, ext, folder || '/' || name AS path, n_chars AS size, strftime(TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%S') AS modified FROM v_named)"""


def extraction_status(item_id: F.Column) -> F.Column:
    """What came of reading an item; an item without a number can't be read."""
    return F.coalesce(_pick(STATUSES, item_id), F.lit("error:parse"))


def extractions(spark: SparkSession, sf_dir: str, excerpt_chars: int = 8000) -> DataFrame:
    """``item_id, extraction_status, text_excerpt`` of each document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), extraction_status(F.col("doc_id")).alias("extraction_status"), F.substring("text", 1, excerpt_chars).alias("text_excerpt"))


def snapshot_and_feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An older inventory, and the feed of what has changed since: ``op`` is ``upsert`` or ``delete``.

    Of an item's rows the one with the largest ``seq`` counts: some were deleted
    and came back, others were changed before they were deleted.
    """
    f, i = files(spark, sf_dir), F.col("item_id")
    old = f.filter(i % 10 != 0)
    changed = f.filter((i % 10 == 0) | (i % 17 == 3) | (i % 19 == 5) | (i % 23 == 7))
    op = F.when((i % 17 == 3) & (i % 10 != 0), "delete").otherwise("upsert")
    moved = F.when((i % 19 == 5) & (i % 10 != 0), "2025-01-01T00:00:00").otherwise(F.col("modified"))
    last = changed.select("item_id", op.alias("op"), "name", "folder", "ext", "path", "size", moved.alias("modified"), (i * 2 + 1).alias("seq"))
    again = last.filter((i % 23 == 7) | (F.col("op") == "delete"))
    first = again.withColumns({"op": F.when(F.col("op") == "delete", "upsert").otherwise("delete"), "modified": F.lit("2026-01-01T00:00:00"), "seq": i * 2})
    return old, last.unionByName(first)


FEED_SQL = FILES_SQL + """,
v_old AS (SELECT * FROM v_files WHERE item_id % 10 <> 0),
v_last AS (SELECT item_id, CASE WHEN item_id % 17 = 3 AND item_id % 10 <> 0 THEN 'delete' ELSE 'upsert' END AS op, name, folder, ext, path, size,
                  CASE WHEN item_id % 19 = 5 AND item_id % 10 <> 0 THEN '2025-01-01T00:00:00' ELSE modified END AS modified, item_id * 2 + 1 AS seq
           FROM v_files WHERE item_id % 10 = 0 OR item_id % 17 = 3 OR item_id % 19 = 5 OR item_id % 23 = 7),
v_rows AS (SELECT * FROM v_last UNION ALL SELECT item_id, CASE op WHEN 'delete' THEN 'upsert' ELSE 'delete' END, name, folder, ext, path, size, '2026-01-01T00:00:00', item_id * 2 FROM v_last WHERE item_id % 23 = 7 OR op = 'delete'),
v_feed AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS k FROM v_rows) WHERE k = 1)"""


def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, s``: order dates in eight forms, one of them impossible and one without a date."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    f = lambda p: F.date_format("d", p)
    forms = [f("yyyy-MM-dd"), f("yyyy.M.d"), F.concat(F.lit("dated "), f("yyyyMMdd")), F.concat(f("yy"), F.lit("."), f("MM"), F.lit("."), f("dd")), F.concat(f("dd"), F.lit("/"), f("MM"), F.lit("/"), f("yyyy")), F.concat(f("yyyy"), F.lit("-"), f("MM"), F.lit(" report")), F.concat(f("yyyy"), F.lit("-02-30")), F.lit("no day here")]
    s = forms[7]
    for k in range(7):
        s = F.when(F.col("o_orderkey") % 8 == k, forms[k]).otherwise(s)
    return o.select("o_orderkey", "d", s.alias("s"))


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved and unapproved proposals, with collisions: ``seq, item_id, folder, name, ext, suggested, approval``."""
    f, i = files(spark, sf_dir), F.col("item_id")
    suggested = F.when(i % 29 == 0, F.concat(F.lit("bad:"), F.col("name"))).otherwise(F.concat(F.lit("Doc_"), (F.col("size") % 50).cast("string"), F.col("ext")))
    return f.select((i + 1).alias("seq"), i, "folder", "name", "ext", "path", suggested.alias("suggested"), F.when(i % 3 == 0, " y").when(i % 3 == 1, "Y").otherwise("").alias("approval"))


PLAN_SQL = FILES_SQL + """,
v_plan AS (SELECT item_id + 1 AS seq, item_id, folder, name, ext, path,
                  CASE WHEN item_id % 29 = 0 THEN 'bad:' || name ELSE 'Doc_' || (size % 50) || ext END AS suggested,
                  CASE item_id % 3 WHEN 0 THEN ' y' WHEN 1 THEN 'Y' ELSE '' END AS approval FROM v_files)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries of a remote batch: ``item_id, attempt_id, ts, status``; an error is throttling."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("attempt_id"), "ts", F.when(F.col("event_type") == "error", 429).otherwise(200).alias("status"))


ATTEMPTS_SQL = "v_attempts AS (SELECT user_id AS item_id, event_id AS attempt_id, ts, CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status FROM events)"


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of recognised text: ``item_id, page, text, confidence``."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("page"), "text", (F.length("text") % 100).cast("double").alias("confidence"))
