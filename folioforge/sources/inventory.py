"""Scans that make inventories: folders of files, listings, snapshots and result tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.config import Settings
from folioforge.functions import paths
from folioforge.operators.delta import last_of
from folioforge.operators.survey import supported, with_seq


def scan_folder(spark: SparkSession, root: str, settings: Settings | None = None, recursive: bool = True, limit: int = 0) -> DataFrame:
    """Metadata of the files below ``root``, numbered in the order of their paths; contents are not read."""
    s = settings or Settings()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/*", "/")
    full = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.ltrim(F.substr(full, F.length(base) + 1), F.lit("/"))
    f = raw.select(
        F.lit(root).alias("root_path"),
        full.alias("full_path"),
        rel.alias("path"),
        paths.folder(rel).alias("folder"),
        paths.file_name(rel).alias("name"),
        paths.extension(rel).alias("ext"),
        F.col("length").alias("size"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"),
    )
    f = f.withColumn("supported", supported(allow=s.supported, deny=s.excluded))
    return with_seq(f.orderBy("full_path").limit(limit) if limit else f, "full_path")


def contents(spark: SparkSession, root: str) -> DataFrame:
    """``full_path, content`` of the files below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(F.regexp_replace("path", r"^file:/*", "/").alias("full_path"), "content")


def listing(items: DataFrame) -> DataFrame:
    """Files of a library listing: ``item_id, folder, name, ext, path, size, modified, web_url``.

    Items are ``id, name, size, lastModifiedDateTime, file, folder, parentReference, webUrl``;
    of repeated identifiers the last row of the feed (``seq``) counts, and items
    without a file part are folders.
    """
    last = last_of(items, "id", "seq") if "seq" in items.columns else items
    f = last.filter(F.col("file").isNotNull())
    folder = F.ltrim(paths.provider_folder(F.col("parentReference.path")), F.lit("/"))
    return f.select(
        F.col("id").alias("item_id"), folder.alias("folder"), "name", paths.extension(F.col("name")).alias("ext"),
        F.concat_ws("/", F.nullif(folder, F.lit("")), "name").alias("path"), F.coalesce("size", F.lit(0)).alias("size"),
        F.col("lastModifiedDateTime").alias("modified"), F.coalesce("webUrl", F.lit("")).alias("web_url"),
    )


def with_parents(items: DataFrame, folders: DataFrame) -> DataFrame:
    """Items below a known folder, with its path."""
    return items.join(folders.select(F.col("id").alias("parent_id"), F.col("path").alias("parent_path")), "parent_id")


def from_snapshot(index: DataFrame, root: str = "", settings: Settings | None = None) -> DataFrame:
    """An inventory from a saved index, without a scan: the root's prefix goes, rows are numbered anew."""
    s = settings or Settings()
    rel = F.when(F.col("path").startswith(root.rstrip("/") + "/"), F.substr("path", F.lit(len(root.rstrip("/")) + 2))).otherwise(F.col("path")) if root else F.col("path")
    return with_seq(index.withColumn("path", rel).withColumn("folder", paths.folder(F.col("path"))).withColumn("supported", supported(allow=s.supported, deny=s.excluded)), "folder", "name")


def review_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a review table: Parquet, CSV with a header, or a workbook."""
    if path.endswith((".xlsx", ".xlsm")):
        from folioforge.sources.extract import workbook_rows

        def rows(frames, heads_only: bool):
            for frame in frames:
                for content in frame["content"]:
                    found = workbook_rows(content)
                    yield pd.DataFrame({"r": found[:1] if heads_only else found})

        books, kind = contents(spark, path).select("content"), "r map<string,string>"
        # every row of a workbook has the columns of its header, so its first row names them
        heads = books.mapInPandas(lambda frames: rows(frames, True), kind)
        keys = [r[0] for r in heads.select(F.explode(F.map_keys("r"))).distinct().collect()]
        return books.mapInPandas(lambda frames: rows(frames, False), kind).select(*(F.col("r")[k].alias(k) for k in sorted(keys)))
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.parquet(path)


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def versioned(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A cache table's rows of one schema version; partitions of others aren't read."""
    return spark.read.parquet(path).filter(F.col("schema_version") == version)
