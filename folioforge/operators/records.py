"""Nested and semi-structured records: metadata maps, lenient JSON, OCR pages, mappings in HTML tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.config import LEGAL_KEYS


def lenient_json(raw: Column, schema: str) -> Column:
    """The string as JSON, else its outermost braces as JSON, else null."""
    inner = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)(\{.*\})", 1)
    ok = lambda c: F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{")
    return F.when(ok(raw), F.from_json(raw, schema)).when(ok(inner), F.from_json(inner, schema))


def response_text(raw: Column) -> Column:
    """Text parts of all candidates of a model's response, joined by line ends."""
    r = F.from_json(raw, "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>>")
    parts = F.flatten(F.transform(F.coalesce(r["candidates"], F.array()), lambda c: F.coalesce(c["content"]["parts"], F.array())))
    return F.trim(F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), "\n"))


def metadata_columns(rows: DataFrame, column: str = "metadata", keys: list[str] | None = None) -> DataFrame:
    """A map as one column for each key; absent keys are empty."""
    keys = keys or LEGAL_KEYS
    return rows.select(*(c for c in rows.columns if c != column), *(F.coalesce(F.try_element_at(F.col(column), F.lit(k)), F.lit("")).alias(k) for k in keys))


def metadata_only(column: Column, keys: list[str] | None = None) -> Column:
    """The map with the known keys alone."""
    return F.map_filter(column, lambda k, v: k.isin(*(keys or LEGAL_KEYS)))


def tags(rows: DataFrame, column: str, id_col: str = "item_id", sep: str = r"\s*[;,]\s*") -> DataFrame:
    """One row for each tag of a separated list."""
    return rows.select(id_col, F.explode(F.filter(F.split(F.trim(F.coalesce(column, F.lit(""))), sep), lambda t: t != "")).alias("tag"))


def merge_pages(pages: DataFrame, least: int = 40, timed_out: Column | None = None) -> DataFrame:
    """Recognised pages as one text: ``item_id, text, pages, failed_pages, mean_confidence, status``.

    A page counts if it has ``least`` characters; its number stands above its text.
    Where ``timed_out`` holds for a row of an item, what is there is only a part.
    """
    good = F.length(F.trim("text")) >= least
    marked = F.struct("page", F.concat(F.lit("===== PAGE "), (F.col("page") + 1).cast("string"), F.lit(" =====\n"), "text").alias("t"))
    g = pages.groupBy("item_id").agg(
        F.array_sort(F.collect_list(F.when(good, marked))).alias("p"),
        F.count("*").alias("pages"),
        F.array_sort(F.collect_list(F.when(~good, F.col("page") + 1))).alias("failed_pages"),
        F.coalesce(F.bround(F.avg(F.when(good, F.col("confidence"))), 3), F.lit(0.0)).alias("mean_confidence"),
        F.coalesce(F.bool_or(F.lit(False) if timed_out is None else timed_out), F.lit(False)).alias("late"),
    )
    text = F.array_join(F.transform("p", lambda x: x["t"]), "\n")
    return g.select("item_id", text.alias("text"), "pages", "failed_pages", "mean_confidence", F.when((F.size("p") > 0) & F.col("late"), "timeout_partial").when(F.size("p") > 0, "success").otherwise("ocr_empty_text").alias("status"))


def best_pass(passes: DataFrame) -> DataFrame:
    """Of several recognition passes of a page the one with the longest text, then the surest, then the first."""
    return passes.groupBy("item_id", "page").agg(F.max_by(F.struct("psm", "text", "confidence"), F.struct(F.length("text"), "confidence", (-F.col("pass_no")))).alias("b")).select("item_id", "page", "b.*")


def choose_pass(passes: DataFrame, least: int = 80, crop_below: float = 60.0, crop_margin: float = 0.10) -> DataFrame:
    """The recognition pass that counts for each page: ``item_id, page, psm, cropped, text, confidence``.

    Passes have ``psm`` (6 or 11), ``cropped``, ``text``, ``confidence`` and the
    page's ``margin_ratio``.  In order: an uncropped text of ``least`` characters,
    psm 6 first; else the longer uncropped one (psm 6 of equal ones), unless its
    confidence is below ``crop_below`` and the margin is wide enough.  Then a
    cropped text of psm 6 that is long enough, else the longest and surest of it,
    both cropped ones included.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    best = lambda test, *by: F.max_by(F.struct("psm", "cropped", "text", "confidence"), F.when(test, F.struct(*by)))
    first, whole = -F.col("psm"), ~F.col("cropped")
    g = passes.groupBy("item_id", "page").agg(
        best(whole & (n >= least), first).alias("enough"),
        best(whole, n, first).alias("longest"),
        best(F.col("cropped") & (F.col("psm") == 6) & (n >= least), first).alias("crop_enough"),
        best(F.col("cropped"), n, F.col("confidence"), first).alias("crop_longest"),
        F.max("margin_ratio").alias("margin"),
    )
    size = lambda c: F.length(F.coalesce(F.col(f"{c}.text"), F.lit("")))
    retried = (F.col("longest.confidence") < crop_below) & (F.col("margin") >= crop_margin) & F.col("crop_longest").isNotNull()
    surer = F.struct(size("crop_longest"), F.col("crop_longest.confidence")) > F.struct(size("longest"), F.col("longest.confidence"))
    chosen = F.when(F.col("enough").isNotNull(), F.col("enough")).when(~F.coalesce(retried, F.lit(False)), F.col("longest")).when(F.col("crop_enough").isNotNull(), F.col("crop_enough")).when(surer, F.col("crop_longest")).otherwise(F.col("longest"))
    return g.withColumn("c", chosen).select("item_id", "page", "c.*")


def fitted(width: Column, height: Column, limit: int) -> Column:
    """Struct of width and height with the longer side within ``limit``; 0 is no limit."""
    side = F.greatest(width, height)
    shrink = F.lit(limit > 0) & (side > limit)
    return F.struct(F.when(shrink, F.floor(width * limit / side)).otherwise(width).cast("int").alias("width"), F.when(shrink, F.floor(height * limit / side)).otherwise(height).cast("int").alias("height"))


def name_pairs(html: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Rows of a mapping table: original and changed path and name, from the first two cells of class ``cell-name``."""
    rows = F.regexp_extract_all(html_col, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    one = html.select(id_col, F.explode(rows).alias("row"))
    cell = r"(?is)(<td\b[^>]*class\s*=\s*[\"'][^\"']*\bcell-name\b[^\"']*[\"'][^>]*>.*?)</td>"
    one = one.withColumn("cells", F.regexp_extract_all("row", F.lit(cell), F.lit(1))).filter(F.size("cells") >= 2)
    title = lambda k: F.regexp_extract(F.get("cells", F.lit(k)), r"(?is)^<td\b[^>]*\btitle\s*=\s*[\"']([^\"']*)[\"']", 1)
    shown = lambda k: F.trim(F.regexp_replace(F.get("cells", F.lit(k)), r"(?s)<[^>]*>", ""))
    return one.select(id_col, title(0).alias("original_path"), shown(0).alias("original_name"), title(1).alias("changed_path"), shown(1).alias("changed_name"))


def rollback_items(raw: DataFrame, column: str = "value") -> DataFrame:
    """Items of a rollback file, an envelope or a bare list."""
    item = "struct<timestamp:string,original_full_path:string,new_full_path:string,original_file_name:string,new_file_name:string,sharepoint_item_id:string>"
    bare, envelope = F.from_json(column, f"array<{item}>"), F.from_json(column, f"struct<site_url:string,items:array<{item}>>")
    is_list = F.ltrim(F.col(column)).startswith("[")
    both = raw.select(F.when(is_list, bare).otherwise(envelope["items"]).alias("items"), F.when(~is_list, envelope["site_url"]).alias("site_url"))
    return both.select("site_url", F.posexplode("items").alias("position", "i")).select("site_url", "position", "i.*")


def site_counts(rows: DataFrame, url: Column) -> DataFrame:
    from folioforge.functions.paths import site_of

    return rows.select(site_of(url).alias("site")).filter("site <> ''").groupBy("site").count()


def resolve_drives(items: DataFrame, known: DataFrame, shares: DataFrame, sites: DataFrame) -> DataFrame:
    """``items`` with ``drive_id``: their own, else that of ``known`` (path), of ``shares`` (web_url), of ``sites`` (site), else null.

    Each of the tables has one row of a key; keys are looked up by equi-joins.
    """
    from folioforge.functions.paths import site_of

    own = F.col("drive_id") if "drive_id" in items.columns else F.lit(None).cast("string")
    told = items.select(*(c for c in items.columns if c != "drive_id"), own.alias("drive0"), site_of(F.col("web_url")).alias("site_key"))
    for n, (table, key, at) in enumerate(((known, "path", "path"), (shares, "web_url", "web_url"), (sites, "site", "site_key")), 1):
        told = told.join(table.select(F.col(key).alias(f"key{n}"), F.col("drive_id").alias(f"drive{n}")), F.col(at) == F.col(f"key{n}"), "left")
    return told.select(*(c for c in items.columns if c != "drive_id"), F.coalesce("drive0", "drive1", "drive2", "drive3").alias("drive_id"))


def api_record(rows: DataFrame) -> DataFrame:
    """What a client sees of a proposal: the suggested name or else the original one, confidence to three places, empty strings for nulls."""
    text = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "string" and f.name != "suggested"]
    out = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in text})
    return out.withColumns({"suggested": F.coalesce(F.nullif("suggested", F.lit("")), F.col("name")), "confidence": F.bround("confidence", 3), "extension": F.upper(F.ltrim("ext", F.lit(".")))})


def item_by_path(inventory: DataFrame, path: str) -> DataFrame:
    return inventory.filter(F.col("path") == path.strip("/"))


def item_by_share(inventory: DataFrame, url: str) -> DataFrame:
    """The item whose web address a share link names, with or without a query part."""
    return inventory.filter(F.col("web_url") == url.partition("?")[0])
