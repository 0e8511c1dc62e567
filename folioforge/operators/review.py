"""Review: why a proposal needs a person, what the tabs show, and collisions of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import NEUTRAL, RulePack
from folioforge.functions.dates import UNKNOWN, suffix_is_valid
from folioforge.functions.fmt import percent
from folioforge.functions.paths import stem

#: What an extraction status means, by equality or beginning.
EQUAL = {"empty_text": "no text found", "ocr_empty_text": "no text found", "insufficient_text_no_ocr": "too little text, OCR not run", "manual_review_required": "format needs a person", "unsupported_inference": "format not supported, inferred from names"}
BEGINS = {"missing_dependency": "library missing", "error:": "extraction failed", "worker_error:": "extraction failed", "advanced_ocr:": "OCR failed"}


def status_label(status: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in EQUAL.items():
        out = out.when(status == k, v)
    for k, v in BEGINS.items():
        out = out.when(status.startswith(k), v)
    return out.otherwise(F.concat(F.lit("extraction failed ("), status, F.lit(")")))


def review_reason(status: Column, ocr_low: Column, title: Column, date: Column, file_name: Column, confidence: Column, conflict: Column, threshold: float) -> Column:
    """The first reason in order, or null."""
    low = F.concat(F.lit("confidence "), percent(confidence).cast("string"), F.lit(f"% < {round(threshold * 100)}%"))
    return (
        F.when(status != "success", status_label(status))
        .when(ocr_low, "OCR quality low")
        .when(F.coalesce(title, F.lit("")) == "", "title unknown")
        .when((date == UNKNOWN) & ~suffix_is_valid(stem(file_name)), "date unknown")
        .when(confidence < threshold, low)
        .when(conflict, "name taken twice")
    )


def number_collisions(rows: DataFrame, *, folder: str = "folder", name: str = "suggested", seq: str = "seq") -> DataFrame:
    """Proposals of one path in any case all get a number in the order of ``seq``: ``conflict, final_name`` are added.

    The rank is taken within a collision alone; a proposal that is alone in its
    path gets none.
    """
    w = Window.partitionBy(F.lower(F.concat_ws("/", folder, name)))
    n, k = F.count("*").over(w), F.row_number().over(w.orderBy(seq))
    numbered = F.concat(stem(F.col(name)), F.lit("("), k.cast("string"), F.lit(")"), F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    clash = (n > 1) & (F.coalesce(F.col(name), F.lit("")) != "")
    return rows.withColumns({"conflict": clash, "final_name": F.when(clash, numbered).otherwise(F.col(name))})


def rewrite_generic(rows: DataFrame, rules: RulePack = NEUTRAL, limit: int = 40) -> DataFrame:
    """A generic summary that several documents share gets its case's or institution's name in front.

    Rows of other summaries are each in a window of their own key, so that none
    of them meet, and the proposals are computed once.
    """
    key = F.rtrim(F.lower(F.trim("summary")), F.lit("."))
    key = F.when(key.isin(*rules.generic_summaries), key).otherwise(F.concat(F.lit("-"), F.xxhash64("path").cast("string")))
    often = (F.count("*").over(Window.partitionBy(key)) > 1) & ~key.startswith("-")
    who = F.coalesce(F.nullif("case_name", F.lit("")), F.nullif("institution", F.lit("")))
    merged = F.concat_ws(" ", who, "summary")
    merged = F.when(F.length(merged) > limit, F.concat(F.rtrim(F.substring(merged, 1, limit - 1)), F.lit("."))).when(merged.endswith("."), merged).otherwise(F.concat(F.rtrim(merged, F.lit(" .!?,;:")), F.lit(".")))
    told = rows.select(F.struct(*rows.columns).alias("row"), "summary", "case_name", "institution", often.alias("often"))
    told = told.withColumn("made", F.when(F.col("often") & who.isNotNull(), merged).otherwise(F.col("summary")))
    return told.select(*(F.col("made").alias(c) if c == "summary" else F.col(f"row.{c}") for c in rows.columns))


def badge(status: Column, needs_review: Column, conflict: Column, in_scope: Column) -> Column:
    """What a row shows: the first that holds of renamed, failed, error, out_of_scope, conflict, review, else auto."""
    return F.when(status == "renamed", "renamed").when(status == "rename_failed", "failed").when(status == "analysis_error", "error").when(~in_scope, "out_of_scope").when(conflict, "conflict").when(needs_review, "review").otherwise("auto")


def tab(rows: DataFrame, which: str) -> DataFrame:
    """Rows of a review tab: all, auto, review or conflict."""
    auto = ~F.col("needs_review") & ~F.col("conflict") & (F.col("status") != "analysis_error") & F.col("in_scope")
    tests = {"all": F.lit(True), "auto": auto, "review": F.col("needs_review") & ~F.col("conflict"), "conflict": F.col("conflict")}
    return rows.filter(tests[which])


def approval_counts(rows: DataFrame) -> DataFrame:
    """Five counts of a review table in one row: other names, out of scope, collisions, need a person, approved.

    ``needs_review`` can be a flag or what a person typed, TRUE or Y in any case;
    a name counts as another if exactly one of the two is null, too.
    """
    person = F.upper(F.trim(F.col("needs_review").cast("string"))).isin("TRUE", "Y")
    return rows.agg(
        F.count_if(~F.col("name").eqNullSafe(F.col("suggested"))).alias("different_names"),
        F.count_if(F.col("status") == "out_of_scope").alias("out_of_scope"),
        F.count_if(F.col("status") == "duplicate_conflict").alias("conflicts"),
        F.count_if(person).alias("needs_manual"),
        F.count_if(F.col("approval") == "Y").alias("approved"),
    )


def manual_sample(rows: DataFrame, n: int = 10, order: str = "seq") -> DataFrame:
    """The first ``n`` rows that need a person, in order: a top-k."""
    return rows.filter(F.coalesce(F.col("needs_review"), F.lit(False))).orderBy(order).limit(n)


def tab_counts(rows: DataFrame) -> DataFrame:
    """Rows behind each tab, and those whose analysis failed, in one row."""
    auto = ~F.col("needs_review") & ~F.col("conflict") & (F.col("status") != "analysis_error") & F.col("in_scope")
    return rows.agg(F.count_if(auto).alias("auto"), F.count_if(F.col("needs_review") & ~F.col("conflict")).alias("review"), F.count_if("conflict").alias("conflict"), F.count_if(F.col("status") == "analysis_error").alias("error"))
