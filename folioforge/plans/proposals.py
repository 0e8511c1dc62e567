"""The proposal pipeline: scope, fields, name, confidence, review and collisions.

Stages are ``withColumns`` over one narrow projection; the only shuffle is that of
the collision pass, over the row's own columns and not its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.config import Settings
from folioforge.functions import dates, paths
from folioforge.functions import text as T
from folioforge.operators import quick, review
from folioforge.operators.survey import supported

#: Fields that an enricher may add to an extraction.
GIVEN = ["doc_type", "institution", "document_date", "keyword", "summary", "document_title", "original_title", "reason"]


def analysis_scope(files: DataFrame, settings: Settings) -> DataFrame:
    """``in_scope, supported`` and the status that short-circuits extraction."""
    rules = settings.rules
    f = files.withColumns({"in_scope": paths.in_rename_scope(F.col("path"), rules), "supported": supported(allow=settings.supported, deny=settings.excluded)})
    return f.withColumn("skip_status", F.when(~F.col("in_scope"), "skipped_out_of_scope").when(~F.col("supported"), "unsupported_inference"))


def should_enrich(status: F.Column, excerpt: F.Column, enabled: bool = True) -> F.Column:
    return F.lit(enabled) & (status == "success") & (F.trim(F.coalesce(excerpt, F.lit(""))) != "")


def propose(rows: DataFrame, settings: Settings | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A proposal for each row of ``item_id, path, folder, name, ext, extraction_status, text_excerpt``.

    ``enrich`` may add the columns ``GIVEN`` (strings) and ``confidence`` from
    any source; it gets the rows that have a text and a good status, and without
    it they are empty.  Optional columns ``ocr_used``,
    ``ocr_mean_confidence`` and ``ocr_quality_low`` default to none.
    """
    settings = settings or Settings()
    r = settings.rules
    c = rows
    if enrich:
        due = F.coalesce(should_enrich(F.col("extraction_status"), F.col("text_excerpt")), F.lit(False))
        c = enrich(rows.filter(due)).unionByName(rows.filter(~due), allowMissingColumns=True)
    empty = {k: F.lit("") for k in GIVEN if k not in c.columns}
    if "confidence" not in c.columns:
        empty["confidence"] = F.lit(None).cast("double")
    for k, v in (("ocr_used", F.lit(False)), ("ocr_quality_low", F.lit(False)), ("ocr_mean_confidence", F.lit(0.0))):
        if k not in c.columns:
            empty[k] = v
    c = c.withColumns(empty).withColumn("text_excerpt", F.coalesce("text_excerpt", F.lit("")))
    name, text = F.col("name"), F.col("text_excerpt")
    c = c.withColumns({
        "_stem": paths.stem(name),
        "_hint": paths.folder_hint(F.col("path")),
        "case_name": paths.case_name(F.col("path")),
        "institution": T.sanitize(F.coalesce(T.blank_to_null(F.col("institution")), T.first_contained(r.institutions, F.concat(name, F.lit("\n"), F.substring(text, 1, 1500))))),
        "revision_note": paths.revision_note(name, r),
        "_quality": T.source_quality(text),
    })
    kind = T.first_contained(r.doc_types, F.concat_ws("\n", F.trim(F.concat_ws(" ", name, "_hint")), F.substring(text, 1, 2000)))
    low_ocr = F.col("ocr_used") & (F.col("ocr_mean_confidence") > 0) & (F.col("ocr_mean_confidence") < settings.keyword_confidence)
    told = T.keyword_token(F.col("keyword"), r)
    c = c.withColumns({
        "doc_type": F.coalesce(T.blank_to_null(T.sanitize(F.coalesce(T.blank_to_null(F.col("doc_type")), kind))), F.lit(r.default_type)),
        "document_date": dates.document_date(F.col("_stem"), name, F.col("document_date"), text),
        "keyword": F.when(low_ocr, "").when(told != "", told).otherwise(quick.keyword(name, text, r)),
        "_seed": T.summary_seed(T.sanitize(F.col("summary"))),
        "_made": quick.summary(text, name, 80, 24, r),
        "_prefix": paths.existing_prefix(name, F.col("case_name"), r),
    })
    seed = F.col("_seed")
    usable = (F.length(seed) >= 8) & ~T.is_boilerplate(seed, r) & ~T.is_garbled(seed) & ~T.is_file_name_phrase(seed) & ~T.is_noise(seed)
    stated = F.concat(F.rtrim(seed, F.lit(" .!?。！？,;:")), F.lit("."))
    stated = F.when(F.length(stated) > 80, F.concat(F.rtrim(F.substring(stated, 1, 79)), F.lit("."))).otherwise(stated)
    prefer = T.has_hangul(text) | T.has_hangul(F.col("case_name")) | T.has_hangul(F.col("institution"))
    built = T.structured_summary(F.col("doc_type"), F.col("case_name"), F.col("institution"), F.col("keyword"), 80, r)
    c = c.withColumn("summary", F.when(usable, stated).when(T.summary_acceptable(F.col("_made"), prefer, r), F.col("_made")).otherwise(built))
    given, tail = T.sanitize(F.col("document_title")), paths.clean_tail(F.col("_prefix.tail"))
    fallback = F.coalesce(T.blank_to_null(T.mapped_title(F.col("doc_type"), r)), T.blank_to_null(T.title_from_words(F.col("summary"), 10, r)), F.lit(r.default_title))
    title = (
        F.when((given != "") & ~T.is_vague(given, r), F.substring(given, 1, 30))
        .when(T.mapped_title(F.col("doc_type"), r) != "", T.mapped_title(F.col("doc_type"), r))
        .when((tail != "") & ~T.is_vague(tail, r), tail)
        .when(F.col("_hint") != "", F.col("_hint"))
        .when(T.is_vague(fallback, r), r.default_title)
        .otherwise(fallback)
    )
    c = c.withColumn("document_title", title)
    original = F.substring(T.sanitize(F.col("original_title")), 1, 40)
    c = c.withColumn("original_title", F.when(F.lower(original) == F.lower("document_title"), "").otherwise(original))
    c = c.withColumn("suggested", paths.build_name(F.col("_prefix.prefix"), F.col("document_title"), F.col("original_title"), F.col("document_date"), F.col("revision_note"), F.col("ext"), F.col("institution"), r))
    long = F.length("suggested") > settings.max_filename_length
    cut = F.concat(F.substring(paths.stem(F.col("suggested")), F.lit(1), F.lit(settings.max_filename_length) - F.length("ext")), F.col("ext"))
    base = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(settings.default_confidence))
    base = F.when(F.col("_quality") < 0.55, F.least(base, F.lit(0.82))).otherwise(base)
    c = c.withColumns({"_long": long, "suggested": F.when(long, cut).otherwise(F.col("suggested")), "confidence": F.when(long, F.least(base, F.lit(0.8))).otherwise(base)})
    why = review.review_reason(F.col("extraction_status"), F.col("ocr_quality_low"), F.col("document_title"), F.col("document_date"), name, F.col("confidence"), F.lit(False), settings.confidence_threshold)
    c = c.withColumn("_why", why)
    reason = F.concat_ws(" ", T.blank_to_null(T.sanitize(F.col("reason"))), F.when(F.col("_long"), "name cut to the limit"), F.when(F.col("_why").isNotNull(), F.concat(F.lit("["), "_why", F.lit("]"))))
    return c.withColumns({"reason": reason, "needs_review": F.col("_why").isNotNull()}).drop(*(k for k in ("_stem", "_hint", "_quality", "_seed", "_made", "_prefix", "_long", "_why", "text_excerpt")))


def resolve(proposals: DataFrame, seq: str = "item_id", settings: Settings | None = None) -> DataFrame:
    """The pass over all rows: generic summaries rewritten, collisions numbered and capped."""
    settings = settings or Settings()
    p = review.number_collisions(review.rewrite_generic(proposals, settings.rules), seq=seq)
    clash = F.col("conflict")
    return p.withColumns({
        "needs_review": F.col("needs_review") | clash,
        "confidence": F.when(clash, F.least("confidence", F.lit(0.84))).otherwise(F.col("confidence")),
        "status": F.when(clash, "duplicate_conflict").otherwise("proposed"),
        "final_path": F.concat_ws("/", "folder", "final_name"),
    })


def proposals(files: DataFrame, extractions: DataFrame, settings: Settings | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Inventory and extractions to resolved proposals; rows out of scope keep their names."""
    settings = settings or Settings()
    scoped = analysis_scope(files, settings).join(extractions, "item_id", "left")
    scoped = scoped.withColumn("extraction_status", F.coalesce("skip_status", "extraction_status", F.lit("error")))
    made = propose(scoped, settings, enrich)
    made = made.withColumns({
        "suggested": F.when(F.col("in_scope"), F.col("suggested")).otherwise(F.col("name")),
        "confidence": F.when(F.col("extraction_status") == "manual_review_required", 0.0).otherwise(F.col("confidence")),
    })
    return resolve(made, settings=settings)
