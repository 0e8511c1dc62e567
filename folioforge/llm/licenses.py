"""Licence scans by the digest of canonical texts.

A text is made canonical: lower case, copyright lines out, equivalent spellings
made one, everything but letters and digits one space.  Texts that are a known
licence, notice or declaration then have its digest, whatever their layout, and a
hash join with the known digests finds them.  Looked up are the whole text, its
lines, its paragraphs and runs of a few consecutive paragraphs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.batches import only
from folioforge.llm.licence_texts import DIGESTS, KNOWN
from folioforge.llm.storage import staged

#: Spellings that mean the same, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("licensee", "license holder"),
    ("sub-license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("http:", "https:"),
    ("version 2.0", "version 2"),
    ("version 3.0", "version 3"),
    ("&", " and "),
]
#: Each known text holds one of these in any spelling.
WORDS = ["licen", "released", "copyright", "permission", "warrant", "redistribut", "domain"]
#: Paragraphs that a run has at most: as many as the known texts of several paragraphs are usually set in.
PARAGRAPHS = 5
#: Fixed value: a line that states a copyright.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*(?:(?:19|20)[0-9][0-9]|<year>|\[year\]|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Canonical form; null is empty."""
    out = F.lower(F.coalesce(text, F.lit("")))
    stated = reduce(lambda a, b: a | b, (F.contains(out, F.lit(w)) for w in ("copyright", "(c)", "©")))  # else no line can match
    out = F.when(stated, F.regexp_replace(out, COPYRIGHT_LINE, " ")).otherwise(out)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, r"\ball rights reserved\b", " ")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, texts: dict[str, list[str]] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """``license_id, digest`` of every known text, and of long licences that are known by their digest; as many rows as there are."""
    rows = [(k, t) for k, v in texts.items() for t in v]
    short = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return short.union(spark.createDataFrame([(k, d) for k, d in digests.items()], "license_id string, digest string")).groupBy("digest").agg(F.min("license_id").alias("license_id")).select("license_id", "digest")


def units_of(text: Column) -> Column:
    """Digests of the lines, paragraphs and runs of up to ``PARAGRAPHS`` paragraphs that may be known, one for each place."""
    may = lambda c: reduce(lambda a, b: a | b, (F.contains(F.lower(c), F.lit(w)) for w in WORDS))
    lines = F.transform(F.filter(F.split(text, r"\r?\n"), may), canonical)
    paragraphs = F.transform(F.filter(F.split(text, r"\n[ \t\r]*\n\s*"), lambda p: F.length(F.trim(p)) > 0), lambda p: F.struct(canonical(p).alias("c"), may(p).alias("may")))

    def runs(p: Column) -> Column:
        from_each = lambda k: F.transform(p, lambda x, i: F.when(F.exists(F.slice(p, i + 1, k), lambda y: y["may"]) & (i + k <= F.size(p)), F.array_join(F.transform(F.slice(p, i + 1, k), lambda y: y["c"]), " ")))
        return F.concat(*(from_each(k) for k in range(1, PARAGRAPHS + 1)))

    each = F.concat(lines, F.flatten(F.transform(F.array(paragraphs), runs)))
    return F.transform(F.filter(F.transform(each, lambda c: F.trim(c)), lambda c: F.length(c) > 0), lambda c: F.sha2(c, 256))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, list[str]] = KNOWN, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """``id_col, licenses array<string>, whole_license, n_units, canonical_sha256`` for each row.

    ``licenses``: sorted identifiers of the known texts that the whole text, a
    line, a paragraph or a run of paragraphs is; ``whole_license``: that of the
    whole text, else null; ``n_units``: how many lines, paragraphs and runs are
    known.  A null text is empty and has none; null and repeated identifiers pass
    through; no rows give none.  The known digests are as many as ``texts`` and
    ``digests`` name, whatever the corpus, and are broadcast; candidates are
    exploded and joined with them by hash, and only hits are shuffled.
    """
    spark = docs.sparkSession
    known = F.broadcast(known_digests(spark, texts, digests))
    given = only(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    low = F.lower("text")
    maybe = reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in WORDS))
    looked = given.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.sha2(canonical(F.col("text")), 256).alias("whole"),
        F.when(maybe, units_of(F.col("text"))).otherwise(F.array().cast("array<string>")).alias("units"),
        maybe.alias("maybe"),
    )
    looked = staged(looked, "license-units")
    units = looked.filter(F.size("units") > 0).select("row", F.explode("units").alias("digest"), F.lit(1).alias("unit"))
    wholes = looked.filter("maybe").select("row", F.col("whole").alias("digest"), F.lit(0).alias("unit"))
    hits = units.union(wholes).join(known, "digest")
    found = hits.groupBy("row").agg(F.array_sort(F.collect_set("license_id")).alias("licenses"), F.max(F.when(F.col("unit") == 0, F.col("license_id"))).alias("whole_license"), F.sum("unit").alias("n_units"))
    out = looked.select("id", "row", "whole").join(found, "row", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), "whole_license", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.col("whole").alias("canonical_sha256"))
