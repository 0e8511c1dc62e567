"""Inventory and survey: numbering, extension counts, folder roll-up, headline, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.config import EXCLUDED, IMAGES, SECONDS_PER_FILE, SUPPORTED, SURVEY_SUPPORTED, USD_PER_FILE
from folioforge.functions.paths import ancestors, natural_key
from folioforge.sources.scratch import written


def supported(name: str = "name", ext: str = "ext", allow: tuple[str, ...] = SUPPORTED, deny: tuple[str, ...] = EXCLUDED) -> F.Column:
    """In the allowed extensions, not in the denied ones, no lock file."""
    return F.col(ext).isin(*allow) & ~F.col(ext).isin(*deny) & ~F.col(name).startswith("~$")


def with_seq(files: DataFrame, *order: str, name: str = "seq", parts: int | None = None) -> DataFrame:
    """Rows numbered from 1 in the order of the columns, nulls first; equal ones in any fixed order.

    A column ``name`` that is there is replaced.  Rows are dealt to range
    partitions; a number is the rank in its partition after the rows of those
    before, so that no task holds more than a share.
    """
    rows = files.select(F.struct(*(c for c in files.columns if c != name)).alias("row"), *(F.col(c).alias(f"key{k}") for k, c in enumerate(order)))
    dealt, before = ranged(rows, *(f"key{k}" for k in range(len(order))), parts=parts, sums={"n": F.lit(1)})
    return dealt.join(F.broadcast(before), "part").select("row.*", (F.col("at") + 1 + F.col("before_n")).alias(name))  # `before` has one row for each partition


def ranged(rows: DataFrame, *order: str, sums: dict[str, F.Column], parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` in range partitions by their order, and what comes before each partition.

    The first has ``part``, the number of a row's partition, and ``at``, its place
    there from 0; the second ``part`` and, for each of ``sums``, ``before_<name>``.
    Bounds of ranges are sampled anew whenever a plan runs, so the partitions are
    written once, and both results are read from there.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # a place has the partition's number above its 33 lowest bits
    dealt = written(dealt, "ranged").withColumns({"part": F.shiftright("place", 33), "at": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))}).drop("place")
    total = dealt.groupBy("part").agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"s_{k}") for k, v in sums.items()))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return dealt, total.select("part", *(F.coalesce(F.sum(f"s_{k}").over(w), F.lit(0)).alias(f"before_{k}") for k in sums))


def extension_breakdown(files: DataFrame) -> DataFrame:
    """``ext, n, supported``: files of each extension; null and empty ones are ``(no ext)``."""
    named = F.coalesce(F.nullif("ext", F.lit("")), F.lit("(no ext)"))
    return files.groupBy(named.alias("ext")).agg(F.count("*").alias("n")).withColumn("supported", F.col("ext").isin(*SURVEY_SUPPORTED))


def headline(files: DataFrame) -> DataFrame:
    """Totals, what can be worked on, and what that will take."""
    known = F.col("ext").isin(*SURVEY_SUPPORTED)
    sums = files.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
        F.count_if(known).alias("supported"),
        F.count_if(F.col("ext").isin(".pdf", *IMAGES)).alias("ocr_files"),
    )
    return sums.withColumns({
        "unsupported": F.col("total_files") - F.col("supported"),
        "seconds": F.bround(F.col("supported") * SECONDS_PER_FILE).cast("long"),
        "usd": F.bround(F.col("supported") * USD_PER_FILE, 2),
    })


def folder_rollup(files: DataFrame) -> DataFrame:
    """Subtree totals of every folder; a file is counted once in each folder above it.

    Files are summed by folder first, so what is spread over ancestors is one
    row for each folder and not for each file.
    """
    direct = files.groupBy("folder").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.count_if(F.col("ext").isin(*SURVEY_SUPPORTED)).alias("k"))
    spread = direct.withColumn("node", F.explode(ancestors(F.col("folder"))))
    return spread.groupBy("node").agg(F.sum("n").alias("total_files"), F.sum("s").alias("total_size"), F.sum("k").alias("supported"), F.sum(F.col("n") - F.col("k")).alias("unsupported"))


def folder_rows(files: DataFrame) -> DataFrame:
    """For each folder with files of its own: direct and subtree counts, and its subtree's extensions by count."""
    direct = files.groupBy("folder").agg(F.count("*").alias("direct_files"), F.sum("size").alias("direct_size"))
    by_ext = files.groupBy("folder", F.coalesce(F.nullif("ext", F.lit("")), F.lit("(no ext)")).alias("ext")).agg(F.count("*").alias("n"))
    under = by_ext.withColumn("node", F.explode(ancestors(F.col("folder")))).groupBy("node", "ext").agg(F.sum("n").alias("n"))
    counts = under.groupBy("node").agg(F.sum("n").alias("subtree_files"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "ext", "n"))).alias("e"))
    shown = F.array_join(F.transform("e", lambda x: F.concat(x["ext"], F.lit("="), x["n"].cast("string"))), ",")
    return direct.join(counts.select(F.col("node").alias("folder"), "subtree_files", shown.alias("ext_counts")), "folder")


def children_in_order(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Position of each file in its folder by natural order of names."""
    w = Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "name")
    out = files.withColumn("position", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("position") <= limit)


def tree_print(files: DataFrame, depth: int = 5) -> DataFrame:
    """Folders down to ``depth`` with their rank among siblings by total."""
    t = folder_rollup(files).withColumn("level", F.size(F.split("node", "/"))).filter(F.col("level") <= depth)
    t = t.withColumn("parent", F.when(F.col("level") == 1, "").otherwise(F.regexp_replace("node", "/[^/]*$", "")))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("total_files"), "node")))


def tree_overflow(files: DataFrame, depth: int = 5) -> DataFrame:
    """For folders at ``depth`` what a print of the tree leaves out below them: ``node, children, files``."""
    t = folder_rollup(files).withColumn("level", F.size(F.split("node", "/"))).filter(F.col("level") == depth + 1)
    return t.groupBy(F.regexp_replace("node", "/[^/]*$", "").alias("node")).agg(F.count("*").alias("children"), F.sum("total_files").alias("files"))


def page(rows: DataFrame, number: int, size: int, *order: str | F.Column) -> DataFrame:
    """Rows of the page with that number, from 0."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def pruned(selected: DataFrame, column: str = "path") -> DataFrame:
    """Selected folders without those that another selected folder holds: an equi-join on ancestors, no comparison of all pairs."""
    above = selected.select(F.col(column).alias("p"), F.explode(F.slice(ancestors(F.col(column)), 1, F.size(ancestors(F.col(column))) - 1)).alias("a"))
    inside = above.join(selected.select(F.col(column).alias("a")), "a", "left_semi").select(F.col("p").alias(column)).distinct()
    return selected.join(inside, column, "left_anti")


def selected_totals(files: DataFrame, selected: DataFrame, column: str = "path") -> DataFrame:
    """Totals of all files in or below the selected folders, each counted once: one row.

    Selections below others go first; a file then meets the one folder that is
    left above it by an equi-join on its ancestors.  No selection gives zeros.
    """
    folders = pruned(selected, column).select(F.col(column).alias("a")).distinct()
    direct = files.groupBy("folder").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.count_if(F.col("ext").isin(*SURVEY_SUPPORTED)).alias("k"))
    inside = direct.withColumn("a", F.explode(ancestors(F.col("folder")))).join(folders, "a")
    return inside.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("n", "total_files"), ("s", "total_size"), ("k", "supported")))).withColumn("unsupported", F.col("total_files") - F.col("supported"))


def run_summary(rows: DataFrame) -> DataFrame:
    """What a run has seen, in one row: files, supported ones, those that need a person, and hits of the cache; null flags count as false."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rows.agg(F.count("*").alias("total_files"), yes("supported").alias("supported_files"), yes("needs_review").alias("manual_review_count"), yes("hit").alias("cache_hits"))


def within(files: DataFrame, folders: DataFrame, column: str = "path") -> DataFrame:
    """Files that are one of the ``folders``, or lie in or below one: for as many folders as there are, by equi-joins on ancestors.

    A null path is in none; an empty table of folders selects nothing.
    """
    paths = files.select(F.col("path").alias("p")).distinct().select("p", F.explode(ancestors(F.col("p"))).alias("a"))
    chosen = paths.join(folders.select(F.btrim(F.col(column), F.lit("/")).alias("a")).distinct(), "a", "left_semi").select(F.col("p").alias("path")).distinct()
    return files.join(chosen, "path", "left_semi").select(*files.columns)


def selection_state(files: DataFrame, chosen: F.Column) -> DataFrame:
    """all, some or none of the files below each folder are chosen."""
    spread = files.groupBy("folder").agg(F.bool_and(chosen).alias("every"), F.bool_or(chosen).alias("any")).withColumn("node", F.explode(ancestors(F.col("folder"))))
    t = spread.groupBy("node").agg(F.bool_and("every").alias("every"), F.bool_or("any").alias("any"))
    return t.select("node", F.when(F.col("every"), "all").when(F.col("any"), "some").otherwise("none").alias("state"))


def with_changes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """Folders with the changes of their own files; 0 where there are none."""
    kinds = ["added", "deleted", "modified"]
    j = nodes.join(changes.select(F.col("folder").alias("node"), *kinds), "node", "left")
    return j.withColumns({k: F.coalesce(k, F.lit(0)) for k in kinds})


def newest(rows: DataFrame, order: str, n: int = 150) -> DataFrame:
    """The last ``n`` rows in the order of a column: a top-k, no sort of all."""
    return rows.orderBy(F.desc(order)).limit(n)
