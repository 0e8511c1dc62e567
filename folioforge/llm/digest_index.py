"""Exact deduplication against a persistent index of digests.

The index is a table bucketed and sorted by digest.  New documents are reduced to
their digests; those that the index holds are found by a sort-merge join that
reads the index in its own partitioning, and the rest is appended.  Everything on
this path is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.batches import only
from folioforge.llm.storage import discard, fresh_path, staged

#: The characters that a comparison ignores.
BLANKS = " \t\n\x0b\x0c\r"
#: A digest with more than this share of all rows is joined apart; so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1e-4


def squeezed(text: Column) -> Column:
    """Text without blanks; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def join_by_digest(rows: DataFrame, groups: DataFrame, total: int, key: str = "digest", size: str = "group_size") -> DataFrame:
    """Inner join of every row with its group, whatever the size of the groups.

    Groups that hold more than ``HOT_SHARE`` of the rows, at most 1 / HOT_SHARE in
    number, are broadcast; the others are joined by their key.
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold.hint("merge"), key))


class DigestIndex:
    """Index table of kept documents: ``digest, keep_id, n_chars, group_size``.

    ``group_size`` is that of the batch in which the digest came first.  An index
    lives on under its ``path``: whoever gives it again, with the same ``buckets``,
    finds what is in it, in another session too.  Every batch adds a sorted file to
    a bucket; :meth:`compact` makes them one again.
    """

    SCHEMA = "digest string, keep_id {kind}, n_chars long, group_size long"

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or fresh_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.schema = self.SCHEMA.format(kind=id_type)
        # a definition alone: what the path holds is left as it is
        place = self.path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.schema}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def _save(self, rows: DataFrame) -> None:
        rows.write.format("parquet").mode("append").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def table(self) -> DataFrame:
        """All rows of the index, whichever session has added them."""
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def compact(self, path: str) -> DigestIndex:
        """The same index with one sorted file in each bucket, at another path; the old one stays until it is dropped."""
        out = DigestIndex(self.spark, path=path, buckets=self.buckets, id_type=self.table().schema["keep_id"].dataType.simpleString())
        out._save(self.table().repartition(self.buckets, "digest"))
        return out

    def drop(self) -> None:
        """Forget the table; its files stay until the shared folder is cleared."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def add(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate ``docs`` against the index and among themselves, append what is new, and return a decision on every row.

        Of equal new texts the one with the most code points stays, then the one
        with the smallest identifier; a text already in the index never stays.
        Returns ``id_col, keep_id, group_size, kept, digest, n_chars``.  A null text is
        empty.  Identifiers are integers.  Of rows that repeat one and a text all but one go; null
        identifiers come last, and a group of them alone keeps one, with a null
        ``keep_id``.  No rows leave the index as it is.
        """
        return self._decide(only(docs, id=id_col, text=text_col).withColumn("row", F.monotonically_increasing_id()), id_col)

    def kept(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fixed: bool = False) -> DataFrame:
        """The rows of ``docs`` that :meth:`add` keeps, with all their columns.

        Rows are known by number, so ``docs`` is written first, unless it is
        ``fixed``: a table of files as read, which has the same rows at the same
        place whenever it is read.
        """
        row = "row"
        while row in docs.columns:
            row = f"_{row}"
        given = docs.withColumn(row, F.monotonically_increasing_id())
        given = given if fixed else staged(given, "documents")
        gone = self._decide(only(given, id=id_col, text=text_col, row=row), "id").filter(~F.col("kept")).select(F.col("row").alias(row))
        return given.join(gone.hint("shuffle_hash"), row, "left_anti").select(*docs.columns)

    def _decide(self, given: DataFrame, id_col: str) -> DataFrame:
        rows = given.select(
            "id",
            F.sha2(squeezed(F.col("text")), 256).alias("digest"),
            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
            "row",
        )
        rows = staged(rows, "digests")
        # the bits of an identifier turned over: the smallest becomes the largest, with no number that overflows
        best = F.struct("n_chars", F.col("id").isNotNull().alias("known"), F.bitwise_not(F.coalesce(F.col("id").cast("long"), F.lit(0).cast("long"))).alias("rank"), (-F.col("row")).alias("first"))
        groups = rows.groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
        groups = groups.select(
            "digest",
            F.when(F.col("best.known"), F.bitwise_not(F.col("best.rank"))).alias("keep_id"),
            F.col("best.n_chars").alias("n_chars"),
            "group_size",
            (-F.col("best.first")).alias("row"),
        )
        groups = staged(groups, "digest-groups")
        index = self.table()
        old = index.hint("merge").select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("known"))
        fresh = groups.hint("merge").join(old, "digest", "left_anti").select("digest", "keep_id", "n_chars", "group_size")
        decided = staged(groups.hint("merge").join(old, "digest", "left"), "digest-decisions")
        self._save(fresh)
        discard(groups)
        decided = decided.select("digest", F.when(F.col("known"), F.col("old_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size", F.when(F.col("known"), F.lit(-1)).otherwise(F.col("row")).alias("keep_row"))
        out = join_by_digest(rows, decided, rows.count())
        return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest", "n_chars", "row")
