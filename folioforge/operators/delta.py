"""Change feeds: compare, apply, count; caches of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.survey import ranged

COLUMNS = ["item_id", "folder", "name", "ext", "path", "size", "modified"]


def last_of(feed: DataFrame, key: str, *order: str) -> DataFrame:
    """Last row of each key in the order given: an aggregate, so partial maxima are made before the shuffle."""
    rest = [c for c in feed.columns if c != key]
    best = feed.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(key, *(F.col(f"r.{c}").alias(c) for c in rest)).select(*feed.columns)


def settled(feed: DataFrame, key: str = "item_id", order: str = "seq") -> DataFrame:
    """The feed with one row of each item, the last in its ``order``; a feed without that column has one row of each already.

    Rows without an item stay as they are.
    """
    if order not in feed.columns:
        return feed
    return last_of(feed.filter(F.col(key).isNotNull()), key, order).unionByName(feed.filter(F.col(key).isNull()))


def classify(old: DataFrame, feed: DataFrame) -> DataFrame:
    """``item_id, change, folder`` of each item of the feed: added, deleted, modified or unchanged against ``old``.

    Of an item's rows the last counts.  A deletion counts if the item is known;
    modified means another time or name, where null differs from everything else.
    A row without ``op`` is an upsert, one without an item is added.
    """
    known = old.select("item_id", F.col("name").alias("old_name"), F.col("modified").alias("old_modified"), F.col("folder").alias("old_folder"), F.lit(True).alias("known"))
    j = settled(feed).join(known, "item_id", "left")
    delete = F.coalesce(F.col("op") == "delete", F.lit(False))
    change = (
        F.when(delete & F.col("known"), "deleted")
        .when(delete, "ignored")
        .when(F.col("known").isNull(), "added")
        .when(~F.col("modified").eqNullSafe(F.col("old_modified")) | ~F.col("name").eqNullSafe(F.col("old_name")), "modified")
        .otherwise("unchanged")
    )
    return j.select("item_id", change.alias("change"), F.coalesce("folder", "old_folder").alias("folder"))


def apply(old: DataFrame, feed: DataFrame) -> DataFrame:
    """The inventory after the feed: deleted rows out, the others' last state in; a row without ``op`` is an upsert."""
    last = settled(feed)
    fresh = last.filter(~F.coalesce(F.col("op") == "delete", F.lit(False))).select(*COLUMNS)
    return old.select(*COLUMNS).join(last.select("item_id"), "item_id", "left_anti").unionByName(fresh)


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """``item_id, change, folder`` of every item of two whole inventories: what a feed would have said, for a reader whose place in it is lost.

    Items have one row in each; modified means another time or name, null included.
    """
    a, b = (t.select("item_id", "folder", "name", "modified", F.lit(True).alias("here")).alias(x) for t, x in ((old, "a"), (new, "b")))
    j = a.join(b, F.col("a.item_id") == F.col("b.item_id"), "full")
    same = F.col("a.modified").eqNullSafe(F.col("b.modified")) & F.col("a.name").eqNullSafe(F.col("b.name"))
    change = F.when(F.col("a.here").isNull(), "added").when(F.col("b.here").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return j.select(F.coalesce("a.item_id", "b.item_id").alias("item_id"), change.alias("change"), F.coalesce("b.folder", "a.folder").alias("folder"))


def by_folder(changes: DataFrame) -> DataFrame:
    """Changes of each named folder, one column for each kind."""
    kinds = ["added", "deleted", "modified"]
    rows = changes.filter(F.col("change").isin(*kinds) & (F.coalesce("folder", F.lit("")) != ""))
    return rows.groupBy("folder").agg(*(F.count_if(F.col("change") == k).alias(k) for k in kinds))


def cache_key(*columns: str) -> F.Column:
    """Digest of what a result depends on; every part has its length before it, so parts can't run together."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha1(F.concat_ws("|", *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts)))


def probe(rows: DataFrame, cache: DataFrame, key: str = "cache_key", version: int = 11) -> DataFrame:
    """``rows`` with ``hit``: the cache of this version has the key."""
    known = cache.filter(F.col("schema_version") == version).select(key, F.lit(True).alias("hit")).distinct()
    return rows.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def with_fresh(rows: DataFrame, cache: DataFrame, analyse: Callable[[DataFrame], DataFrame], key: str = "cache_key", version: int = 11) -> DataFrame:
    """Results of all ``rows``: those of the cache for hits, and of ``analyse`` for the others, which it alone gets; ``hit`` is added.

    The cache has one row of a key and version.  Columns are those of ``analyse``'s result.
    """
    probed = probe(rows, cache, key, version)
    fresh = analyse(probed.filter(~F.col("hit")).drop("hit"))
    told = cache.filter(F.col("schema_version") == version)
    known = rows.select(*(c for c in rows.columns if c == key or c not in told.columns)).join(told.drop("schema_version"), key)
    return known.select(*fresh.columns, F.lit(True).alias("hit")).unionByName(fresh.withColumn("hit", F.lit(False)))


def running(events: DataFrame, flags: dict[str, F.Column], order: str, parts: int | None = None) -> DataFrame:
    """Running sums of the flags in the order of a unique column; a null flag counts nothing.

    Columns with a flag's name are replaced.  Sums within range partitions, after
    the sums of those before: no task reads the whole stream.
    """
    rows = events.select(F.struct(*(c for c in events.columns if c not in flags)).alias("row"), F.col(order).alias("key"), *(F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(f"flag_{k}") for k, v in flags.items()))
    dealt, before = ranged(rows, "key", parts=parts, sums={k: F.col(f"flag_{k}") for k in flags})
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.select("row", "part", *(F.sum(f"flag_{k}").over(own).alias(f"own_{k}") for k in flags))
    return sums.join(F.broadcast(before), "part").select("row.*", *((F.col(f"own_{k}") + F.col(f"before_{k}")).alias(k) for k in flags))  # `before` has one row for each partition
