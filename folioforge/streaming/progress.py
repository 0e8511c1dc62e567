"""Structured Streaming: progress counters, and an inventory kept up by a change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge.operators.delta import COLUMNS, last_of


def file_stream(spark, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counters(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events by type with the sum of their values; the state has one row for each type."""
    e = events.withWatermark("ts", watermark) if watermark else events
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Events that change a run's state; others are records of its work.
STATES = ("scanning", "start", "complete", "cancelled", "error", "reset")


def run_state(events: DataFrame) -> DataFrame:
    """``run_id, status, processed, seq`` from a run's events ``run_id, seq, type``: its last state, and the records since it was last reset.

    A run without any state is ``idle``.
    """
    state = F.col("type").isin(*STATES)
    reset = events.filter("type = 'reset'").groupBy("run_id").agg(F.max("seq").alias("reset"))
    after = events.join(reset, "run_id", "left").filter(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    last = F.max_by(F.when(state, F.col("type")), F.when(state, F.col("seq")))
    return after.groupBy("run_id").agg(F.coalesce(last, F.lit("idle")).alias("status"), F.count_if(~F.coalesce(state, F.lit(False))).alias("processed"), F.max("seq").alias("seq"))


def sync_and_tail(events: DataFrame, seen: int) -> DataFrame:
    """What a late reader gets: one ``sync`` row of each run's state up to ``seen``, then every later event: ``run_id, seq, type, status, processed``."""
    sync = run_state(events.filter(F.col("seq") <= seen)).select("run_id", "seq", F.lit("sync").alias("type"), "status", "processed")
    tail = events.filter(F.col("seq") > seen).select("run_id", "seq", "type", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("processed"))
    return sync.unionByName(tail)


def run_cancellable(stream: DataFrame, out: str, checkpoint: str, cancelled: Callable[[], bool], poll_seconds: float = 0.2) -> bool:
    """Work off what there is until ``cancelled`` says so; True if all is done.

    What finished micro-batches have written stays, and the next call with the
    same ``checkpoint`` goes on behind them.
    """
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not q.awaitTermination(poll_seconds):
        if cancelled():
            q.stop()
            return False
    return True


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows; what is later than the watermark is dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what there is, with offsets in ``checkpoint``, and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_counters(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Counters in complete mode: every micro-batch replaces the table of its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    counters(stream).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_batch(spark, out: str) -> DataFrame:
    t = spark.read.parquet(out)
    return t.join(F.broadcast(t.agg(F.max("batch").alias("batch"))), "batch").drop("batch")  # one row


def _bucket(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("item_id"), F.lit(buckets)).cast("int").alias("bucket")


def start_snapshot(rows: DataFrame, path: str, buckets: int = 64) -> None:
    """An inventory that :func:`upsert_stream` keeps up: dealt into buckets by item, each in versions of its own."""
    rows.select(*COLUMNS, F.lit(True).alias("live"), _bucket(buckets), F.lit(0).alias("v")).write.partitionBy("bucket", "v").parquet(path)


def _versions(spark, path: str) -> dict[int, list[int]]:
    """Versions of each bucket, ascending, from the names of its folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda at, key: [n for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith(f"{key}=")]
    return {int(b[7:]): sorted(int(v[2:]) for v in names(spark._jvm.org.apache.hadoop.fs.Path(root, b), "v")) for b in names(root, "bucket")}


def snapshot_rows(spark, path: str, upto: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The inventory at its newest version, or that after ``upto`` micro-batches; of the buckets ``only`` if they are given."""
    newest = {b: max(v for v in vs if upto is None or v <= upto) for b, vs in _versions(spark, path).items() if only is None or b in only}
    kind = spark.read.parquet(path).schema
    if not newest:
        return spark.createDataFrame([], kind).select(*COLUMNS)
    return spark.read.option("basePath", path).schema(kind).parquet(*(f"{path}/bucket={b}/v={v}" for b, v in sorted(newest.items()))).filter("live").select(*COLUMNS)


def upsert_stream(feed: DataFrame, snapshot: str, checkpoint: str, buckets: int = 64) -> None:
    """Keep an inventory of :func:`start_snapshot` up: each micro-batch writes the next version of the buckets that it touches.

    Of an item's rows the one with the largest ``seq`` counts.  A micro-batch
    that is run again reads what it read before and writes its versions again, so
    a restart changes nothing; versions that no restart can need are deleted.  A
    row that is not live marks a bucket of which nothing is left.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = last_of(batch, "item_id", "seq").withColumn("bucket", _bucket(buckets)).persist()
        touched = [r["bucket"] for r in latest.select("bucket").distinct().collect()]  # `buckets` at most
        now = snapshot_rows(spark, snapshot, number, touched)
        kept = now.join(latest.select("item_id"), "item_id", "left_anti")
        rows = kept.unionByName(latest.filter("op <> 'delete'").select(*COLUMNS)).select(*COLUMNS, F.lit(True).alias("live"), _bucket(buckets))
        marks = latest.select("bucket").distinct().select(*(F.lit(None).cast(now.schema[c].dataType).alias(c) for c in COLUMNS), F.lit(False).alias("live"), "bucket")
        out = rows.unionByName(marks).withColumn("v", F.lit(number + 1))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(snapshot)
        latest.unpersist()
        for b, vs in _versions(spark, snapshot).items():
            for v in [v for v in vs if v <= number][:-1] if b in touched else []:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{snapshot}/bucket={b}/v={v}")
                old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
