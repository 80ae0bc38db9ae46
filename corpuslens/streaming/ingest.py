"""Structured Streaming: continuous scans, latest state and windowed counts.

Plain parquet has no atomic update, so each micro-batch writes one folder of
its own (``batch=<n>/source=<query and batch id>``) and replaces it when Spark
retries the batch. Readers take the newest row per key. A lost executor or a
restarted query therefore neither repeats nor loses a write, and neither does
a run with another checkpoint: its batches are numbered after those there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslens.functions import rules as R
from corpuslens.operators.incremental import changed_files, rebuild
from corpuslens.sources.store import RecordStore, latest, work_dir


def write_batch(df: DataFrame, path: str, batch_id: int, source: str = "none") -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}/source={source}")


def read_log(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest record per key over all batches."""
    log = read_log(spark, path).drop("source")
    return latest(log, key, "batch")


def batch_place(log: DataFrame, batch_id: int) -> tuple[int, str]:
    """(number, source) of a batch in a log: its own place if it was written before, else the next."""
    query = log.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "direct"
    source = f"{query}-{batch_id}"
    places = log.select("batch", "source").distinct()       # partition columns only
    found = places.agg(F.max("batch").alias("last"), F.max(F.when(F.col("source") == source, F.col("batch"))).alias("own"))
    row = found.first()
    return (row.own if row.own is not None else (-1 if row.last is None else row.last) + 1), source


def run_available(stream: DataFrame, store: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Work off what the source holds now, then stop (one scheduled run).

    The checkpoint belongs to the store, so that the next run goes on where this one ended. A bare name is a folder
    in the work folder.
    """
    path = store if "/" in store else f"{work_dir(stream.sparkSession)}/{store}"
    start(stream, f"{path}/_checkpoint", each, mode).awaitTermination()


def start(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append",
          available_now: bool = True):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def ingest_batch(store: str, key: str = "doc_id", version: str = R.SCORING_VERSION) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: rebuild the changed files of a batch and log them.

    ``store`` must hold a first batch (it may be empty). Only key, hash, version
    and creation time of the store are read.
    """
    def each(files: DataFrame, batch_id: int) -> None:
        spark = files.sparkSession
        log = read_log(spark, store)
        number, source = batch_place(log, batch_id)
        known = latest(log.filter(F.col("batch") < number)
                       .select(key, "content_hash", "scoring_version", "created_at", "batch"), key, "batch")
        changed = changed_files(files, known, key, version)
        rebuilt = rebuild(files, changed, F.current_timestamp().cast("string"), key, repeats=True)
        write_batch(rebuilt.select(*[c for c in log.columns if c not in ("batch", "source")]), store, number, source)
    return each


def dedup_stream(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """A rescan of the same keys within the delay is dropped; state expires after it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def latest_batch(log: str, key: str, *order: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: newest row per key of the batch, logged; ``latest_state`` keeps one row per key instead."""
    def each(rows: DataFrame, batch_id: int) -> None:
        write_batch(latest(rows, key, *order), log, batch_id)
    return each


def latest_state(store: str, key: str, *order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the newest row per key, kept in a record store at ``store``.

    A batch meets only the buckets of its keys and leaves one row per live key there, so that a read costs the live
    keys however many batches there were. Rows older than the stored one and batches that Spark repeats change
    nothing, with whatever checkpoint.
    """
    def each(rows: DataFrame, batch_id: int) -> None:
        RecordStore(rows.sparkSession, store, key, buckets).merge(rows, *order)
    return each


def outcome_windows(stream: DataFrame, event_time: str, outcome: str, size: str = "1 day", slide: str | None = None,
                    delay: str = "1 hour") -> DataFrame:
    """Counts per window and outcome; ``slide`` makes the windows overlap."""
    return (stream.withWatermark(event_time, delay)
            .groupBy(F.window(event_time, size, slide), outcome).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("window_start"), outcome, "n"))


def utc(column: str):
    """A zoneless timestamp read as UTC, whatever the session's zone."""
    return F.to_timestamp(F.concat(F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00:00")))


def utc_day(column: str):
    days = F.floor(F.unix_seconds(column) / 86400).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string")
