"""Streams: a buffer of batches on shared storage, exactly-once ingestion, active series, segments that roll.

A buffer is a folder of Parquet files of (entry, payload, ingestion_time_ms). Producers append whole files, which appear at once;
a consumer is a file stream, whose checkpoint holds what it has seen: the position that an acknowledgement moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import watermark
from ..sources import otlp
from ..sources.metrics import HOUR, labels_key, series_id

BUFFER = "entry binary, payload binary, ingestion_time_ms bigint"


def produce(entries: DataFrame, path: str, now_ms: int | None = None) -> None:
    """Append entries (entry[, payload]); a call's files appear together or not at all."""
    time = F.lit(now_ms) if now_ms is not None else F.unix_millis(F.current_timestamp())
    payload = F.col("payload") if "payload" in entries.columns else F.lit(None).cast("binary")
    entries.select(F.col("entry").cast("binary").alias("entry"), payload.cast("binary").alias("payload"), time.cast("bigint").alias("ingestion_time_ms")).write.mode("append").parquet(path)


def consume(spark: SparkSession, path: str, files: int | None = None, clean: str | None = None) -> DataFrame:
    """A stream of the buffer's entries with the file they stand in, ``files`` at most a batch; files that were read move to ``clean`` if given."""
    options = {"maxFilesPerTrigger": str(files)} if files else {}
    if clean:
        options |= {"cleanSource": "archive", "sourceArchiveDir": clean}
    return spark.readStream.schema(BUFFER).options(**options).parquet(path).withColumn("file", F.input_file_name())


def descriptors(spark: SparkSession, path: str) -> DataFrame:
    """sequence, file, ingestion_time_ms, entries, bytes of each batch (file) of the buffer, in the order a consumer takes them."""
    files = spark.read.schema(BUFFER).parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max("ingestion_time_ms").alias("ingestion_time_ms"), F.count("*").alias("entries"), F.max("_metadata.file_size").alias("bytes"))
    return files.withColumn("sequence", F.row_number().over(Window.orderBy("ingestion_time_ms", "file")) - 1)  # a row a file


def acknowledged(acks: DataFrame, position: int = 0) -> DataFrame:
    """next_sequence: where a consumer that stood at ``position`` goes on, given acknowledged batches (sequence): gaps hold it back."""
    return watermark(acks, position)


def collected(spark: SparkSession, path: str, done: DataFrame, now_ms: int, grace_ms: int) -> int:
    """Delete the buffer's batches (``done``: file) that came in before the grace period; how many there were. A run that breaks off is
    finished by the next.
    """
    gone = descriptors(spark, path).where(F.col("ingestion_time_ms") < now_ms - grace_ms).join(done.select("file"), "file", "left_semi").select("file").collect()  # names of files
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for r in gone:
        file = hadoop(r["file"])
        file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(file, False)
    return len(gone)


def exactly_once(stream: DataFrame, checkpoint: str, path: str, convert: Callable[[DataFrame], DataFrame], available_now: bool = True):
    """``convert`` each batch and write it under its own number: a batch that runs again after a failure replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def samples_of(rows: DataFrame) -> DataFrame:
    """Rows (labels, ts_ms, value) as they are stored: with series_id and the hour they belong to."""
    return rows.select(series_id(F.col("labels")).alias("series_id"), "labels", "ts_ms", "value", F.floor(F.col("ts_ms") / HOUR).cast("bigint").alias("bucket_hour"))


def otlp_samples(batch: DataFrame) -> DataFrame:
    """A buffer's batch of OTLP requests (JSON) as samples to be stored: what exactly_once() takes to convert."""
    requests = batch.select(otlp.parsed(F.col("entry").cast("string")).alias("resourceMetrics"))
    return samples_of(otlp.convert(requests))


def active_series(stream: DataFrame, late: str = "5 minutes", width: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """window, active: estimated series with a sample in each sliding window. ``stream``: labels, ts (timestamp)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide)).agg(F.approx_count_distinct(labels_key(F.col("labels"))).alias("active"))


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of the rows with equal (series_id, ts); state is dropped once the watermark is past."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["series_id", "ts"])


def segmented(stream: DataFrame, seal_ms: int | None = None, seal_bytes: int | None = None) -> DataFrame:
    """log, sequence, key, value, time_ms, segment_id: gapless sequences for each ``log``, and a new segment once the open one is as old or
    as large as that. ``stream``: log, key, value (binary), time_ms. State of a log: four numbers.
    """

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, segment, began, size = state.get if state.exists else (0, 0, None, 0)
        for batch in batches:
            rows = []
            for k, v, t in zip(batch["key"], batch["value"], batch["time_ms"]):
                if began is not None and (seal_ms is not None and t - began >= seal_ms or seal_bytes is not None and size >= seal_bytes):
                    segment, began, size = segment + 1, None, 0
                began = int(t) if began is None else began
                size += len(k or b"") + len(v or b"")
                rows.append((key[0], n, k, v, int(t), segment))
                n += 1
            yield pd.DataFrame(rows, columns=["log", "sequence", "key", "value", "time_ms", "segment_id"])
        state.update((n, segment, began, size))

    out, kept = "log string, sequence long, key binary, value binary, time_ms long, segment_id int", "n long, segment int, began long, size long"
    return stream.groupBy("log").applyInPandasWithState(of, out, kept, "append", GroupStateTimeout.NoTimeout)
