"""Key-ordered logs and key-value tables over DataFrames.

A log is rows of (key, sequence, value, segment_id); sequences are global and gapless. Written with ``write`` it is a folder for each
segment, sorted by key and sequence within files, so scans of a key skip row groups and retention drops folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _range(c: Column, low=None, high=None, low_open: bool = False, high_open: bool = True) -> Column:
    out = F.lit(True)
    if low is not None:
        out = out & (c > F.lit(low) if low_open else c >= F.lit(low))
    if high is not None:
        out = out & (c < F.lit(high) if high_open else c <= F.lit(high))
    return out


def append(batch: DataFrame, order: list[str], first: int = 0, partitions: int | None = None) -> DataFrame:
    """``batch`` with sequence: gapless from ``first``, in the order of the columns.

    Rows are range-partitioned by the order and numbered within partitions; a table of one count a partition gives each its base, so
    no single task numbers the batch.
    """
    spark = batch.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = batch.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    return local.join(F.broadcast(base), "_p").withColumn("sequence", (F.col("_r") + F.col("_b") + first).cast("bigint")).drop("_p", "_r", "_b")


def next_sequence(log: DataFrame) -> int:
    return int(log.agg(F.coalesce(F.max("sequence") + 1, F.lit(0))).first()[0])


def watermark(log: DataFrame, first: int = 0) -> DataFrame:
    """next_sequence: all from ``first`` to below it are there. The least number whose predecessor is there and which is not."""
    there = log.where(F.col("sequence") >= first).select("sequence").distinct()
    after = there.select((F.col("sequence") + 1).alias("sequence")).union(log.sparkSession.range(1).select(F.lit(first).cast("bigint").alias("sequence")))
    return after.join(there, "sequence", "left_anti").agg(F.min("sequence").alias("next_sequence"))


def subscribe(log: DataFrame, key=None, cursor: int = 0, first: int = 0) -> DataFrame:
    """A key's entries from ``cursor`` on that are durable: those below the watermark, whatever has arrived beyond a gap."""
    upto = watermark(log, first).first()[0]
    return scan(log, key, cursor, int(upto))


def scan(log: DataFrame, key=None, low: int | None = None, high: int | None = None) -> DataFrame:
    """A key's entries with sequences in [low, high), in order; all keys' without a key."""
    rows = log if key is None else log.where(F.col("key") == F.lit(key))
    return rows.where(_range(F.col("sequence"), low, high)).orderBy("sequence")


def count(log: DataFrame, key=None, low: int | None = None, high: int | None = None) -> DataFrame:
    rows = log if key is None else log.where(F.col("key") == F.lit(key))
    return rows.where(_range(F.col("sequence"), low, high)).agg(F.count("*").alias("n"))


def cursors(log: DataFrame, frontier: int | None = None) -> DataFrame:
    """key, next_sequence: where a reader of the key goes on; with a frontier (all below it was seen) not before that."""
    last = log.groupBy("key").agg((F.max("sequence") + 1).alias("next_sequence"))
    return last if frontier is None else last.withColumn("next_sequence", F.greatest("next_sequence", F.lit(frontier).cast("bigint")))


def list_keys(log: DataFrame, segments: list[int] | None = None) -> DataFrame:
    rows = log if segments is None else log.where(F.col("segment_id").isin(*segments))
    return rows.select("key").distinct().orderBy("key")


def assign_segments(log: DataFrame, time_ms: str = "time_ms", seal_ms: int | None = None, seal_entries: int | None = None) -> DataFrame:
    """segment_id of each entry: a new one for every ``seal_ms`` of time or ``seal_entries`` entries. By arithmetic on each row alone."""
    if seal_entries is not None:
        return log.withColumn("segment_id", F.floor(F.col("sequence") / seal_entries).cast("int"))
    return log.withColumn("segment_id", F.floor(F.col(time_ms) / seal_ms).cast("int"))


def segments(log: DataFrame, time_ms: str | None = "time_ms") -> DataFrame:
    """segment_id, start_seq, start_time_ms, entries, end_seq (the next one's start; null for the last)."""
    agg = [F.min("sequence").alias("start_seq"), *([F.min(time_ms).alias("start_time_ms")] if time_ms else []), F.count("*").alias("entries")]
    found = log.groupBy("segment_id").agg(*agg)
    return found.withColumn("end_seq", F.lead("start_seq").over(Window.orderBy("start_seq")))  # a row a segment


def list_segments(segments_: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Those that overlap [low, high)."""
    starts = F.lit(True) if high is None else F.col("start_seq") < high
    ends = F.lit(True) if low is None else F.col("end_seq").isNull() | (F.col("end_seq") > low)
    return segments_.where(starts & ends).orderBy("start_seq")


def retained(log: DataFrame, segments_: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Without the oldest segments: those that ended, by the start of the next, before the retention."""
    after = F.lead("start_time_ms").over(Window.orderBy("start_seq"))
    gone = segments_.withColumn("_end", after).where(F.col("_end") < now_ms - retention_ms).select("segment_id")
    return log.join(gone, "segment_id", "left_anti")


def inspect(log: DataFrame) -> DataFrame:
    """Entries, keys and bytes of each segment."""
    return log.groupBy("segment_id").agg(
        F.count("*").alias("entries"), F.count_distinct("key").alias("keys"), F.sum(F.octet_length(F.col("value").cast("string"))).alias("bytes"), F.min("sequence").alias("first"), F.max("sequence").alias("last")
    )


def write(log: DataFrame, path: str, mode: str = "append") -> None:
    log.hint("rebalance", F.col("segment_id")).sortWithinPartitions("segment_id", "key", "sequence").write.mode(mode).partitionBy("segment_id").parquet(path)


# Key-value ---------------------------------------------------------------------------------------


def latest(writes: DataFrame, seq: str = "seq") -> DataFrame:
    """The table that puts and deletes (key, value, deleted, seq) leave: the last write of each key, deleted ones gone."""
    rest = [c for c in writes.columns if c != "key"]
    last = writes.groupBy("key").agg(F.max_by(F.struct(*rest), seq).alias("_r")).select("key", "_r.*")
    deleted = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rest else F.lit(False)
    return last.where(~deleted).drop(seq, "deleted")


def put(table: DataFrame, entries: DataFrame) -> DataFrame:
    """``table`` with the entries (key, value) in place of its own."""
    return table.join(entries.select("key"), "key", "left_anti").unionByName(entries)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key"), "key", "left_anti")


def get(table: DataFrame, key) -> DataFrame:
    return table.where(F.col("key") == F.lit(key))


def scan_keys(table: DataFrame, low=None, high=None) -> DataFrame:
    """Keys in [low, high), in order (binary keys: by unsigned bytes)."""
    return table.where(_range(F.col("key"), low, high)).orderBy("key")
