"""Session helpers of the corpus operators: reliable checkpoints, partition counts, Arrow batch sizes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.sources.shared import shared_folder

NO_ID = 2**63 - 1  #: stands for a null doc_id: sorts after every other id


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where none is set and all is one process (tests) a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as a compressed table to the checkpoint folder and read back: a lineage that survives lost executors."""
    path = f"{checkpoint_folder(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*settled: DataFrame | None) -> None:
    """Delete what settle() wrote for these; nothing that is still to run may read them."""
    for df in settled:
        if (path := getattr(df, "_settled_at", None)) is not None:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of bounded bytes, so that long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def keyed(docs: DataFrame, *extra: str | Column) -> DataFrame:
    """doc_id, text, a non-null key ``k`` and a mark ``th``; other columns of ``docs`` are left behind.

    Rows are told apart by (k, th): th is 0 where no doc_id is repeated, else the text's hash, so that rows repeated with one
    doc_id and one text behave alike.
    """
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    repeated = docs.groupBy(k.alias("k")).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k.alias("k"), F.xxhash64("text").alias("th") if repeated else F.lit(0).cast("long").alias("th"), F.col("text").cast("string").alias("text"), *extra)
    out._repeated = bool(repeated)
    return out


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df``, settled, with a gapless rank from 0 within ``keys``, no key's rows ever in one task.

    Rows are ranked within (partition, keys); a small table of counts per partition gives each partition's base.
    """
    df = settle(df.withColumn("_part", F.spark_partition_id()))
    counts = df.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    local = df.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1)
    out = local.join(base, ["_part", *keys])
    return out.withColumn(name, (F.col("_r") + F.col("_base")).cast("long")).drop("_r", "_base", "_part")
