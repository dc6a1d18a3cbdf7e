"""Metric samples as tables, and where selectors read them.

Two layouts, both plain DataFrames:

* wide: a column for each label, with ``ts_ms``, ``value`` and maybe ``stale``; series are told apart by their labels.
* normalised: ``series`` (series_id, labels MAP) and ``samples`` (series_id, ts_ms, value, stale, bucket_hour). Matchers filter the small
  table, samples are reduced by series_id, and labels join what is left. ``write_samples`` lays it out, one folder an hour.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.relation import NAME, col
from ..plans.ast import Matcher

HOUR = 3_600_000
_LITERALS = re.compile(r"[\w \-/@#%&=~`'\",;:<>!]*(?:\|[\w \-/@#%&=~`'\",;:<>!]*)*")


def matches(m: Matcher, value: Column) -> Column:
    """A label's value ("" where there is none) against a matcher. Alternations of plain words become IN lists."""
    if m.op in ("=", "!="):
        found = value == F.lit(m.value)
    elif _LITERALS.fullmatch(m.value):
        found = value.isin(*dict.fromkeys(m.value.split("|")))
    else:
        found = value.rlike(f"^(?s:{m.value})$")
    return ~found if m.op.startswith("!") else found


@dataclass(frozen=True)
class Read:
    """Samples a selector sees: ``keys`` tell series apart, ``labelled`` turns keys into label columns."""

    samples: DataFrame
    keys: list[str]
    labels: tuple[str, ...]
    one_name: bool
    series: DataFrame | None = None

    def labelled(self, df: DataFrame, *cols: str) -> DataFrame:
        if self.series is not None:
            df = df.join(self.series, "series_id")
        return df.select(*[col(x) for x in self.labels], "step", "value", *cols)


@dataclass(frozen=True)
class Metrics:
    samples: DataFrame
    labels: tuple[str, ...]
    series: DataFrame | None = None
    metadata: DataFrame | None = None  # metric, type, help, unit
    fixed: dict[str, str] = field(default_factory=dict)  # labels that all rows share (wide)
    within: Callable[[int, int, tuple[Matcher, ...]], DataFrame] | None = None  # samples after one time and up to another, by filters that reach the scan

    @staticmethod
    def wide(df: DataFrame, labels: dict[str, Column], ts_ms: Column, value: Column, name: str | None = None, stale: Column | None = None, newest: Column | None = None, metadata: DataFrame | None = None, time: str | None = None) -> Metrics:
        """From any table. ``newest``: where a series has two values of one time, that of the largest counts.

        ``time``: the TIMESTAMP_NTZ column (UTC) behind ``ts_ms``; bounds of time then reach the scan.
        """

        def of_rows(df: DataFrame) -> DataFrame:
            found = df.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(col(x)) for x, c in labels.items()], ts_ms.cast("bigint").alias("ts_ms"), value.cast("double").alias("value"), (stale if stale is not None else F.lit(False)).alias("stale"), *([newest.alias("_seq")] if newest is not None else []))
            if newest is None:
                return found
            return found.groupBy(*map(col, labels), "ts_ms").agg(F.max_by("value", "_seq").alias("value"), F.max_by("stale", "_seq").alias("stale"))

        text = {x for x, c in labels.items() if df.select(c).schema[0].dataType.simpleString() == "string"}

        def within(after: int, upto: int, matchers: tuple[Matcher, ...]) -> DataFrame:
            low, high = (F.lit(datetime(1970, 1, 1) + timedelta(milliseconds=x + 1)).cast("timestamp_ntz") for x in (after, upto))
            wanted = (F.col(time) >= low) & (F.col(time) < high)
            for m in matchers:
                if m.op == "=" and m.value and m.name in text:
                    wanted = wanted & (labels[m.name] == F.lit(m.value))
            return of_rows(df.where(wanted))

        return Metrics(of_rows(df), (*((NAME,) if name else ()), *labels), None, metadata, {NAME: name} if name else {}, within if time else None)

    @staticmethod
    def tables(series: DataFrame, samples: DataFrame, labels: tuple[str, ...] | None = None, metadata: DataFrame | None = None) -> Metrics:
        """From series (series_id, labels) and samples. Label names are read from ``series`` unless given: as many rows as there are names."""
        if labels is None:
            labels = tuple(sorted(r[0] for r in series.select(F.explode(F.map_keys("labels"))).distinct().collect()))
        flat = series.select("series_id", *[F.coalesce(F.col("labels")[x], F.lit("")).alias(col(x)) for x in labels])
        if "stale" not in samples.columns:
            samples = samples.withColumn("stale", F.lit(False))
        return Metrics(samples, labels, flat, metadata)

    def label(self, name: str) -> Column:
        if name in self.fixed:
            return F.lit(self.fixed[name])
        return F.col(col(name)) if name in self.labels else F.lit("")

    def read(self, matchers: tuple[Matcher, ...], after: int, upto: int) -> Read:
        """Samples of matching series in (after, upto]."""
        one = NAME not in self.labels or NAME in self.fixed or any(m.name == NAME and m.op == "=" for m in matchers)
        samples = self.within(after, upto, matchers) if self.within else self.samples.where((F.col("ts_ms") > after) & (F.col("ts_ms") <= upto))
        if "bucket_hour" in samples.columns:  # folders, so that others are not opened
            samples = samples.where(F.col("bucket_hour").between((after + 1) // HOUR, upto // HOUR))
        wanted = None
        for m in matchers:
            wanted = matches(m, self.label(m.name)) if wanted is None else wanted & matches(m, self.label(m.name))
        if self.series is None:
            samples = samples.where(wanted)
            flexible = [col(x) for x in self.labels if x not in self.fixed]
            samples = samples.select(*[F.lit(v).alias(col(k)) for k, v in self.fixed.items()], *flexible, "ts_ms", "value", "stale")
            return Read(samples, [col(x) for x in self.labels], self.labels, one)
        series = self.series.where(wanted)
        samples = samples.join(series.select("series_id"), "series_id", "left_semi").select("series_id", "ts_ms", "value", "stale")
        return Read(samples, ["series_id"], self.labels, one, series)

    def matching(self, selectors: list[tuple[Matcher, ...]], after: int | None = None, upto: int | None = None) -> DataFrame:
        """Distinct label columns of the series that any of the selectors matches, with a sample in the time asked for."""
        df = self.samples
        if after is not None:
            df = df.where((F.col("ts_ms") > after) & (F.col("ts_ms") <= upto))
        if self.series is not None:
            df = self.series if after is None else self.series.join(df.select("series_id"), "series_id", "left_semi")
        wanted = None
        for matchers in selectors:
            each = F.lit(True)
            for m in matchers:
                each = each & matches(m, self.label(m.name))
            wanted = each if wanted is None else wanted | each
        if wanted is not None:
            df = df.where(wanted)
        return df.select(*[self.label(x).alias(col(x)) for x in self.labels]).distinct()


def _entries(labels: Column) -> Column:
    """In the order of their names; empty values don't count."""
    return F.array_sort(F.filter(F.map_entries(labels), lambda e: e["value"] != ""))


def labels_key(labels: Column) -> Column:
    """One string for equal label sets."""
    return F.to_json(F.map_from_entries(_entries(labels)))


def series_id(labels: Column) -> Column:
    """128 bits of a label set as 32 hex digits."""
    return F.md5(labels_key(labels).cast("binary"))


def normalise(rows: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """series and samples of rows (labels MAP, ts_ms, value[, stale]); for two values of one time the one of the largest ``seq`` counts."""
    stale = F.col("stale") if "stale" in rows.columns else F.lit(False)
    rows = rows.select(series_id(F.col("labels")).alias("series_id"), "labels", "ts_ms", "value", stale.alias("stale"), *([F.col(seq).alias("_seq")] if seq else [F.lit(0).alias("_seq")]))
    # Entries are part of the key: unlike maps they are hashed, so no task sorts the labels of all its rows.
    series = rows.select("series_id", _entries(F.col("labels")).alias("e")).distinct().select("series_id", F.map_from_entries("e").alias("labels"))
    samples = rows.groupBy("series_id", "ts_ms").agg(F.max_by("value", "_seq").alias("value"), F.max_by("stale", "_seq").alias("stale"))
    return series, samples.withColumn("bucket_hour", F.floor(F.col("ts_ms") / HOUR).cast("bigint"))


def write_samples(rows: DataFrame, path: str, seq: str | None = None, mode: str = "append") -> None:
    """Samples as Parquet, a folder for each hour, sorted by series within files; series beside them."""
    series, samples = normalise(rows, seq)
    series.write.mode(mode).parquet(f"{path}/series")
    # Rebalanced: an hour with much data goes to several tasks, small hours share one.
    samples.hint("rebalance", F.col("bucket_hour")).sortWithinPartitions("bucket_hour", "series_id", "ts_ms").write.mode(mode).partitionBy("bucket_hour").parquet(f"{path}/samples")


def read_samples(spark: SparkSession, path: str, labels: tuple[str, ...] | None = None) -> Metrics:
    """What ``write_samples`` wrote in one or several calls. Later calls add to earlier ones: values that calls share are for the caller to settle, by normalise() over both."""
    series = spark.read.parquet(f"{path}/series").groupBy("series_id").agg(F.first("labels").alias("labels"))
    return Metrics.tables(series, spark.read.parquet(f"{path}/samples"), labels)


def expired(samples: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Samples without the hours whose start is further back than the retention: whole folders."""
    return samples.where((F.col("bucket_hour") * HOUR + retention_ms) > now_ms)
