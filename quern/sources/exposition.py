"""Metrics in the text exposition format, as rows of (labels, ts_ms, value), by built-in functions on lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_NAME = r"[a-zA-Z_:][a-zA-Z0-9_:]*"
_LINE = rf'^\s*({_NAME})\s*(?:\{{((?:[^"}}]|"(?:\\.|[^"\\])*")*)\}})?\s*(\S+)(?:\s+(\S+))?\s*$'
_PAIR = r'([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*"((?:\\.|[^"\\])*)"'
#: A sample's name may be its family's with one of these after it.
SUFFIXES = ("_total", "_bucket", "_sum", "_count", "_created", "_info", "_gsum", "_gcount")
TYPES = ("gauge", "counter", "histogram", "summary", "info", "stateset", "gaugehistogram", "unknown", "untyped")


def _unescaped(x: Column) -> Column:
    mark = F.lit("\u0000")
    x = F.replace(x, F.lit("\\\\"), mark)
    x = F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"'))
    return F.replace(x, mark, F.lit("\\"))


def number(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.isin("nan"), F.lit(float("nan"))).when(low.isin("inf", "+inf", "+infinity", "infinity"), F.lit(float("inf"))).when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(x.try_cast("double"))


def _labels(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(_PAIR), F.lit(2))
    return F.map_from_arrays(names, F.transform(values, _unescaped))


def parse(lines: DataFrame, default_ms: Column | int = 0, text: str = "value", suffix_label: bool = False) -> DataFrame:
    """labels, ts_ms, value of sample lines. Comments and exemplars are left out; times below 1e12 are seconds, others milliseconds.

    ``suffix_label``: _total and the like move from the name to a label ``__suffix__``. Lines that are no samples raise while it runs.
    """
    raw = F.regexp_replace(F.col(text), r" # .*$", "")
    rows = lines.where((F.trim(text) != "") & ~F.trim(text).startswith("#")).withColumn("_l", raw)
    name, inner, value, ts = (F.regexp_extract("_l", _LINE, i) for i in (1, 2, 3, 4))
    if suffix_label:
        found = F.lit("")
        for s in reversed(SUFFIXES):
            found = F.when(name.endswith(s), F.lit(s)).otherwise(found)
        base = name.substr(F.lit(1), F.length(name) - F.length(found))
        own = F.when(found != "", F.create_map(F.lit("__name__"), base, F.lit("__suffix__"), found)).otherwise(F.create_map(F.lit("__name__"), base))
    else:
        own = F.create_map(F.lit("__name__"), name)
    seconds = number(ts)
    ms = F.when(ts == "", default_ms if isinstance(default_ms, Column) else F.lit(default_ms)).when(seconds < 1e12, (seconds * 1000).cast("bigint")).otherwise(seconds.cast("bigint"))
    wrong = F.when((name == "") | number(value).isNull() | ((ts != "") & seconds.isNull()), F.raise_error(F.concat(F.lit("not a sample line: "), F.col(text))).cast("double"))
    # regexp_extract gives "" where nothing matched; such a line must not pass for an empty sample.
    return rows.select(F.map_concat(own, _labels(inner)).alias("labels"), ms.cast("bigint").alias("ts_ms"), F.coalesce(wrong, number(value)).alias("value"))


def metadata(lines: DataFrame, text: str = "value") -> DataFrame:
    """metric, type, help, unit of the TYPE, HELP and UNIT lines."""
    kind, name, rest = (F.regexp_extract(text, rf"^\s*#\s*(TYPE|HELP|UNIT)\s+({_NAME})\s+(.*)$", i) for i in (1, 2, 3))
    rows = lines.select(kind.alias("kind"), name.alias("metric"), rest.alias("rest")).where("kind <> ''")
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("rest"))), F.lit(""))
    kind_ = F.trim(of("TYPE"))
    return rows.groupBy("metric").agg(F.when(kind_.isin(*TYPES), F.when(kind_ == "untyped", "unknown").otherwise(kind_)).otherwise("unknown").alias("type"), _unescaped(of("HELP")).alias("help"), of("UNIT").alias("unit"))


def read(spark: SparkSession, path: str, default_ms: int = 0, suffix_label: bool = False) -> DataFrame:
    return parse(spark.read.text(path), default_ms, suffix_label=suffix_label)


def scraped(samples: DataFrame, job: str, instance: str, at_ms: int, ok: bool = True) -> DataFrame:
    """A scrape's samples with job and instance, and ``up``: 1, or 0 if it failed. A sample's own labels of these names stay."""
    target = F.create_map(F.lit("job"), F.lit(job), F.lit("instance"), F.lit(instance))
    own = F.map_concat(F.map_filter(target, lambda k, _: ~F.map_contains_key(F.col("labels"), k)), "labels")
    up = samples.sparkSession.range(1).select(F.map_concat(F.create_map(F.lit("__name__"), F.lit("up")), target).alias("labels"), F.lit(at_ms).cast("bigint").alias("ts_ms"), F.lit(1.0 if ok else 0.0).alias("value"))
    return (samples.select(own.alias("labels"), "ts_ms", "value").unionByName(up)) if ok else up
