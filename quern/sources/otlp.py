"""OTLP metrics (as JSON or as nested rows) to samples: gauges, sums, histograms, exponential histograms and summaries.

Everything is explodes and array functions on the nested columns; ``SCHEMA`` is what they are read as.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.ieee import let, shortest

_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_NUMBER = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:bigint,asDouble:double,asInt:bigint>"
_HISTOGRAM = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:bigint,count:bigint,sum:double,bucketCounts:array<bigint>,explicitBounds:array<double>>"
_BUCKETS = "struct<offset:int,bucketCounts:array<bigint>>"
_EXPONENTIAL = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:bigint,count:bigint,sum:double,scale:int,zeroCount:bigint,positive:{_BUCKETS},negative:{_BUCKETS}>"
_SUMMARY = f"struct<attributes:{_ATTRIBUTES},timeUnixNano:bigint,count:bigint,sum:double,quantileValues:array<struct<quantile:double,value:double>>>"
_METRIC = (
    f"struct<name:string,description:string,unit:string,gauge:struct<dataPoints:array<{_NUMBER}>>,sum:struct<dataPoints:array<{_NUMBER}>,aggregationTemporality:int,isMonotonic:boolean>,"
    f"histogram:struct<dataPoints:array<{_HISTOGRAM}>,aggregationTemporality:int>,exponentialHistogram:struct<dataPoints:array<{_EXPONENTIAL}>,aggregationTemporality:int>,summary:struct<dataPoints:array<{_SUMMARY}>>>"
)
SCHEMA = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeMetrics:array<struct<scope:struct<name:string,version:string,attributes:{_ATTRIBUTES}>,metrics:array<{_METRIC}>>>>>"
DELTA = 1
# Unit abbreviations and the words that stand for them in names.
UNITS = {
    "s": "seconds", "ms": "milliseconds", "us": "microseconds", "ns": "nanoseconds",
    "By": "bytes", "KBy": "kilobytes", "MBy": "megabytes", "GBy": "gigabytes", "TBy": "terabytes",
}


def sanitised(x: Column) -> Column:
    """Dots and dashes become underscores, other signs go; no digit comes first."""
    x = F.regexp_replace(F.regexp_replace(x, r"[.\-]", "_"), r"[^A-Za-z0-9_]", "")
    return F.regexp_replace(x, r"^(?=[0-9])", "_")


def unit_suffix(unit: Column) -> Column:
    """Null where the unit gives none."""
    known = F.create_map(*[F.lit(y) for x in UNITS.items() for y in x])
    none = unit.isNull() | unit.isin("", "1") | (unit.startswith("{") & unit.endswith("}"))
    return F.when(~none, F.coalesce(F.try_element_at(known, unit), sanitised(unit)))


def metric_name(name: Column, unit: Column, counter: Column) -> Column:
    """name_unit, or name_unit_total of a counter; what the name ends with already isn't said twice."""

    def joined(p: Column) -> Column:
        return F.when(p["suffix"].isNotNull() & ~p["name"].endswith(F.concat(F.lit("_"), p["suffix"])), F.concat(p["name"], F.lit("_"), p["suffix"])).otherwise(p["name"])

    full = let(F.named_struct(F.lit("name"), sanitised(name), F.lit("suffix"), unit_suffix(unit)), joined)
    return let(full, lambda x: F.when(counter & ~x.endswith("_total"), F.concat(x, F.lit("_total"))).otherwise(x))


def _attributes(a: Column) -> Column:
    """Entries of attributes of simple kinds."""

    def value(x: Column) -> Column:
        v = x["value"]
        return F.coalesce(v["stringValue"], v["intValue"], shortest(v["doubleValue"]), v["boolValue"].cast("string"))

    pairs = F.transform(F.coalesce(a, F.expr(f"cast(array() as {_ATTRIBUTES})")), lambda x: F.named_struct(F.lit("key"), sanitised(x["key"]), F.lit("value"), value(x)))
    return F.filter(pairs, lambda x: x["value"].isNotNull())


def _entry(key: str, value: Column) -> Column:
    return F.named_struct(F.lit("key"), F.lit(key), F.lit("value"), value)


def _last_of_each(entries: Column) -> Column:
    """A map; of entries with one key the later one counts."""

    def of(e: Column) -> Column:
        return F.map_from_entries(F.filter(e, lambda x, i: F.size(F.filter(F.slice(e, i + 2, F.size(e)), lambda y: y["key"] == x["key"])) == 0))

    return let(entries, of)


def _scope(scope: Column) -> Column:
    own = F.array(_entry("otel_scope_name", scope["name"]), _entry("otel_scope_version", scope["version"]))
    return F.filter(own, lambda x: x["value"].isNotNull() & (x["value"] != ""))


_POINT = "array<struct<suffix:string,own:array<struct<key:string,value:string>>,attributes:array<struct<key:string,value:string>>,ns:bigint,value:double,type:string>>"


def _point(p: Column, suffix: str, value: Column, type_: Column | str, own: Column | None = None) -> Column:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    own = F.array(own) if own is not None else F.expr("cast(array() as array<struct<key:string,value:string>>)")
    return F.named_struct(F.lit("suffix"), F.lit(suffix), F.lit("own"), own, F.lit("attributes"), _attributes(p["attributes"]), F.lit("ns"), p["timeUnixNano"], F.lit("value"), value.cast("double"), F.lit("type"), kind)


def _running(counts: Column, first: Column) -> Column:
    return F.transform(counts, lambda _, i: first + F.aggregate(F.slice(counts, 1, i + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _with_total(p: Column, pairs: Column, infinite: Column, type_: str) -> Column:
    """Points of the buckets (le, n), of all observations, of their sum if there is one, and their count."""
    buckets = F.transform(pairs, lambda b: _point(p, "_bucket", b["n"], type_, _entry("le", b["le"])))
    rest = F.array(_point(p, "_bucket", infinite, type_, _entry("le", F.lit("+Inf"))), _point(p, "_sum", p["sum"], type_), _point(p, "_count", F.coalesce(p["count"], _zero()), type_))
    return F.filter(F.concat(buckets, rest), lambda x: x["value"].isNotNull())


def _histogram(p: Column) -> Column:
    # Missing counts are zeros: as many as there are bounds, and one for what is above all of them.
    bounds = F.coalesce(p["explicitBounds"], F.expr("cast(array() as array<double>)"))
    counts = F.concat(F.coalesce(p["bucketCounts"], F.expr("cast(array() as array<bigint>)")), F.array_repeat(_zero(), F.size(bounds) + 1))
    totals = _running(F.slice(counts, F.lit(1), F.size(bounds) + 1), _zero())

    def of(t: Column) -> Column:
        pairs = F.transform(bounds, lambda b, i: F.named_struct(F.lit("le"), shortest(b), F.lit("n"), F.get(t, i)))
        return _with_total(p, pairs, F.element_at(t, -1), "histogram")

    return let(totals, of)


def _exponential(p: Column) -> Column:
    """Bounds are base ** (offset + i + 1) with base 2 ** 2 ** -scale; zeros count from the first bucket on, negatives only in all."""
    base = F.pow(F.lit(2.0), F.pow(F.lit(2.0), -F.coalesce(p["scale"], F.lit(0)).cast("double")))
    counts = F.coalesce(p["positive"]["bucketCounts"], F.expr("cast(array() as array<bigint>)"))
    first = F.coalesce(p["positive"]["offset"], F.lit(0))
    totals = _running(counts, F.coalesce(p["zeroCount"], _zero()))
    pairs = F.transform(totals, lambda n, i: F.named_struct(F.lit("le"), shortest(F.pow(base, (first + i + 1).cast("double"))), F.lit("n"), n))
    return _with_total(p, pairs, F.coalesce(p["count"], _zero()), "histogram")


def _summary(p: Column) -> Column:
    quantiles = F.transform(F.coalesce(p["quantileValues"], F.expr("cast(array() as array<struct<quantile:double,value:double>>)")), lambda q: _point(p, "", q["value"], "summary", _entry("quantile", shortest(q["quantile"]))))
    return F.concat(quantiles, F.array(_point(p, "_sum", F.coalesce(p["sum"], F.lit(0.0)), "summary"), _point(p, "_count", F.coalesce(p["count"], _zero()), "summary")))


def convert(requests: DataFrame, scope_labels: bool = False) -> DataFrame:
    """labels, ts_ms, value, type (gauge, counter, histogram, summary), in one pass over the requests. Sums of deltas are left out."""
    resources = requests.select(F.explode("resourceMetrics").alias("r"))
    scopes = resources.select(_attributes(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeMetrics").alias("s"))
    base = F.concat("res", _scope(F.col("s.scope"))) if scope_labels else F.col("res")
    rows = scopes.select(base.alias("base"), F.explode("s.metrics").alias("m"))

    monotonic = F.coalesce(F.col("m.sum.isMonotonic"), F.lit(False))
    number = lambda p: F.coalesce(p["asDouble"], p["asInt"].cast("double"))
    kept = F.coalesce(F.col("m.sum.aggregationTemporality"), F.lit(0)) != DELTA
    each = [
        F.transform("m.gauge.dataPoints", lambda p: _point(p, "", number(p), "gauge")),
        F.when(kept, F.transform("m.sum.dataPoints", lambda p: _point(p, "", number(p), F.when(monotonic, "counter").otherwise("gauge")))),
        F.flatten(F.transform("m.histogram.dataPoints", _histogram)),
        F.flatten(F.transform("m.exponentialHistogram.dataPoints", _exponential)),
        F.flatten(F.transform("m.summary.dataPoints", _summary)),
    ]
    none = F.expr(f"cast(array() as {_POINT})")
    # A metric is of one kind; the others' points are null.
    points = F.concat(*[F.coalesce(x.cast(_POINT), none) for x in each])
    name = metric_name(F.col("m.name"), F.col("m.unit"), monotonic & F.col("m.sum").isNotNull())
    found = rows.select("base", name.alias("name"), F.explode(points).alias("p")).where("p.value is not null")
    entries = F.concat("base", "p.attributes", "p.own", F.array(_entry("__name__", F.concat("name", "p.suffix"))))
    return found.select(_last_of_each(entries).alias("labels"), F.expr("p.ns div 1000000").alias("ts_ms"), F.col("p.value").alias("value"), F.col("p.type").alias("type"))


def parsed(text: Column) -> Column:
    """A request's JSON, whose 64-bit integers are numbers or strings, as the schema has it."""
    return F.from_json(text, SCHEMA.replace("bigint", "string"))["resourceMetrics"].cast(SCHEMA.split(" ", 1)[1])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON, whose 64-bit integers are numbers or strings."""
    name, kind = SCHEMA.split(" ", 1)
    return spark.read.schema(SCHEMA.replace("bigint", "string")).json(path).select(F.col(name).cast(kind).alias(name))
