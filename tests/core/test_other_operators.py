"""Similarity and text search, logs, key-value tables, formats and streams on small tables; queries against their SQL."""

import math
import re
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions.ieee import shortest
from quern.operators import discovery, fulltext, logs, similarity as sim
from quern.plans.ast import QueryError
from quern.plans.planner import Engine
from quern.queries import ORACLE_SQL, QUERIES, events_metrics
from quern.sources import exposition, otlp, remote_write
from quern.sources.metrics import Metrics, expired, normalise, read_samples, write_samples
from quern.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


# Queries against SQL -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", [n for i, n in enumerate(sorted(QUERIES)) if n in ORACLE_SQL and (i % 4 == 0 or n[0] in "dgkuw")])
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert mine == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


# Similarity --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def shelf(spark):
    rows = [("a", [1.0, 0.0, 0.0], "shoes", 10, True), ("b", [0.0, 1.0, 0.0], "shoes", 20, False), ("c", [0.0, 0.0, 1.0], "hats", 30, None), ("d", [1.0, 0.0, 0.0], None, 40, True)]
    return spark.createDataFrame(rows, "id string, vector array<float>, category string, price long, active boolean")


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize(
    "where,want",
    [
        (None, "adbc"), (sim.eq("category", "shoes"), "ab"), (sim.neq("category", "shoes"), "dc"), (sim.in_("price", (10, 30)), "ac"), (sim.in_("price", ()), ""), (sim.and_(), "adbc"), (sim.or_(), ""),
        (sim.and_(sim.eq("category", "shoes"), sim.eq("active", True)), "a"), (sim.or_(sim.eq("category", "hats"), sim.eq("price", 40)), "dc"), (sim.filter_of({"and": [{"neq": {"field": "active", "value": True}}, {"lt": {"field": "price", "value": 30}}]}), "b"),
    ],
)
def test_filters(shelf, where, want):
    assert ids(sim.search(shelf, [1, 0, 0], 10, "l2", where)) == list(want)


def test_scores_and_fields(shelf):
    found = sim.search(shelf, [3.0, 4.0, 0.0], 2, "dot", fields=["price"]).collect()
    assert [(r["id"], r["score"]) for r in found] == [("b", 4.0), ("a", 3.0)] and found[0].asDict().keys() == {"id", "score", "price"}
    assert [round(r["score"], 6) for r in sim.search(shelf, [3, 4, 0], 2, "cosine", fields=[]).collect()] == [0.4, 0.8]
    assert sim.search(shelf, [0, 0, 0], 1, "l2").first()["score"] == 1.0
    with pytest.raises(Exception, match="dimensions"):
        sim.search(shelf, [1.0], 1).collect()
    with pytest.raises(ValueError):
        sim.search(shelf, [1, 0, 0], 1, "other")


@pytest.mark.parametrize("metric", sim.METRICS)
def test_index_recall(spark, metric):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)) + 4 * rng.normal(size=(20, 16))[rng.integers(20, size=3000)]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>").cache()
    index = sim.build(rows, 40, metric)
    hits = 0
    for q in x[:10] + 0.01:
        exact = {r["id"] for r in sim.search(rows, q, 10, metric).collect()}
        hits += len(exact & {r["id"] for r in index.search(q, 10, nprobe=12).collect()})
        assert {r["id"] for r in index.search(q, 10, nprobe=40).collect()} == exact
    assert hits >= 90, hits
    assert len(index.probe(x[0], 40, epsilon=0.0)) <= len(index.probe(x[0], 40, epsilon=2.0)) <= 40


def test_index_is_written_and_read(spark, shelf, tmp_path):
    sim.write(sim.build(shelf, 2), str(tmp_path))
    index = sim.read(spark, str(tmp_path))
    assert ids(index.search([1, 0, 0], 4, nprobe=2, where=sim.eq("category", "shoes"))) == ["a", "b"]


def test_writes_are_checked(spark, shelf):
    for row, message in (((None, [1.0] * 3), "id"), (("x" * 65, [1.0] * 3), "64"), (("x", None), "missing"), (("x", [1.0]), "3 dimensions")):
        with pytest.raises(Exception, match=message):
            sim.validated(spark.createDataFrame([row], "id string, vector array<float>"), 3).collect()
    with pytest.raises(ValueError, match="unknown"):
        sim.validated(shelf, 3, {"category": "string"})
    with pytest.raises(ValueError, match="bigint"):
        sim.validated(shelf, 3, {"category": "string", "price": "string", "active": "boolean"})
    assert sim.validated(shelf, 3, {"category": "string", "price": "bigint", "active": "boolean"}).count() == 4


def test_requests(shelf):
    assert ids(sim.request(shelf, {"vector": [1, 0, 0], "k": 1, "filter": {"eq": {"field": "category", "value": "hats"}}, "includeFields": ["price"]})) == ["c"]
    with pytest.raises(ValueError):
        sim.request(shelf, {"vector": [1, 0, 0], "bm25": {"query": "x"}, "k": 1})


# Text --------------------------------------------------------------------------------------------


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "The quick fox. The fox!", "x"), (2, "A slow fox isn't quick", "y"), (3, "nothing", "x"), (4, None, "x"), (5, "fox", "y")], "id long, text string, kind string")
    assert spark.createDataFrame([("Isn't a 3.5 naïve_x – «Été»",)], "t string").select(fulltext.tokens(F.col("t"))).first()[0] == ["isn't", "a", "3.5", "naïve_x", "été"]

    def score(terms, tf_dl):
        n, avg, df = 4, (5 + 5 + 1 + 1) / 4, {"fox": 3, "quick": 2}
        total = 0
        for t in terms:
            tf, dl = tf_dl.get(t, 0), tf_dl["dl"]
            w = math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * 2.2
            total += w - w / (1 + tf / (1.2 * (0.25 + 0.75 * dl / avg))) if tf else 0
        return total

    found = {r["id"]: r["score"] for r in fulltext.search(docs, "text", "Fox, fox QUICK", 10).collect()}
    want = {1: score(("fox", "quick"), {"fox": 2, "quick": 1, "dl": 5}), 2: score(("fox", "quick"), {"fox": 1, "quick": 1, "dl": 5}), 5: score(("fox",), {"fox": 1, "dl": 1})}
    assert found == pytest.approx(want)
    assert list(found) == sorted(want, key=lambda i: (-want[i], i))
    assert ids(fulltext.search(docs, "text", "fox quick", 10, sim.eq("kind", "y"))) == [2, 5] and ids(fulltext.search(docs, "text", "...", 10)) == []
    stored = {r["id"]: r["score"] for r in fulltext.indexed_scores(fulltext.postings(docs, "text"), fulltext.stats(docs, "text"), ["fox", "quick"]).collect()}
    assert stored == pytest.approx(want)
    assert ids(sim.request(docs, {"bm25": {"query": "nothing", "field": "text"}, "k": 3, "includeFields": ["kind"]})) == [3]


# Logs and key-value tables -----------------------------------------------------------------------


def test_log(spark, tmp_path):
    batch = spark.range(100).select(F.format_string("k%d", F.col("id") % 3).alias("key"), F.col("id").alias("n"), F.col("id").cast("string").alias("value"), (F.col("id") * 10).alias("time_ms"))
    log = logs.assign_segments(logs.append(batch.repartition(5), ["n"], first=1000), seal_entries=30)
    assert [(r["sequence"], r["n"]) for r in log.orderBy("sequence").collect()] == [(1000 + i, i) for i in range(100)] and logs.next_sequence(log) == 1100
    assert logs.next_sequence(log.limit(0)) == 0
    assert [r["n"] for r in logs.scan(log, "k1", 1010, 1020).collect()] == [10, 13, 16, 19] and logs.count(log, "k1").first()["n"] == 33
    assert {r["key"]: r["next_sequence"] for r in logs.cursors(log).collect()} == {"k0": 1100, "k1": 1098, "k2": 1099}
    segments = logs.segments(log)
    assert [r["segment_id"] for r in logs.list_segments(segments, 1025, 1051).collect()] == [34, 35] and [r["segment_id"] for r in logs.list_segments(segments, high=1000).collect()] == []
    logs.write(log, str(tmp_path / "log"))
    again = spark.read.parquet(str(tmp_path / "log"))
    assert again.count() == 100 and [r["key"] for r in logs.list_keys(again, [34]).collect()] == ["k0", "k1", "k2"]
    assert logs.retained(log, segments, now_ms=900, retention_ms=300).agg(F.min("sequence")).first()[0] == 1020 + 30
    assert sum(r["entries"] for r in logs.inspect(log).collect()) == 100


def test_key_value(spark):
    table = spark.createDataFrame([(bytes([b]), "v") for b in (1, 127, 128, 255)], "key binary, value string")
    assert [bytes(r["key"]) for r in logs.scan_keys(table, bytes([100]), bytes([255])).collect()] == [bytes([127]), bytes([128])]
    table = logs.delete(logs.put(table, spark.createDataFrame([(bytes([1]), "new"), (bytes([2]), "more")], table.schema)), spark.createDataFrame([(bytes([255]),), (b"none",)], "key binary"))
    assert {bytes(r["key"]): r["value"] for r in table.collect()} == {b"\x01": "new", b"\x02": "more", b"\x7f": "v", b"\x80": "v"}
    assert logs.get(table, b"\x01").first()["value"] == "new" and logs.get(table, b"no").count() == 0


# Formats -----------------------------------------------------------------------------------------


def test_exposition(spark):
    lines = ['# HELP a A "help"', "# TYPE a counter", "# UNIT a seconds", 'a_total{x="1,}\\"\\\\\\n",y=""} 3 1700000000 # {id="q"} 1', "b 4.5e1", "c{} +Inf 1700000000123", "", "d NaN", '# TYPE odd strange']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = {r["labels"]["__name__"]: r for r in exposition.parse(df, 7).collect()}
    assert got["a_total"]["labels"] == {"__name__": "a_total", "x": '1,}"\\\n', "y": ""} and got["a_total"]["ts_ms"] == 1_700_000_000_000 and got["a_total"]["value"] == 3
    assert (got["b"]["value"], got["b"]["ts_ms"]) == (45, 7) and (got["c"]["value"], got["c"]["ts_ms"]) == (math.inf, 1_700_000_000_123) and math.isnan(got["d"]["value"])
    moved = [r["labels"] for r in exposition.parse(df, 7, suffix_label=True).collect()]
    assert {"__name__": "a", "__suffix__": "_total", "x": '1,}"\\\n', "y": ""} in moved
    about = {r["metric"]: (r["type"], r["help"], r["unit"]) for r in exposition.metadata(df).collect()}
    assert about == {"a": ("counter", 'A "help"', "seconds"), "odd": ("unknown", "", "")}
    with pytest.raises(Exception, match="not a sample line"):
        exposition.parse(spark.createDataFrame([("what is this line",)], "value string")).collect()
    seen = {r["labels"]["__name__"]: (r["labels"].get("job"), r["value"]) for r in exposition.scraped(exposition.parse(df.where("value like 'b%'")), "j", "h:1", 5).collect()}
    assert seen == {"b": ("j", 45), "up": ("j", 1)}
    assert [r["value"] for r in exposition.scraped(exposition.parse(df), "j", "h:1", 5, ok=False).collect()] == [0]


def test_shortest_decimals(spark):
    want = {6.0: "6", 0.5: "0.5", 0.0: "0", 1e10: "10000000000", 1.2345678e7: "12345678", -1.25e-7: "-0.000000125", 1e-5: "0.00001", 1e21: "1" + "0" * 21, math.inf: "+Inf", -math.inf: "-Inf", 123456789.125: "123456789.125"}
    got = spark.createDataFrame([(v,) for v in want], "v double").select("v", shortest(F.col("v")).alias("s")).collect()
    assert {r["v"]: r["s"] for r in got} == want
    assert spark.createDataFrame([(-0.0,)], "v double").select(shortest(F.col("v"))).first()[0] == "-0"


def test_otlp(spark, tmp_path):
    body = """{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"web"}},{"key":"n","value":{"intValue":"3"}},{"key":"ok","value":{"boolValue":true}}]},"scopeMetrics":[{"scope":{"name":"lib","version":"2"},"metrics":[
    {"name":"2mem.used-x","unit":"By","gauge":{"dataPoints":[{"timeUnixNano":"5000000","asInt":"7","attributes":[{"key":"n","value":{"doubleValue":0.5}}]},{"timeUnixNano":"6000000"}]}},
    {"name":"reqs","unit":"1","sum":{"aggregationTemporality":2,"isMonotonic":true,"dataPoints":[{"timeUnixNano":"5000000","asDouble":2.5}]}},
    {"name":"delta","sum":{"aggregationTemporality":1,"isMonotonic":true,"dataPoints":[{"timeUnixNano":"5000000","asDouble":2.5}]}},
    {"name":"h","unit":"s","histogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"5000000","count":"6","bucketCounts":["1","2","3"],"explicitBounds":[0.5,10]}]}},
    {"name":"e","unit":"{x}","exponentialHistogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"5000000","count":"10","sum":3.5,"scale":0,"zeroCount":"1","positive":{"offset":-1,"bucketCounts":["2","0","3"]},"negative":{"offset":0,"bucketCounts":["4"]}}]}},
    {"name":"s","summary":{"dataPoints":[{"timeUnixNano":"5000000","count":"4","sum":8,"quantileValues":[{"quantile":0.5,"value":1.5},{"quantile":1,"value":3}]}]}}]}]}]}"""
    (tmp_path / "in.json").write_text(body.replace("\n", ""))
    rows = otlp.convert(otlp.read_json(spark, str(tmp_path / "in.json"))).collect()
    got = {(r["labels"]["__name__"], r["labels"].get("le") or r["labels"].get("quantile")): (r["value"], r["type"]) for r in rows}
    assert got == {
        ("_2mem_used_x_bytes", None): (7, "gauge"), ("reqs_total", None): (2.5, "counter"),
        ("h_seconds_bucket", "0.5"): (1, "histogram"), ("h_seconds_bucket", "10"): (3, "histogram"), ("h_seconds_bucket", "+Inf"): (6, "histogram"), ("h_seconds_count", None): (6, "histogram"),
        ("e_bucket", "1"): (3, "histogram"), ("e_bucket", "2"): (3, "histogram"), ("e_bucket", "4"): (6, "histogram"), ("e_bucket", "+Inf"): (10, "histogram"), ("e_sum", None): (3.5, "histogram"), ("e_count", None): (10, "histogram"),
        ("s", "0.5"): (1.5, "summary"), ("s", "1"): (3, "summary"), ("s_sum", None): (8, "summary"), ("s_count", None): (4, "summary"),
    }
    assert all(r["ts_ms"] == 5 for r in rows)
    first = next(r["labels"] for r in rows if r["type"] == "gauge")
    assert first == {"__name__": "_2mem_used_x_bytes", "service_name": "web", "n": "0.5", "ok": "true"}
    scoped = otlp.convert(otlp.read_json(spark, str(tmp_path / "in.json")), scope_labels=True).first()["labels"]
    assert scoped["otel_scope_name"] == "lib" and scoped["otel_scope_version"] == "2"


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (n > 127) << 7])
        n >>= 7
        if not n:
            return out


def _field(n, b):
    return _varint(n << 3 | 2) + _varint(len(b)) + b


def test_remote_write(spark):
    label = lambda k, v: _field(1, _field(1, k) + _field(2, v))
    sample = lambda ms, raw: _field(2, b"\x09" + raw + b"\x10" + _varint(ms % 2**64))
    one = label(b"__name__", b"m") + label(b"a", b"b") + sample(5, struct.pack("<d", 1.5)) + sample(-7, remote_write.STALE_BITS.to_bytes(8, "little"))
    message = _field(1, one) + _field(1, label(b"__name__", b"empty")) + _field(3, b"skipped")
    body = bytes(pa.Codec("snappy").compress(message, asbytes=True))
    got = remote_write.decode(spark.createDataFrame([(body,), (None,)], "body binary")).collect()
    assert [(r["labels"], r["ts_ms"], r["stale"]) for r in got] == [({"__name__": "m", "a": "b"}, 5, False), ({"__name__": "m", "a": "b"}, -7, True)] and got[0]["value"] == 1.5


def test_requests_are_decoded_to_common_batches():
    bodies = [remote_write.message({"__name__": "m", "i": str(i)}, [(i, float(i))]) for i in range(5)]
    (got,) = remote_write.decoded(iter([pa.RecordBatch.from_arrays([pa.array([*bodies, None], pa.binary())], names=["body"])]))
    assert got.column("ts_ms").to_pylist() == [0, 1, 2, 3, 4] and dict(got.column("labels")[4].as_py()) == {"__name__": "m", "i": "4"}


def test_samples_are_stored_by_the_hour(spark, tmp_path):
    rows = spark.createDataFrame([({"__name__": "m", "x": ""}, 0, 1.0, 1), ({"__name__": "m"}, 0, 2.0, 2), ({"__name__": "m"}, 3_600_000, 3.0, 1)], "labels map<string,string>, ts_ms long, value double, seq int")
    write_samples(rows, str(tmp_path / "m"), "seq")
    m = read_samples(spark, str(tmp_path / "m"))
    assert sorted((r["ts_ms"], r["value"]) for r in m.samples.collect()) == [(0, 2.0), (3_600_000, 3.0)]  # the newest write of one time; an empty label is none
    assert Engine(m).instant("m", 3_600_000).first()["value"] == 3.0
    assert expired(m.samples, 2 * 3_600_000, 3_600_000).count() == 0 and expired(m.samples, 2 * 3_600_000 - 1, 3_600_000).count() == 1
    plan = Engine(m).explain("m", 3_600_000)
    assert "PartitionFilters" in plan and "bucket_hour" in plan


def test_labels_are_hashed_and_days_come_after_the_shuffle(spark, sf):
    rows = spark.createDataFrame([({"b": "2", "a": "1"}, 0, 1.0), ({"a": "1", "b": "2", "c": ""}, 1, 2.0), ({"a": "1"}, 0, 3.0)], "labels map<string,string>, ts_ms long, value double")
    series, samples = normalise(rows)
    assert sorted((sorted(r["labels"].items()) for r in series.collect())) == [[("a", "1")], [("a", "1"), ("b", "2")]] and samples.count() == 3
    assert "SortAggregate" not in series._jdf.queryExecution().executedPlan().toString()
    plan = QUERIES["j5_group_left_info"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = re.split(r"Generate explode\((?!sequence\(k)", plan)[1:]
    assert below and all("REPARTITION_BY_NUM" in x.split("FileScan")[0] for x in below)


def test_time_bounds_reach_the_scan(spark, sf):
    plan = Engine(events_metrics(spark, sf)).explain("events_value{event_type='click'}", 1_704_300_000_000)
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "event_type" in pushed
    assert "props" not in next(line for line in plan.splitlines() if "ReadSchema" in line)


# Discovery ---------------------------------------------------------------------------------------


def test_discovery(spark):
    rows = [({"__name__": "m", "a": "1"}, 0, 1.0), ({"__name__": "m", "b": 'q"\\'}, 600_000, 2.5), ({"__name__": "n"}, 0, 3.0)]
    m = Metrics.tables(*normalise(spark.createDataFrame(rows, "labels map<string,string>, ts_ms long, value double")))
    assert [r.asDict() for r in discovery.series(m, ["m"]).collect()] == [{"__name__": "m", "a": "", "b": 'q"\\'}, {"__name__": "m", "a": "1", "b": ""}]
    assert [r["label"] for r in discovery.labels(m, ["n"]).collect()] == ["__name__"] and [r["label"] for r in discovery.labels(m).collect()] == ["__name__", "a", "b"]
    assert [r["value"] for r in discovery.label_values(m, "__name__").collect()] == ["m", "n"] and discovery.label_values(m, "zzz").count() == 0
    assert [r["__name__"] for r in discovery.series(m, ["m", "n"], after=-1, upto=1).collect()] == ["m", "n"]
    assert [r["line"] for r in discovery.federate(m, ["m", '{b!=""}'], 600_000, lookback=900_000).collect()] == ['m{a="1"} 1 600000', 'm{b="q\\"\\\\"} 2.5 600000']
    with pytest.raises(QueryError):
        discovery.series(m, [])


def test_active_series(spark):
    rows = spark.range(3000).select((F.col("id") % 500).alias("s"), (F.floor(F.col("id") / 100) * 60_000).alias("ts_ms"))
    got = {r["minute"]: r["active"] for r in discovery.active_series(rows, ["s"]).collect()}
    assert abs(got[0] - 100) <= 5 and abs(got[20] - 500) <= 25 and max(got) == 29 + 14


def test_active_series_are_counted_exactly(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("s"), (F.floor(F.col("id") / 20_000) * 10 * 60_000).alias("ts_ms"))
    got = {r["minute"]: r["active"] for r in discovery.active_series(rows.union(rows.where("s < 3 and ts_ms = 0")), ["s"]).collect()}
    assert got == {m: 20_000 for m in range(35)}
    estimated = {r["minute"]: r["active"] for r in discovery.active_series(rows, ["s"], precision=12).collect()}
    assert estimated.keys() == got.keys() and all(abs(n - 20_000) < 2_000 for n in estimated.values())


# Streams -----------------------------------------------------------------------------------------


def test_buffer_is_consumed_once(spark, tmp_path):
    entries = lambda *x: spark.createDataFrame([(b.encode(),) for b in x], "entry binary")
    into, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    text = lambda b: b.select(F.col("entry").cast("string").alias("e"))
    ingest.produce(entries("a", "b"), into, 1)
    run = lambda: ingest.exactly_once(ingest.consume(spark, into), mark, out, text).awaitTermination()
    run()
    ingest.produce(entries("c"), into, 2)
    run()
    run()
    assert sorted(r["e"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_otlp_comes_through_the_buffer(spark, tmp_path):
    body = '{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"m","gauge":{"dataPoints":[{"timeUnixNano":"3600000000000","asInt":"7"}]}}]}]}]}'
    into, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    ingest.produce(spark.createDataFrame([(body.encode(),)], "entry binary"), into, 1)
    ingest.exactly_once(ingest.consume(spark, into), mark, out, ingest.otlp_samples).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert [(r["labels"], r["ts_ms"], r["value"], r["bucket_hour"]) for r in got] == [({"__name__": "m"}, 3_600_000, 7.0, 1)]


def test_segments_roll_in_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("l", b"k", b"v" * 10, t) for t in (0, 5, 12, 13, 30)], "log string, key binary, value binary, time_ms long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.segmented(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), seal_ms=10)
    q = stream.writeStream.format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["sequence"], r["time_ms"], r["segment_id"]) for r in spark.sql("select * from rolled").collect())
    assert got == [(0, 0, 0), (1, 5, 0), (2, 12, 1), (3, 13, 1), (4, 30, 2)]


def test_active_series_of_a_stream(spark, tmp_path):
    rows = spark.range(60).select(F.create_map(F.lit("i"), (F.col("id") % 20).cast("string")).alias("labels"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = ingest.active_series(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("active").option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select max(active) from active").first()[0] == 15
