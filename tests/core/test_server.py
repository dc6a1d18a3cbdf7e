"""HTTP routes, with and without a socket; traces; folders; what the index, text search and the buffer do beyond their queries."""

import base64
import json
import urllib.error
import urllib.parse
import urllib.request

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.operators import fulltext, logs, similarity as sim
from quern.plans.planner import Engine
from quern.queries import DAY, START, events_metrics
from quern.server import App, moment, number, serve, span
from quern.sources import shared
from quern.trace import traced


@pytest.fixture(scope="module")
def app(spark, sf):
    kept = []
    rows = lambda: spark.createDataFrame([(k, i, v, 1000 * i, i // 2) for i, (k, v) in enumerate(kept)], "key binary, sequence long, value binary, time_ms long, segment_id int")

    def append(records):
        kept.extend(records)
        return len(kept) - len(records)

    return App(Engine(events_metrics(spark, sf), lookback=5 * DAY), rows, append, now=lambda: (START + 15 * DAY) / 1000)


def ask(app, path, method="GET", body=b"", **params):
    status, kind, said = app.answer(method, path, {k.replace("match", "match[]"): v if isinstance(v, list) else [str(v)] for k, v in params.items()}, body)
    return status, json.loads(said) if kind == "application/json" else said


def test_queries(app):
    at = (START + 15 * DAY) // 1000
    status, got = ask(app, "/api/v1/query", query="sum by (event_type) (events_value)", time=at)
    assert status == 200 and got["status"] == "success" and got["data"]["resultType"] == "vector"
    assert {r["metric"]["event_type"] for r in got["data"]["result"]} <= {"click", "view", "purchase", "signup", "error"} and all(r["value"][0] == at for r in got["data"]["result"])
    assert ask(app, "/api/v1/query", "POST", query="1 + 1")[1]["data"] == {"resultType": "scalar", "result": [at, "2"]}
    _, got = ask(app, "/api/v1/query_range", query="sum(events_value)", start=at, end=at + 2 * 86400, step="1d", trace="true")
    assert [len(r["values"]) for r in got["data"]["result"]] == [3] and any("Aggregate" in x["operator"] for x in got["trace"])
    assert "Spark" in ask(app, "/api/v1/query", query="sum(events_value)", explain="true")[1]["explain"]


@pytest.mark.parametrize(
    "path, params, status",
    [
        ("/api/v1/query", {}, 400), ("/api/v1/query", {"query": "sum("}, 400), ("/api/v1/query", {"query": "1", "time": "soon"}, 400), ("/api/v1/query_range", {"query": "1", "start": 0, "end": 1}, 400),
        ("/api/v1/series", {}, 400), ("/federate", {}, 400), ("/nowhere", {}, 404), ("/api/v1/log/scan", {}, 400), ("/api/v1/log/count", {"key": "a", "start_seq": "x"}, 400), ("/-/healthy", {}, 200),
    ],
)
def test_what_is_refused(app, path, params, status):
    assert app.answer("GET", path, {k: [str(v)] for k, v in params.items()})[0] == status
    assert app.answer("DELETE", "/api/v1/query", {})[0] == 405


def test_discovery_routes(app):
    assert ask(app, "/api/v1/labels")[1]["data"] == ["__name__", "event_type", "user_id"]
    assert len(ask(app, "/api/v1/label/event_type/values")[1]["data"]) == 5
    got = ask(app, "/api/v1/series", match=['events_value{event_type="click",user_id="1"}'])[1]["data"]
    assert got == [{"__name__": "events_value", "event_type": "click", "user_id": "1"}]
    assert ask(app, "/api/v1/metadata")[1]["data"] == {}
    assert ask(app, "/federate", match=["events_value"])[1].startswith("events_value{event_type=")


def test_log_routes(app):
    b64 = lambda x: base64.b64encode(x).decode()
    body = json.dumps({"records": [{"key": {"value": b64(k)}, "value": b64(v)} for k, v in ((b"a", b"1"), (b"b", b"2"), (b"a", b"3"))]}).encode()
    assert ask(app, "/api/v1/log/append", "POST", body)[1] == {"status": "success", "recordsAppended": 3, "startSequence": 0}
    assert app.answer("POST", "/api/v1/log/append", {}, b"{}")[0] == 400
    got = ask(app, "/api/v1/log/scan", key="a", limit=1)[1]
    assert got["values"] == [{"sequence": 0, "value": b64(b"1")}] and got["nextSequence"] == 1 and got["key"] == {"value": b64(b"a")}
    assert ask(app, "/api/v1/log/scan", key="z", start_seq=2, follow="true", timeout_ms=1)[1] == {"status": "success", "key": {"value": b64(b"z")}, "values": [], "nextSequence": 2}
    assert ask(app, "/api/v1/log/count", key="a", start_seq=1)[1]["count"] == 1
    assert [k["key"]["value"] for k in ask(app, "/api/v1/log/keys", start_segment=0, end_segment=1)[1]["keys"]] == [b64(b"a"), b64(b"b")]
    assert ask(app, "/api/v1/log/segments", start_seq=2)[1]["segments"] == [{"id": 1, "startSeq": 2, "startTimeMs": 2000}]
    assert not any("append" in pattern for _, pattern, _ in App(log=lambda: None).routes)  # a log that is only read


def test_a_server_answers(app):
    server = serve(app)
    at = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert urllib.request.urlopen(f"{at}/-/ready").read() == b"OK"
        form = urllib.parse.urlencode({"query": "vector(3)"}).encode()
        got = json.load(urllib.request.urlopen(urllib.request.Request(f"{at}/api/v1/query", form)))
        assert got["data"]["result"][0]["value"][1] == "3"
        with pytest.raises(urllib.error.HTTPError, match="400"):
            urllib.request.urlopen(f"{at}/api/v1/query")
    finally:
        server.shutdown()


def test_numbers_and_times():
    assert [number(x) for x in (1.0, -2.5, float("nan"), float("inf"), float("-inf"))] == ["1", "-2.5", "NaN", "+Inf", "-Inf"]
    assert moment("1.5") == 1500 and moment("1970-01-01T00:00:02Z") == 2000 and span("15") == 15_000 and span("5m") == 300_000


def test_trace_counts_rows(spark):
    found = traced(spark.range(100).where("id % 2 = 0").groupBy((F.col("id") % 5).alias("k")).count())
    assert any("number of output rows" in x["metrics"] for x in found) and found[0]["depth"] == 0 and len({x["depth"] for x in found}) > 2


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        shared.shared_folder(Session)
    Context.master = "local[2]"
    assert shared.shared_folder(Session)


def test_byte_lengths(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, 63, 64, 65, 71, 72, 127, 128, 1000, 20_000, (1 << 30) - 1, 1 << 40)], "n long")
    got = [r[0] for r in rows.select(fulltext.quantised(F.col("n"))).collect()]
    assert got == [0, 1, 63, 64, 64, 64, 72, 120, 128, 960, 18432, 15 << 26, 15 << 26]
    every = spark.range(20_000).select(F.count_distinct(fulltext.quantised(F.col("id")))).first()[0]
    assert every == 64 + 8 * 8 + 2  # eight of each power of two up to 16384, two of the last


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_many_queries_in_blocks(spark, metric):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=6)]) for i in range(300)], "id long, vector array<double>").repartition(3)
    queries = rows.where("id % 10 = 0")
    found = sim.search_blocks(rows, queries, 7, metric, shard_rows=64, lot=4)
    want = sim.search_many(rows, [(r["id"], list(r["vector"])) for r in queries.collect()], 7, metric)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"]) for r in df.collect())
    assert key(found) == key(want) and found.count() == 30 * 7
    assert sim.search_blocks(rows, queries, 1000, metric).count() == 30 * 300
    assert sim.search_blocks(rows, queries.limit(0), 7, metric).count() == 0


def test_lists_are_divided_and_given_up(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 4)) * 10
    rows = spark.createDataFrame([(i, [float(v) for v in centres[i % 6] + rng.normal(size=4)]) for i in range(600)], "id long, vector array<double>")
    index = sim.maintained(sim.assigned(rows, np.concatenate((centres[:1], centres[:1] + 0.1, centres[:1] + 500))), split=80, merge=10)
    sizes = [r["count"] for r in index.postings.groupBy("centroid_id").count().collect()]
    assert sum(sizes) == 600 and max(sizes) <= 80 and len(sizes) == len(index.centroids)
    assert index.postings.select("id").distinct().count() == 600
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(200)], "id long, vector array<double>")
    assert sim.maintained(sim.build(same, 3), split=50, merge=5).postings.count() == 200  # equal vectors can't be divided


def test_rows_are_assigned_in_blocks():
    import tracemalloc

    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(5000, 8)), rng.normal(size=(2000, 8))
    tracemalloc.start()
    found = sim._nearest(pd.Series(list(x)), c, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = (c * c).sum(1) - 2 * (x @ c.T)
    assert peak < d.nbytes and [int(i) for (i,) in found] == d.argmin(1).tolist()
    assert [list(i) for i in sim._nearest(pd.Series(list(x[:900])), c, 3)] == np.argsort(d[:900], 1, kind="stable")[:, :3].tolist()


def test_watermark(spark):
    of = lambda *x: logs.watermark(spark.createDataFrame([(i,) for i in x], "sequence long"), 3).first()[0]
    assert [of(), of(3), of(4), of(3, 4, 6), of(1, 3, 3, 4, 5)] == [3, 4, 3, 5, 6]
