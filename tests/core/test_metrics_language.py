"""The metrics language on small tables whose results are known: full label sets, values within 1e-6."""

import math

import pytest
from pyspark.sql import functions as F

from quern.plans.ast import Number, QueryError, Selector
from quern.plans.optimize import optimize
from quern.plans.parser import duration_ms, parse
from quern.plans.planner import Engine
from quern.sources.metrics import Metrics, normalise

INF, NAN = math.inf, math.nan
MIN = 60_000


def table(spark, series, interval=5 * MIN, stale=()):
    """{"name{a=b}": [values]}: a sample each interval, None for none; stale: (name, position)."""
    rows = []
    for key, values in series.items():
        name, _, rest = key.partition("{")
        labels = {"__name__": name} | dict(x.split("=") for x in rest.rstrip("}").split(",") if x)
        rows += [(labels, i * interval, float(v), False) for i, v in enumerate(values) if v is not None]
        rows += [(labels, i * interval, NAN, True) for n, i in stale if n == key]
    df = spark.createDataFrame(rows, "labels map<string,string>, ts_ms long, value double, stale boolean")
    return Metrics.tables(*normalise(df))


@pytest.fixture(scope="module")
def data(spark):
    return table(
        spark,
        {
            "http{job=api,instance=0}": range(0, 110, 10), "http{job=api,instance=1}": range(0, 220, 20), "http{job=app,instance=0}": range(0, 330, 30), "http{job=app,instance=1}": range(0, 440, 40),
            "limit{job=api}": [1000] * 11, "limit{job=app}": [2000] * 11, "resets{}": [0, 5, 10, 3, 6, 1, 1, 8, 9, 2, 4], "odd{x=nan}": [NAN] * 11, "odd{x=inf}": [INF] * 11, "odd{x=-inf}": [-INF] * 11, "odd{x=1}": [1] * 11,
            "signs{x=a}": [-2.5] * 11, "signs{x=b}": [2.5] * 11, "signs{x=c}": [0] * 11, "gone{}": [1, 2, None, None], "info{job=api,version=v1}": [1] * 11, "info{job=app,version=v2}": [1] * 11,
        },
        stale=[("gone{}", 2)],
    )


@pytest.fixture(scope="module")
def ask(data):
    def of(query, at=50 * MIN, **flags):
        found = Engine(data, **flags).instant(query, at).collect()
        return {tuple(sorted(r["labels"].items())) if "labels" in r else (): r["value"] for r in found}

    return of


def key(**labels):
    return tuple(sorted((k.replace("name_", "__name__"), v) for k, v in labels.items()))


def same(found, want):
    assert set(found) == set(want)
    for k, v in want.items():
        assert found[k] == pytest.approx(v, abs=1e-6, nan_ok=True), k


H = {(j, i): 10 * 10 * (1 + n) for n, (j, i) in enumerate((j, i) for j in ("api", "app") for i in "01")}
EACH = {key(job=j, instance=i): v for (j, i), v in H.items()}
CASES = [
    ("http{job='api',instance='0'}", {key(name_="http", job="api", instance="0"): 100}),
    ("http{job!='api',instance=~'0|2'}", {key(name_="http", job="app", instance="0"): 300}),
    ("http{job!~'a.*'}", {}), ("http{none='',job='api',instance='1'}", {key(name_="http", job="api", instance="1"): 200}),
    ("http offset 10m", {(("__name__", "http"), *k): v * 0.8 for k, v in EACH.items()}), ("http @ 600", {(("__name__", "http"), *k): v * 0.2 for k, v in EACH.items()}),
    ("http{job='api',instance='0'} @ end() offset -5m", {}), ("http @ start()", {(("__name__", "http"), *k): v for k, v in EACH.items()}),
    ("1 + 2 * 3 ^ 2 ^ 0", {(): 7}), ("-2 ^ 2", {(): -4}), ("1 / 0", {(): INF}), ("-1 / 0", {(): -INF}), ("0 / 0", {(): NAN}), ("5 % 0", {(): NAN}), ("-7 % 4", {(): -3}), ("1 > bool 2", {(): 0}), ("0x1F + 1e1 + .5", {(): 41.5}), ("Inf", {(): INF}), ("5m", {(): 300}),
    ("time()", {(): 3000}), ("vector(1)", {(): 1}), ("scalar(limit)", {(): NAN}), ("scalar(limit{job='api'})", {(): 1000}), ("scalar(limit{job='none'})", {(): NAN}),
    ("sum(http)", {(): 1000}), ("sum by (job) (http)", {key(job="api"): 300, key(job="app"): 700}), ("sum without (instance) (http)", {key(job="api"): 300, key(job="app"): 700}), ("sum(http) by (job, none)", {key(job="api"): 300, key(job="app"): 700}),
    ("avg(http)", {(): 250}), ("min(http)", {(): 100}), ("max(http)", {(): 400}), ("count(http)", {(): 4}), ("group(http)", {(): 1}), ("stddev(http)", {(): math.sqrt(12500)}), ("stdvar(http)", {(): 12500}),
    ("max(odd)", {(): INF}), ("min(odd)", {(): -INF}), ("sum(odd)", {(): NAN}), ("max(odd{x='nan'})", {(): NAN}), ("count(none)", {}),
    ("quantile(0.5, http)", {(): 250}), ("quantile(-1, http)", {(): -INF}), ("quantile(2, http)", {(): INF}), ("quantile by (job) (0.25, http)", {key(job="api"): 125, key(job="app"): 325}),
    ("topk(2, http)", {key(name_="http", job="app", instance="1"): 400, key(name_="http", job="app", instance="0"): 300}), ("bottomk by (job) (1, http)", {key(name_="http", job="api", instance="0"): 100, key(name_="http", job="app", instance="0"): 300}),
    ("topk(0, http)", {}), ("topk(1 + 0, odd)", {key(name_="odd", x="inf"): INF}), ("topk(scalar(count(limit)) - 1, http)", {key(name_="http", job="app", instance="1"): 400}),
    ("count_values('v', odd)", {key(v="NaN"): 1, key(v="+Inf"): 1, key(v="-Inf"): 1, key(v="1"): 1}), ("count_values by (job) ('n', http / 200)", {key(job="api", n="0.5"): 1, key(job="api", n="1"): 1, key(job="app", n="1.5"): 1, key(job="app", n="2"): 1}),
    ("http * 2", {k: v * 2 for k, v in EACH.items()}), ("2 - http", {k: 2 - v for k, v in EACH.items()}), ("-http", {k: -v for k, v in EACH.items()}), ("http > 250", {(("__name__", "http"), *k): v for k, v in EACH.items() if v > 250}), ("250 < http", {(("__name__", "http"), *k): v for k, v in EACH.items() if v > 250}),
    ("http > bool 250", {k: float(v > 250) for k, v in EACH.items()}), ("odd == odd", {key(name_="odd", x="inf"): INF, key(name_="odd", x="-inf"): -INF, key(name_="odd", x="1"): 1}), ("odd != 1", {key(name_="odd", x="inf"): INF, key(name_="odd", x="-inf"): -INF, key(name_="odd", x="nan"): NAN}),
    ("http + http", {k: v * 2 for k, v in EACH.items()}), ("http / on(job) group_left limit", {k: v / (1000 if dict(k)["job"] == "api" else 2000) for k, v in EACH.items()}),
    ("limit - on(job) group_right http", {k: (1000 if dict(k)["job"] == "api" else 2000) - v for k, v in EACH.items()}), ("http * on(job) group_left(version) info", {(*k, ("version", "v1" if dict(k)["job"] == "api" else "v2")): v for k, v in EACH.items()}),
    ("sum by (job) (http) / ignoring(none) limit", {key(job="api"): 0.3, key(job="app"): 0.35}), ("http{instance='0'} + on(job) http{instance='1'}", {key(job="api"): 300, key(job="app"): 700}),
    ("http and on(job) limit{job='api'}", {(("__name__", "http"), *k): v for k, v in EACH.items() if dict(k)["job"] == "api"}), ("http unless on(job) limit{job='api'}", {(("__name__", "http"), *k): v for k, v in EACH.items() if dict(k)["job"] == "app"}),
    ("limit{job='api'} or limit", {key(name_="limit", job="api"): 1000, key(name_="limit", job="app"): 2000}), ("limit{job='api'} or on() http", {key(name_="limit", job="api"): 1000}),
    ("rate(http{job='api',instance='0'}[50m])", {key(job="api", instance="0"): 1 / 30}), ("increase(http[50m])", EACH), ("delta(http[50m])", EACH), ("irate(http{job='api'}[50m])", {key(job="api", instance="0"): 1 / 30, key(job="api", instance="1"): 2 / 30}),
    ("idelta(http{job='api'}[50m])", {key(job="api", instance="0"): 10, key(job="api", instance="1"): 20}), ("resets(resets[51m])", {(): 3}), ("changes(resets[51m])", {(): 9}), ("changes(odd[51m])", {key(x=x): 0 for x in ("nan", "inf", "-inf", "1")}),
    ("irate(resets[20m] offset 20m)", {(): 0}), ("idelta(resets[10m] @ 900)", {(): -7}), ("irate(resets[10m] @ 900)", {(): 3 / 300}),
    ("sum_over_time(resets[51m])", {(): 49}), ("avg_over_time(resets[51m])", {(): 49 / 11}), ("min_over_time(resets[51m])", {(): 0}), ("max_over_time(resets[51m])", {(): 10}), ("count_over_time(resets[15m])", {(): 3}), ("last_over_time(resets[15m])", {key(name_="resets"): 4}),
    ("stddev_over_time(resets[10m])", {(): 1}), ("stdvar_over_time(resets[10m])", {(): 1}), ("quantile_over_time(0.5, resets[15m])", {(): 4}), ("present_over_time(resets[15m])", {(): 1}), ("max_over_time(odd{x='nan'}[15m])", {key(x="nan"): NAN}), ("rate(resets[5m])", {}),
    ("max_over_time(sum(http)[20m:10m])", {(): 1000}), ("sum_over_time(vector(1)[10m:1m])", {(): 10}), ("count_over_time(http{job='api',instance='0'}[20m:7m])", {key(job="api", instance="0"): 3}), ("min_over_time((http{job='api',instance='0'} * 2)[20m:5m] offset 5m)", {key(job="api", instance="0"): 120}),
    ("sum_over_time(time()[10s:5s])", {(): 2995 + 3000}), ("max_over_time(rate(http{job='api',instance='0'}[10m])[20m:5m])", {key(job="api", instance="0"): 1 / 30}),
    ("abs(signs)", {key(x="a"): 2.5, key(x="b"): 2.5, key(x="c"): 0}), ("round(signs)", {key(x="a"): -2, key(x="b"): 3, key(x="c"): 0}), ("round(signs, 0.4)", {key(x="a"): -2.4, key(x="b"): 2.4, key(x="c"): 0}), ("ceil(signs)", {key(x="a"): -2, key(x="b"): 3, key(x="c"): 0}), ("floor(odd)", {key(x="nan"): NAN, key(x="inf"): INF, key(x="-inf"): -INF, key(x="1"): 1}),
    ("ln(signs)", {key(x="a"): NAN, key(x="b"): math.log(2.5), key(x="c"): -INF}), ("log2(odd)", {key(x="nan"): NAN, key(x="inf"): INF, key(x="-inf"): NAN, key(x="1"): 0}), ("sqrt(signs)", {key(x="a"): NAN, key(x="b"): math.sqrt(2.5), key(x="c"): 0}), ("sgn(odd)", {key(x="nan"): NAN, key(x="inf"): 1, key(x="-inf"): -1, key(x="1"): 1}),
    ("clamp(signs, -1, 1)", {key(x="a"): -1, key(x="b"): 1, key(x="c"): 0}), ("clamp(signs, 1, -1)", {}), ("clamp_min(odd, 2)", {key(x="nan"): NAN, key(x="inf"): INF, key(x="-inf"): 2, key(x="1"): 2}), ("clamp_max(signs, 1)", {key(x="a"): -2.5, key(x="b"): 1, key(x="c"): 0}),
    ("timestamp(limit{job='api'} offset 5m)", {key(job="api"): 2700}), ("timestamp(limit{job='api'} + 0)", {key(job="api"): 3000}), ("hour()", {(): 0}), ("minute()", {(): 50}), ("year(vector(1704067199))", {(): 2023}), ("day_of_week(vector(1704067200))", {(): 1}), ("days_in_month(vector(1706745600))", {(): 29}), ("day_of_year(vector(1704067199))", {(): 365}), ("month(odd{x='inf'})", {key(x="inf"): NAN}),
    ("label_replace(limit, 'k', '$1-${2}', 'job', '(a)(.*)')", {key(name_="limit", job="api", k="a-pi"): 1000, key(name_="limit", job="app", k="a-pp"): 2000}), ("label_replace(limit, 'job', '', 'job', 'api')", {key(name_="limit"): 1000, key(name_="limit", job="app"): 2000}), ("label_replace(limit, 'k', 'x', 'job', 'pi')", {key(name_="limit", job="api"): 1000, key(name_="limit", job="app"): 2000}),
    ("label_join(limit, 'k', '-', 'job', 'none', 'job')", {key(name_="limit", job="api", k="api--api"): 1000, key(name_="limit", job="app", k="app--app"): 2000}),
]


@pytest.mark.parametrize("query,want", CASES, ids=[c[0] for c in CASES])
def test_query(ask, query, want):
    same(ask(query), want)


def test_counter_with_resets_is_carried_to_the_edges(ask):
    # (0, 50m]: from 5 at 5m to 4 at 50m, lost 10 + 6 + 9: 24 over 2700 s; 300 s to the start, of which zero lies 5 * 2700 / 24 away.
    same(ask("increase(resets[50m])"), {(): 24 * (2700 + 300) / 2700})
    same(ask("delta(resets[50m])"), {(): -1 * (2700 + 300) / 2700})


def test_zero_clips_the_start(spark):
    m = table(spark, {"c{}": [None, None, 1, 101, 201]}, interval=MIN)
    # 1 at 120 s, 201 at 240 s; the window begins at 0: past 1.1 of the mean gap, so half a gap (30 s), but zero lies 0.6 s before.
    found = Engine(m).instant("increase(c[4m])", 4 * MIN).collect()
    assert found[0]["value"] == pytest.approx(200 * (120 + 0.6) / 120)


def test_stale_marks_end_a_series(ask):
    same(ask("gone", 5 * MIN), {key(name_="gone"): 2})
    same(ask("gone", 10 * MIN), {})
    same(ask("count_over_time(gone[11m])", 10 * MIN), {(): 2})


def test_lookback_is_open_to_the_left(ask):
    same(ask("gone", 5 * MIN - 1), {key(name_="gone"): 1})
    same(ask("limit{job='api'}", 55 * MIN - 1), {key(name_="limit", job="api"): 1000})
    same(ask("limit{job='api'}", 55 * MIN), {})


def test_range_query_agrees_with_instant_queries(data):
    e = Engine(data)
    for q in ("http", "rate(http[12m])", "sum by (job) (max_over_time(http[20m]))", "http offset 3m", "avg_over_time(resets[40m])", "min_over_time(sum(http)[20m:3m])", "http > 100 or limit", "last_over_time(gone[30m])", "resets @ 1200", "scalar(limit{job='api'}) + time()"):
        many = e.range(q, 0, 60 * MIN, 4 * MIN).collect()
        for at in range(0, 61 * MIN, 20 * MIN):
            flat = lambda rows: {(str(sorted(r["labels"].items())) if "labels" in r else "", f"{r['value']:.9f}") for r in rows}
            assert flat(e.instant(q, at).collect()) == flat(r for r in many if r["ts_ms"] == at), (q, at)


def test_wide_and_normalised_tables_agree(spark, data):
    rows = data.samples.join(data.series, "series_id")
    wide = Metrics.wide(rows, {x: F.col(f"l_{x}") for x in data.labels}, F.col("ts_ms"), F.col("value"), stale=F.col("stale"))
    for q in ("sum by (job) (rate(http[15m]))", "topk(1, http)", "gone"):
        a, b = (sorted(map(str, Engine(m).range(q, 0, 50 * MIN, 5 * MIN, flat=True).select(F.to_json(F.struct("*")).alias("r")).collect())) for m in (data, wide))
        assert len(a) == len(b) > 0


def test_compensated_sums(spark):
    m = table(spark, {"s{}": [1e100, 1, -1e100, 2]}, interval=MIN)
    assert Engine(m, exact=True).instant("sum_over_time(s[10m])", 3 * MIN).first()["value"] == 3
    assert Engine(m, exact=True).instant("avg_over_time(s[10m])", 3 * MIN).first()["value"] == 0.75


@pytest.mark.parametrize("query,message", [("http{job='api'} + on(job) http", "duplicate series"), ("label_replace(http, 'instance', 'x', 'job', '.*')", "same labelset"), ("http + on() http", "duplicate"), ("abs({__name__=~'http|limit',job='api'})", None)])
def test_what_can_not_be_matched_fails(ask, query, message):
    if message is None:
        ask(query)  # different label sets: nothing to complain about
    else:
        with pytest.raises(Exception, match=message):
            ask(query)


def test_flags_choose_other_ways(ask):
    assert set(ask("abs(limit)", keep_name=True)) == {key(name_="limit", job="api"), key(name_="limit", job="app")}
    assert set(ask("limit{job='api'} or limit", left_roster=True)) == {key(name_="limit", job="api")}
    assert set(ask("limit + on(job) http", first_wins=True)) == {key(job="api"), key(job="app")}


@pytest.mark.parametrize("query", ["", "http{", "http{job=api}", "{}", "{job=''}", "{job=~'.*'}", "sum(", "rate(http)", "http[5m]", "http[5m:1m]", "unknown(http)", "sum(1)", "topk(http)", "1 and 2", "http offset 5", "http @ x", "'text'", "http + bool 1", "http[0s]", "histogram_quantile(0.9, http)", "absent(http)", "http{a='1' or b='2'}", "sum by (a) (http) by (b)", "http group_left limit", "quantile(http, http)"])
def test_bad_queries_are_refused(data, query):
    if query == "http offset 5":
        assert parse(query).offset == 5000
        return
    with pytest.raises(QueryError):
        Engine(data).instant(query, 0)


def test_durations():
    assert duration_ms("1h30m") == 5_400_000 and duration_ms("1d") == 86_400_000 and duration_ms("10ms") == 10 and duration_ms("2.5") == 2500


def test_constants_are_folded_and_matchers_kept_once():
    assert optimize(parse("1 + 2 * 3")) == Number(7.0)
    found = optimize(parse("topk(1 + 1, x{a='b', a='b'})"))
    assert found.param == Number(2.0) and isinstance(found.expr, Selector) and len(found.expr.matchers) == 2


def test_explain_shows_query_and_plan(data):
    said = Engine(data).explain("sum by (job) (rate(http[5m]))", 0, 60 * MIN, MIN)
    assert "Aggregate(op='sum'" in said and "Physical Plan" in said and "HashAggregate" in said


def test_topk_at_the_root_comes_in_order(data):
    assert [r["value"] for r in Engine(data).instant("topk(3, http)", 50 * MIN).collect()] == [400, 300, 200]
    assert [r["value"] for r in Engine(data).instant("bottomk(3, http)", 50 * MIN).collect()] == [100, 200, 300]


def test_series_in_one_row(data):
    e = Engine(data)
    found = e.series_of(e.range("limit", 0, 10 * MIN, 5 * MIN)).collect()
    assert len(found) == 2 and all([s["ts_ms"] for s in r["samples"]] == [0, 5 * MIN, 10 * MIN] for r in found)
