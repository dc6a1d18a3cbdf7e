"""HTTP routes over an engine and a log, for one driver: requests become calls of the library, results JSON.

``App`` answers (method, path, parameters, body) without a socket; ``serve`` puts it behind one. What an answer holds is collected in
the driver, as it is one response; ``limit`` bounds lists. Logs are those of operators.logs, with keys and values as bytes.
"""

from __future__ import annotations

import base64
import json
import math
import re
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, functions as F

from .operators import discovery, logs
from .plans.ast import QueryError
from .plans.parser import duration_ms
from .plans.planner import Engine
from .trace import traced


class BadRequest(ValueError):
    """What the caller asked for can't be answered."""


def _one(params: dict[str, list[str]], name: str, default=None):
    return params[name][0] if params.get(name) else default


def _whole(params: dict[str, list[str]], name: str, default: int | None = None) -> int | None:
    text = _one(params, name)
    if text is None:
        return default
    if not re.fullmatch(r"\d+", text):
        raise BadRequest(f"{name} is not a number: {text}")
    return int(text)


def _need(params: dict[str, list[str]], name: str) -> str:
    if (found := _one(params, name)) is None:
        raise BadRequest(f"missing parameter {name}")
    return found


def moment(text: str) -> int:
    """Milliseconds of a time: seconds since the epoch, or ISO 8601."""
    from datetime import datetime, timezone

    try:
        return round(float(text) * 1000)
    except ValueError:
        pass
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        raise BadRequest(f"not a time: {text}") from None
    return round((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def span(text: str) -> int:
    """Milliseconds of a step: seconds, or a duration such as 5m."""
    try:
        return round(float(text) * 1000)
    except ValueError:
        return duration_ms(text)


def number(x: float) -> str:
    """A sample's value as text."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _bytes(x) -> bytes:
    return x if isinstance(x, (bytes, bytearray)) else str(x).encode()


def _text64(x) -> str:
    return base64.b64encode(_bytes(x)).decode()


class App:
    """Routes of a metrics engine, of a log, or of both. ``append`` takes a list of (key, value) and gives the first sequence."""

    def __init__(self, engine: Engine | None = None, log: Callable[[], DataFrame] | None = None, append: Callable[[list[tuple[bytes, bytes]]], int] | None = None, now: Callable[[], float] = time.time):
        self.engine, self.log, self._append, self.now = engine, log, append, now
        self.routes: list[tuple[str, str, Callable]] = [("GET", r"/-/healthy", lambda p, b: "OK"), ("GET", r"/-/ready", lambda p, b: "OK")]
        if engine is not None:
            both = "GET|POST"
            self.routes += [
                (both, r"/api/v1/query", self.query), (both, r"/api/v1/query_range", self.query_range), (both, r"/api/v1/series", self.series), ("GET", r"/api/v1/labels", self.labels),
                ("GET", r"/api/v1/label/([^/]+)/values", self.label_values), ("GET", r"/api/v1/metadata", self.metadata), ("GET", r"/federate", self.federate),
            ]
        if log is not None:
            self.routes += [("GET", r"/api/v1/log/scan", self.scan), ("GET", r"/api/v1/log/keys", self.keys), ("GET", r"/api/v1/log/segments", self.segments), ("GET", r"/api/v1/log/count", self.count)]
            if append is not None:  # a log that is only read has no such route
                self.routes.append(("POST", r"/api/v1/log/append", self.append))

    def answer(self, method: str, path: str, params: dict[str, list[str]], body: bytes = b"") -> tuple[int, str, str]:
        """Status, content type and body."""
        found = [(m, match, f) for m, pattern, f in self.routes if (match := re.fullmatch(pattern, path))]
        if not found:
            return 404, "application/json", json.dumps({"status": "error", "message": f"no route {path}"})
        allowed = [(match, f) for m, match, f in found if method in m.split("|")]
        if not allowed:
            return 405, "application/json", json.dumps({"status": "error", "message": f"{method} is not for {path}"})
        match, f = allowed[0]
        try:
            got = f(params, body, *map(unquote, match.groups()))
        except (BadRequest, QueryError, ValueError) as e:
            return 400, "application/json", json.dumps({"status": "error", "errorType": "bad_data", "error": str(e), "message": str(e)})
        return (200, "text/plain; version=0.0.4", got) if isinstance(got, str) else (200, "application/json", json.dumps({"status": "success", **got}))

    # Metrics -------------------------------------------------------------------------------------

    def _explained(self, query: str, params: dict, start: int, end: int | None, step: int) -> dict | None:
        return {"explain": self.engine.explain(query, start, end, step)} if _one(params, "explain") == "true" else None

    def query(self, params: dict, body: bytes) -> dict:
        query, at = _need(params, "query"), moment(_one(params, "time", str(self.now())))
        if said := self._explained(query, params, at, None, 1):
            return said
        df = self.engine.instant(query, at)
        rows = df.collect()
        point = lambda r: [r["ts_ms"] / 1000, number(r["value"])]
        if "labels" not in df.columns:
            data = {"resultType": "scalar", "result": point(rows[0])}
        else:
            data = {"resultType": "vector", "result": [{"metric": r["labels"], "value": point(r)} for r in rows]}
        return {"data": data} | ({"trace": traced(df)} if _one(params, "trace") == "true" else {})

    def query_range(self, params: dict, body: bytes) -> dict:
        query, start, end, step = _need(params, "query"), moment(_need(params, "start")), moment(_need(params, "end")), span(_need(params, "step"))
        if said := self._explained(query, params, start, end, step):
            return said
        df = self.engine.range(query, start, end, step)
        if "labels" in df.columns:
            rows = self.engine.series_of(df).collect()
            result = [{"metric": r["labels"], "values": [[s["ts_ms"] / 1000, number(s["value"])] for s in r["samples"]]} for r in rows]
        else:
            result = [{"metric": {}, "values": [[r["ts_ms"] / 1000, number(r["value"])] for r in df.orderBy("ts_ms").collect()]}]
        return {"data": {"resultType": "matrix", "result": result}} | ({"trace": traced(df)} if _one(params, "trace") == "true" else {})

    def _within(self, params: dict) -> tuple[int | None, int | None]:
        start, end = _one(params, "start"), _one(params, "end")
        return (moment(start) - 1 if start else None), (moment(end) if end else None)

    def _limited(self, df: DataFrame, params: dict) -> list:
        limit = _whole(params, "limit")
        return (df if limit is None else df.limit(limit)).collect()

    def series(self, params: dict, body: bytes) -> dict:
        found = discovery.series(self.engine.metrics, params.get("match[]", []), *self._within(params))
        return {"data": [{k: v for k, v in r.asDict().items() if v != ""} for r in self._limited(found, params)]}

    def labels(self, params: dict, body: bytes) -> dict:
        return {"data": [r[0] for r in self._limited(discovery.labels(self.engine.metrics, params.get("match[]"), *self._within(params)), params)]}

    def label_values(self, params: dict, body: bytes, name: str) -> dict:
        return {"data": [r[0] for r in self._limited(discovery.label_values(self.engine.metrics, name, params.get("match[]"), *self._within(params)), params)]}

    def metadata(self, params: dict, body: bytes) -> dict:
        found = discovery.metadata(self.engine.metrics, _one(params, "metric"), _whole(params, "limit"), _whole(params, "limit_per_metric"))
        out: dict[str, list] = {}
        for r in found.collect():
            out.setdefault(r["metric"], []).append({"type": r["type"], "help": r["help"], "unit": r["unit"]})
        return {"data": out}

    def federate(self, params: dict, body: bytes) -> str:
        if not params.get("match[]"):
            raise BadRequest("missing parameter match[]")
        lines = discovery.federate(self.engine.metrics, params["match[]"], round(self.now() * 1000), self.engine.options.lookback)
        return "".join(f"{r[0]}\n" for r in lines.collect())

    # Log -----------------------------------------------------------------------------------------

    def scan(self, params: dict, body: bytes) -> dict:
        """A key's entries; with ``follow`` an empty answer waits for some until ``timeout_ms`` is over."""
        key, low, high = _need(params, "key"), _whole(params, "start_seq", 0), _whole(params, "end_seq")
        until = time.monotonic() + (_whole(params, "timeout_ms", 30_000) / 1000 if _one(params, "follow") == "true" else 0)
        while True:
            rows = logs.scan(self.log(), key.encode(), low, high).limit(_whole(params, "limit", 1000)).collect()
            if rows or time.monotonic() >= until:
                break
            time.sleep(0.1)
        values = [{"sequence": r["sequence"], "value": _text64(r["value"])} for r in rows]
        return {"key": {"value": _text64(key)}, "values": values, "nextSequence": rows[-1]["sequence"] + 1 if rows else low}

    def count(self, params: dict, body: bytes) -> dict:
        found = logs.count(self.log(), _need(params, "key").encode(), _whole(params, "start_seq", 0), _whole(params, "end_seq"))
        return {"count": found.first()["n"]}

    def keys(self, params: dict, body: bytes) -> dict:
        low, high = _whole(params, "start_segment", 0), _whole(params, "end_segment")
        rows = self.log().where(F.col("segment_id") >= low)
        rows = rows if high is None else rows.where(F.col("segment_id") < high)
        return {"keys": [{"key": {"value": _text64(r["key"])}} for r in logs.list_keys(rows).limit(_whole(params, "limit", 1000)).collect()]}

    def segments(self, params: dict, body: bytes) -> dict:
        found = logs.list_segments(logs.segments(self.log()), _whole(params, "start_seq"), _whole(params, "end_seq"))
        return {"segments": [{"id": r["segment_id"], "startSeq": r["start_seq"], "startTimeMs": r["start_time_ms"]} for r in found.collect()]}

    def append(self, params: dict, body: bytes) -> dict:
        try:
            records = [(base64.b64decode(r["key"]["value"]), base64.b64decode(r.get("value", ""))) for r in json.loads(body)["records"]]
        except (KeyError, TypeError, AttributeError, ValueError) as e:
            raise BadRequest(f"not an append request: {e}") from None
        return {"recordsAppended": len(records), "startSequence": self._append(records)}


def serve(app: App, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server in a thread of its own; ``shutdown()`` ends it. Port 0: any that is free, in ``server_address``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            url = urlsplit(self.path)
            params, body = parse_qs(url.query), self.rfile.read(int(self.headers.get("Content-Length") or 0))
            if self.headers.get("Content-Type", "").startswith("application/x-www-form-urlencoded"):
                params |= parse_qs(body.decode())
            try:
                status, kind, said = app.answer(self.command, url.path, params, body)
            except Exception as e:  # a job failed: the caller is told, the server goes on
                status, kind, said = 500, "application/json", json.dumps({"status": "error", "message": str(e)[:2000]})
            said = said.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
