"""Remote-write requests: snappy-compressed protobuf messages of series, decoded in Arrow batches.

Decompression and the wire format have no built-in function, so this is an Arrow mapper; one message at a time is in memory, and a batch of rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "labels map<string,string>, ts_ms long, value double, stale boolean"
_TYPE = pa.schema([("labels", pa.map_(pa.string(), pa.string())), ("ts_ms", pa.int64()), ("value", pa.float64()), ("stale", pa.bool_())])
#: Fixed value: the bits of the NaN that marks a series' end on the wire.
STALE_BITS = 0x7FF0000000000002
ROWS = 10_000  #: rows of a batch that is handed on, or those of one series more


def _varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        at += 1
        out |= (x & 0x7F) << shift
        if x < 0x80:
            return out, at
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a message's fields: integers of varints and fixed widths, bytes of the rest."""
    at = 0
    while at < len(b):
        tag, at = _varint(b, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(b, at)
        elif kind == 1:
            value, at = int.from_bytes(b[at : at + 8], "little"), at + 8
        elif kind == 2:
            n, at = _varint(b, at)
            value, at = b[at : at + n], at + n
        elif kind == 5:
            value, at = int.from_bytes(b[at : at + 4], "little"), at + 4
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def snappy(b: bytes) -> bytes:
    """The block format, decompressed."""
    n, _ = _varint(b, 0)
    return pa.Codec("snappy").decompress(b, n, asbytes=True)


def series(message: bytes) -> Iterator[tuple[dict[str, str], list[tuple[int, float, bool]]]]:
    """Labels and samples (ms, value, stale) of a decompressed request; series without samples are left out."""
    for number, one in fields(message):
        if number != 1:
            continue
        labels, samples = {}, []
        for n, x in fields(one):
            if n == 1:
                pair = dict(fields(x))
                labels[pair.get(1, b"").decode()] = pair.get(2, b"").decode()
            elif n == 2:
                pair = dict(fields(x))
                bits, ms = pair.get(1, 0), pair.get(2, 0)
                samples.append((ms - (1 << 64) if ms >> 63 else ms, struct.unpack("<d", bits.to_bytes(8, "little"))[0], bits == STALE_BITS))
        if samples:
            yield dict(sorted(labels.items())), samples


def _packed(number: int, x: bytes) -> bytes:
    return _number(number << 3 | 2) + _number(len(x)) + x


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def message(labels: dict[str, str], samples: list[tuple[int, float]]) -> bytes:
    """A request with one series, compressed."""
    pairs = b"".join(_packed(1, _packed(1, k.encode()) + _packed(2, v.encode())) for k, v in sorted(labels.items()))
    points = b"".join(_packed(2, b"\x09" + struct.pack("<d", v) + b"\x10" + _number(ms % (1 << 64))) for ms, v in samples)
    return pa.Codec("snappy").compress(_packed(1, pairs + points), asbytes=True)


def encode(rows: DataFrame, most: int = 1000) -> DataFrame:
    """body: a request for each run of at most ``most`` samples of one series. ``rows``: labels, ts_ms, value; rows stay in their tasks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series: dict[tuple, list] = {}
            column = batch.column(0)
            ends, pairs = column.offsets.to_pylist(), list(zip(column.keys.to_pylist(), column.items.to_pylist()))
            for a, b, ms, v in zip(ends, ends[1:], batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                series.setdefault(tuple(pairs[a:b]), []).append((ms, v))
            bodies = [message(dict(k), x[i : i + most]) for k, x in series.items() for i in range(0, len(x), most)]
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.binary())], names=["body"])

    return rows.select("labels", "ts_ms", "value").mapInArrow(of, "body binary")


def _packed_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _TYPE)], schema=_TYPE)


def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples of many requests in one batch, as a batch costs as much as hundreds of rows."""
    for batch in batches:
        rows: list[tuple] = []
        for raw in batch.column(0).to_pylist():
            for labels, samples in series(snappy(raw)) if raw is not None else ():
                pairs = list(labels.items())
                rows.extend((pairs, ms, v, s) for ms, v, s in samples)
                if len(rows) >= ROWS:
                    yield _packed_rows(rows)
                    rows = []
        if rows:
            yield _packed_rows(rows)


def decode(requests: DataFrame, body: str = "body") -> DataFrame:
    """labels, ts_ms, value, stale of the requests' samples."""
    return requests.select(body).mapInArrow(decoded, SCHEMA)
