"""Substring dedup over words by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. Its minimiser is the least hash among its grams of ``gram``
words. Consecutive windows with one minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket,
so equal windows always meet there. A bucket sorts its windows, confirms equal hashes byte by byte, and so knows
for each window sequence the smallest doc_id that has it. Words of a window that a smaller doc_id also has go.

Before strings travel, each mapper sorts its own: where a string occurs in several documents of a block, all but those
of the smallest doc_id are decided on the spot, so a passage that a third of all rows share reaches its bucket once a block.

Defined results: null or empty text: no words, nothing removed. Fewer words than ``width``: no window, nothing
removed. Equal texts: the smallest doc_id keeps its windows. Rows repeated with one doc_id: each is a row of the
result, none removes the other. Null doc_id: after all others, and null again in the result. Other columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._spark import keyed, partitions, small_batches

U = np.uint64
SENT = "bucket int, data binary"
RANGES = pa.schema([("k", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_HEAD = np.dtype([("k", "<i8"), ("th", "<i8"), ("first", "<i4"), ("words", "<i4")])


def pack(head: np.ndarray, body: bytes) -> bytes:
    """Records and their strings as one compressed value."""
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head.tobytes() + body)


def unpack(values: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    heads, bodies, z = [], [], zstandard.ZstdDecompressor()
    for v in values:
        v = z.decompress(v)
        n = int.from_bytes(v[:4], "little")
        heads.append(np.frombuffer(v, dtype, n, 4))
        bodies.append(np.frombuffer(v, np.uint8, -1, 4 + n * dtype.itemsize))
    return np.concatenate(heads), np.concatenate(bodies)


def sent(bucket: np.ndarray, head: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket: its records and strings, in the order of the bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, head, start, size = bucket[order], head[order], start[order], size[order]
    body = data[B.spread(start, size)].tobytes()
    at = np.concatenate(([0], np.cumsum(size)))
    cut = [*B.run_starts(bucket), len(bucket)]
    rows = [pack(head[i:j], body[at[i] : at[j]]) for i, j in zip(cut, cut[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "data"])


def decided(key: np.ndarray, k: np.ndarray, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which strings (hash key) also occur here in a smaller k; equal hashes count where the bytes are equal."""
    order = np.lexsort((k, key))
    cut = B.run_starts(key[order])
    lead = np.repeat(order[cut], np.diff([*cut, len(order)]))
    own = np.arange(len(order))[np.argsort(order)]
    lead = lead[own]
    later = np.flatnonzero(k > k[lead])
    later = later[size[later] == size[lead[later]]]
    out = np.zeros(len(k), bool)
    out[later[B.equal(view, start[later], start[lead[later]], size[later])]] = True
    return out


def _send(width: int, gram: int, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in B.blocks(batches):
            w = B.Words(data, at, B.SPACE)
            n = len(w.hash) - width + 1
            if n <= 0:
                continue
            mins = B.sliding_min(B.grams(w.hash, gram), width - gram + 1)
            win = np.flatnonzero(w.row[width - 1 :] == w.row[:n])
            if not len(win):
                continue
            cut = np.flatnonzero(np.concatenate(([True], (win[1:] != win[:-1] + 1) | (mins[win[1:]] != mins[win[:-1]]))))
            first, last = win[cut], win[np.concatenate((cut[1:], [len(win)])) - 1] + width
            text, where = w.joined()
            start, size = where[first], where[last] - where[first]
            forward, back = B.powers(B.RUN, len(w.hash))
            sums = np.concatenate(([0], np.cumsum(w.hash * forward))).astype(U)
            key = B.mix((sums[last] - sums[first]) * back[first] + (last - first).astype(U))
            row = w.row[first]
            k, th = B.longs(batch.column("k"))[row], B.longs(batch.column("th"))[row]
            head = np.zeros(len(first), _HEAD)
            head["k"], head["th"], head["first"], head["words"] = k, th, first - w.first[row], last - first
            gone = decided(key, k, B.eights(text), start, size)
            bucket = (B.mix(mins[first]) % U(buckets)).astype(np.int64)
            bucket[gone] = -1 - (bucket[gone] % 64)  # its ranges only pass through
            size = np.where(gone, 0, size)
            yield sent(bucket, head, text, start, size)

    return of


def _count(width: int):
    def of(table: pa.Table) -> pa.Table:
        head, text = unpack(table.column("data").to_pylist(), _HEAD)
        k, n = head["k"].copy(), head["words"].astype(np.int64)
        if table.column("bucket")[0].as_py() < 0:
            row, start, end = np.arange(len(k)), np.zeros(len(k), np.int64), n
        else:
            w = B.Words(text, np.array([0, len(text)]), b" ")
            at = np.concatenate(([0], np.cumsum(n)))
            win = B.spread(at[:-1], n - width + 1)
            row = np.repeat(np.arange(len(n)), n - width + 1)
            h = B.grams(w.hash, width)[win]
            order = np.lexsort((k[row], h))
            win, row, h = win[order], row[order], h[order]
            begin, size = w.start[win], w.end[win + width - 1] - w.start[win]
            cut = B.run_starts(h)
            length = np.diff([*cut, len(h)])
            lead = np.repeat(cut, length)
            i = np.flatnonzero(k[row] > k[row[lead]])
            same = (size[i] == size[lead[i]]).copy()
            same[same] = B.equal(B.eights(text), begin[i[same]], begin[lead[i[same]]], size[i[same]])
            dup = np.zeros(len(h), bool)
            dup[i[same]] = True
            for g in np.unique(lead[i[~same]]):  # one hash for different windows: count their bytes
                least: dict[bytes, int] = {}
                for j in range(g, len(h)):
                    if h[j] != h[g]:
                        break
                    b = text[begin[j] : begin[j] + size[j]].tobytes()
                    dup[j] = k[row[j]] > least.setdefault(b, k[row[j]])
            row, start = row[dup], (win - at[row])[dup]
            row, start, end = B.merged(row, start, start + width)
        start, end = start + head["first"][row], end + head["first"][row]
        return pa.table([k[row], head["th"][row], start, end], schema=RANGES)

    return of


def _cut(keep_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = (text.as_py() or "").encode().split(None)
                kept, at, count = [], 0, 0
                for s, e in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                    count += s > at or not count
                    kept += words[at:s]
                    at = max(at, e)
                kept += words[at:]
                text = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), count, hashlib.sha256(text).hexdigest(), text.decode() if keep_text else None))
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))][: 5 + keep_text], names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return of


def repeated_windows(docs: DataFrame, width: int = 13, gram: int = 3, buckets: int | None = None) -> DataFrame:
    """k, th, start, end: ranges of words whose windows a smaller doc_id has. ``buckets``: 16 a shuffle partition."""
    spark = docs.sparkSession
    small_batches(spark)
    sent_ = docs.select("k", "th", "text").mapInArrow(_send(width, gram, buckets or 16 * partitions(spark)), SENT)
    return sent_.groupBy("bucket").applyInArrow(_count(width), "k long, th long, start long, end long")


def dedup_substrings(docs: DataFrame, width: int = 13, gram: int = 3, buckets: int | None = None, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 and, unless left out, kept (text), a row for each row of ``docs``."""
    docs = keyed(docs)
    spans = repeated_windows(docs, width, gram, buckets).groupBy("k", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    return docs.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(keep_text), schema)
