"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of characters beyond ASCII. A window is ``width`` consecutive
words of an item; an item of fewer words, but not none, is one window. The windows' hashes are broadcast; documents are scanned
once, with no shuffle, and each hit is confirmed word by word. A broadcast holds at most ``BOUND`` windows: more items go
in several passes of at most that many, so its size never follows the benchmark; an item beyond it is a pass of its own.

Defined results: null or empty text: no words, not contaminated. Items without words: never hit. Rows of ``docs`` repeated: each
is a row. Items repeated with one id count once, under all their texts. Null item_id: hits words, listed as no id. Other
columns: ignored by reports; filters keep them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _bytes as B
from ._spark import small_batches

U = np.uint64
BOUND = 2_000_000


def windows(items: list[tuple[str | None, str | None]], width: int) -> dict:
    """Items' windows by their number of words: sorted hashes, and for each the words and the items that have them."""
    texts = [(t or "").encode() for _, t in items]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    w = B.Words(data, at, B.SIGNS, lower=True)
    n = np.diff(w.first)
    lowered, out = data.tobytes().lower(), {}
    for k in sorted({width, *n[(n > 0) & (n < width)].tolist()}):
        got: dict[int, dict] = {}
        h = B.grams(w.hash, k)
        for i in np.flatnonzero((n >= width) if k == width else (n == k)).tolist():
            for j in range(w.first[i], w.first[i + 1] - k + 1):
                words = tuple(lowered[s:e] for s, e in zip(w.start[j : j + k].tolist(), w.end[j : j + k].tolist()))
                got.setdefault(int(h[j]), {}).setdefault(words, set()).add(items[i][0])
        if got:
            keys = np.array(sorted(got), U)
            out[k] = keys, [got[int(x)] for x in keys]
    return out


def _scan(shared, keep: list[str], columns: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, data, at in B.blocks(batches, limit=1 << 20):
            w = B.Words(data, at, B.SIGNS, lower=True)
            n = len(batch)
            starts, sizes, rows, ids = [], [], [], [set() for _ in range(n)]
            for k, (keys, words) in known.items():
                h, ok = w.grams(k)
                if not len(h):
                    continue
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for j in np.flatnonzero((keys[i] == h) & ok).tolist():
                    have = tuple(data[s:e].tobytes().lower() for s, e in zip(w.start[j : j + k].tolist(), w.end[j : j + k].tolist()))
                    if (found := words[i[j]].get(have)) is not None:
                        starts.append(j)
                        sizes.append(k)
                        rows.append(int(w.row[j]))
                        ids[rows[-1]] |= found
            row, start, end = B.merged(*(np.array(x, np.int64) for x in (rows, starts, np.add(starts, sizes))))
            spans: list[list] = [[] for _ in range(n)]
            hit = np.zeros(n, np.int64)
            for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()):
                hit[r] += e - s
                spans[r].append({"start": int(w.start[s] - at[r]), "end": int(w.end[e - 1] - at[r])})
            out = [pa.array(np.diff(w.first), pa.int64()), pa.array(hit), pa.array([sorted(x - {None}) for x in ids], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *out], names=[*keep, *columns])

    return of


def passes(benchmark: DataFrame, width: int, bound: int = BOUND) -> Iterator[list]:
    """Items (id as string, text) in lots of at most ``bound`` windows, one lot in the driver at a time."""
    lot, size = [], 0
    for item in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string")).toLocalIterator():
        n = max(1, len((item["text"] or "").split()) * 2 - width)
        if lot and size + n > bound:
            yield lot
            lot, size = [], 0
        lot.append((item["item_id"], item["text"]))
        size += n
    if lot:
        yield lot


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, bound: int = BOUND) -> DataFrame:
    """The columns of ``docs`` but for clashes, and n_words, n_hit, items (ids), spans (bytes of text), a row for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    columns = ["n_words", "n_hit", "items", "spans"]
    docs = docs.select(*[c for c in docs.columns if c not in columns and c != "text"], F.col("text").cast("string").alias("text"))
    lots = passes(benchmark, width, bound)
    first = next(lots, [])
    second = next(lots, None)
    more = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.mapInArrow(_scan(spark.sparkContext.broadcast(windows(first, width)), docs.columns, columns), f"{schema}, {more}")
    if second is None:
        return out
    # Further passes scan the same rows again and add what they find to the spans so far.
    lots_left = [second]
    while lots_left:
        out = out.withColumnsRenamed({"n_words": "_w", "n_hit": "_h", "items": "_i", "spans": "_s"})
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(windows(lots_left.pop(), width)), out.columns, columns), f"{schema}, {more}").mapInArrow(_together(columns), ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name not in ("_w", "_h", "_i", "_s")], more]))
        if (lot := next(lots, None)) is not None:
            lots_left.append(lot)
    return out


def _together(columns: list[str]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [c for c in batch.schema.names if c not in ("_w", "_h", "_i", "_s", *columns)]
            hit, items, spans = [], [], []
            for text, i, j, s, t in zip(*(batch.column(c).to_pylist() for c in ("text", "_i", "items", "_s", "spans"))):
                items.append(sorted({*i, *j}))
                found: list[list[int]] = []
                for a, b in sorted((x["start"], x["end"]) for x in [*s, *t]):
                    if found and a <= found[-1][1]:
                        found[-1][1] = max(b, found[-1][1])
                    else:
                        found.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in found])
                raw = (text or "").encode()
                hit.append(sum(_count(raw[a:b]) for a, b in found))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            cols = [pa.array(x, t) for x, t in zip((hit, items, spans), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("n_words"), *cols], names=[*keep, *columns])

    return of


def _count(raw: bytes) -> int:
    return len(B.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), B.SIGNS).start)


def _blank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts_ = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            if spans:
                raw, at, kept = text.encode(), 0, []
                for s in spans:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                text = b"".join([*kept, raw[at:]]).decode()
            texts_.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(texts_, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names], names=batch.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents", share: float = 0.0, bound: int = BOUND) -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words' spans cut from their texts.

    Documents go where more than ``share`` of their words are hit.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove!r}")
    own = {c: f"_own_{c}" for c in ("n_words", "n_hit", "items", "spans") if c in docs.columns}
    found = contamination(docs.withColumnsRenamed(own), benchmark, width, bound)
    if remove == "documents":
        found = found.where(F.col("n_hit") <= share * F.col("n_words"))
    else:
        found = found.mapInArrow(_blank, found.schema)
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def sha256_of_items(items: Column) -> Column:
    return F.sha2(F.concat_ws(",", items), 256)
