"""MinHash near-dedup by min-max hashing.

A document's set is its distinct shingles of ``width`` lower-cased words. Each of 99 permutations is evaluated once per
shingle and gives two values, its minimum and its maximum: 198 unbiased values from half the hash evaluations. They
form 33 bands of 6; two sets of similarity 0.8 share none with probability (1 - 0.8**6)**33, about 4e-5, of 0.85 5e-8. Equal sets are
one item, known by its least doc_id; candidates are confirmed on full sets, and components are found by distributed union-find.

Defined results: null or empty text, or no words: empty set, linked with nothing, its own component, kept. Fewer words than
``width``: the whole sequence is the one shingle. Rows repeated with one doc_id: rows of the result with the least
component of any of them. Null doc_id: null component, kept, links nobody. Other columns: ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._spark import keyed, settle, small_batches
from .banding import Sets, linked, stars
from .graph import components

U = np.uint64
PERMUTATIONS, ROWS = 99, 6
ROW_BITS = 11  #: a row's number in a block, beside 53 bits of hash in one sortable number


def unique_by_row(row: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes (of which the upper ``64 - ROW_BITS`` bits count) of each row, in order, and where each row's begin, with the end."""
    if rows > 1 << ROW_BITS:
        half = rows // 2
        (a, at), (b, bt) = (unique_by_row(row[pick] - low, h[pick], n) for pick, low, n in ((row < half, 0, half), (row >= half, half, rows - half)))
        return np.concatenate((a, b)), np.concatenate((at, bt[1:] + len(a)))
    key = np.sort((row.astype(U) << U(64 - ROW_BITS)) | (h >> U(ROW_BITS)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return key << U(ROW_BITS), np.searchsorted(key >> U(64 - ROW_BITS), np.arange(rows + 1).astype(U))


def word_sets(width: int) -> Sets:
    def of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = B.Words(data, at, B.SPACE, lower=True)
        h, whole = w.grams(width)
        row = w.row[: len(h)]
        keep, n = whole, np.diff(w.first)
        parts, rows = [h[keep]], [row[keep]]
        for k in range(1, width):  # texts of fewer words
            few = np.flatnonzero(n == k)
            if len(few):
                g = B.grams(w.hash, k)[w.first[few]]
                parts.append(B.mix(g + U(k)))
                rows.append(few)
        return unique_by_row(np.concatenate(rows), np.concatenate(parts), len(at) - 1)

    return of


def min_max(h: np.ndarray, at: np.ndarray, permutations: int) -> np.ndarray:
    """Minimum and maximum of each non-empty set under each permutation: sets x 2 * permutations."""
    out = np.empty((len(at) - 1, 2 * permutations), U)
    factors = B.mix(np.arange(1, permutations + 1, dtype=U) * U(B.RUN)) | U(1)
    for i, a in enumerate(factors):
        x = h * a
        out[:, 2 * i] = np.minimum.reduceat(x, at[:-1])
        out[:, 2 * i + 1] = np.maximum.reduceat(x, at[:-1])
    return out


def band_keys(values: np.ndarray, rows: int, seed: int = 0) -> np.ndarray:
    """A hash of each band of ``rows`` columns: sets x bands."""
    n, k = values.shape
    bands = k // rows
    each = values[:, : bands * rows].reshape(n, bands, rows)
    key = np.broadcast_to((np.arange(1, bands + 1) + seed).astype(U) * U(B.RUN), (n, bands))
    for i in range(rows):
        key = B.mix(key ^ each[:, :, i])
        key *= U(B.GRAM)
    return B.mix(key)


def _sign(sets: Sets):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in B.blocks(batches, limit=1 << 20):
            h, cut = sets(data, at)
            n = np.diff(cut)
            some = np.flatnonzero(n)
            bands, one, two = [None] * len(n), np.zeros(len(n), U), np.zeros(len(n), U)
            if len(some):
                begin = cut[some]
                one[some], two[some] = (np.add.reduceat(B.mix(h ^ U(x)), begin) for x in (B.RUN, B.GRAM))
                keys = band_keys(min_max(h, np.concatenate((begin, [len(h)])), PERMUTATIONS), ROWS)
                for i, k in zip(some, keys):
                    bands[i] = k.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(bands, pa.binary())],
                names=["doc_id", "n_shingles", "one", "two", "bands"],
            )

    return of


def near_duplicates(docs: DataFrame, width: int = 5, hundredths: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row for each row of ``docs``."""
    small_batches(docs.sparkSession)
    docs, sets = keyed(docs), word_sets(width)
    signed = settle(docs.select("doc_id", "text").mapInArrow(_sign(sets), "doc_id long, n_shingles long, one long, two long, bands binary"))
    known = signed.where("n_shingles > 0 and doc_id is not null")
    items = known.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("most"), F.first("bands").alias("bands"))
    items = settle(items)
    found = settle(stars(items))
    # A doc_id that is repeated with other texts has several sets; each is compared.
    need = found.select("id").union(found.select("pivot")).distinct()
    whole = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text", F.octet_length("text").alias("size")).join(need, "id", "left_semi")
    sets_of = linked(settle(whole), found, sets, hundredths)
    same = known.join(items.select("n_shingles", "one", "two", "id"), ["n_shingles", "one", "two"]).where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    comps = sets_of.where("id <> component")
    # Copies of an item follow it; only where a doc_id is repeated with other texts do the links have to be closed again.
    item = same.groupBy(F.col("a").alias("doc_id")).agg(F.min("b").alias("item"), F.max("b").alias("other"))
    if item.where("item <> other").limit(1).count():
        all_ = components(same.union(comps.toDF("a", "b")))
        out = signed.select("doc_id", "n_shingles").join(all_.toDF("doc_id", "component"), "doc_id", "left")
    else:
        out = signed.select("doc_id", "n_shingles").join(item.select("doc_id", "item"), "doc_id", "left").withColumn("item", F.coalesce("item", "doc_id"))
        out = out.join(comps.toDF("item", "component"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

