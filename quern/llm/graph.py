"""Distributed union-find: connected components by alternating large and small stars over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._spark import release, settle

_LOT = 1 << 19  #: links that a task contracts at a time


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex but the least of its component, and that least one."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while True:  # hook the larger root onto the smaller, then halve the paths
        p, q = root[x], root[y]
        low = np.minimum(p, q)
        before = root.copy()
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    own = np.flatnonzero(root != np.arange(len(names)))
    return names[own], names[root[own]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(lot: list) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in lot]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in contracted(a, b)], names=["u", "v"])

    lot, n = [], 0
    for batch in batches:
        lot.append(batch)
        n += len(batch)
        if n >= _LOT:
            yield out(lot)
            lot, n = [], 0
    if lot:
        yield out(lot)


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of each end of ``links`` (longs a, b; any order, repeats, loops).

    Tasks first replace the links they hold, a lot of at most ``_LOT`` at a time, by stars that link the same vertices. What then fits
    one lot is finished by one task on an executor. For more, each round is two aggregations and joins on all links; the number
    of links never grows, and every round's links are written down. A vertex with very many links is a skewed join key,
    which adaptive execution splits.
    """
    e = links.where("a <> b").select("a", "b").mapInArrow(_contract, "u long, v long").distinct()
    mark, old = None, None
    while True:
        e = settle(e)
        release(old)
        old = e
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if 0 < now[0] <= _LOT and mark is None:
            e = settle(e.repartition(1).mapInArrow(_contract, "u long, v long"))
            release(old)
            mark = now
        if now == mark or now[0] == 0:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        mark = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
