"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

Vectors get one more component, sqrt(M^2 - |x|^2), and queries a zero there, with M the largest norm: Euclidean order is then the
order of inner products. Each vector goes to the nearest of at most ``PIVOTS`` pivots (a sample of that bound); what a pivot has is a
ball between a least and a largest distance, held by one shard or, by a hash of the vector, by as many as it takes. In a shard, a tree
splits at the median distance from a vantage point; a branch is left out where the triangle inequality puts all of it farther than the
k-th best so far divided by ``factor``. Factor 1 is exact search; above 1 more is left out. Leaves are blocks of vectors for a matrix
product; what it leaves in question is ranked by (score, least id) with exact scores, so any number of ties is settled. Vectors that
occur often are held once, with their k + 1 smallest ids: no query can return more of them.

Queries travel in blocks twice: first to the shards of their nearest pivot, then, with the k-th score found there, to those of the
balls that the triangle inequality does not put beyond it. The answers are merged by (score, id). Scores are recomputed in double
precision in one order of summation, so equal vectors tie exactly.

Defined results: vectors null, zero, empty, or with null or non-finite components take no part, as queries or candidates. Vectors of
another length than the query's are no candidates: they have no inner product with it. Null ids take no part. Rows repeated with one
id and vector count once; of a query id repeated with several vectors, one is searched. Fewer candidates than k: all. Empty table: no
rows. Other columns: ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._spark import partitions, settle, small_batches

FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
SHARD_ROWS, QUERIES, PIVOTS = 65_536, 512, 256
PAIRS = 1 << 15  #: pairs of vectors multiplied at a time


def build(x: np.ndarray, leaf: int, seed: int = 7) -> list:
    """A tree over rows of x: leaves are ("leaf", rows), nodes (vantage vector, inner low, high, outer low, high, inner, outer)."""
    rng = np.random.default_rng(seed)

    def split(rows: np.ndarray):
        if len(rows) <= leaf:
            return ("leaf", rows)
        p = x[rows[rng.integers(len(rows))]]
        d = np.sqrt(np.maximum(((x[rows] - p) ** 2).sum(1), 0))
        order = np.argsort(d, kind="stable")
        half = len(rows) // 2
        d = d[order]
        return (p, d[0], d[half - 1], d[half], d[-1], split(rows[order[:half]]), split(rows[order[half:]]))

    return split(np.arange(len(x)))


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in the one order of summation that scores have."""
    parts = [(q[i : i + PAIRS] * x[i : i + PAIRS]).cumsum(1)[:, -1] for i in range(0, len(q), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _unit(dimensions: int) -> float:
    """What rounding may add to a product, as a share of the norms."""
    return 4 * (dimensions + 4) * np.finfo(float).eps


def _reach(qn: np.ndarray, score: np.ndarray, top: float, unit: float, factor: float) -> np.ndarray:
    """The distance from queries of norm ``qn`` beyond which products are below ``score``, or less by ``factor``.

    A distance's square is |q|^2 + top^2 - 2 q.x, up to rounding in the lift and in the product.
    """
    square = np.maximum(qn**2 + top * top - 2 * score, 0)
    return np.sqrt(square + 4 * unit * (qn + top) ** 2) / factor * (1 + 1e-9) + 1e-12 * (qn + top)


def search(tree, x: np.ndarray, least: np.ndarray, q: np.ndarray, k: int, top: float, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Products and rows of the k of x that come first by (product, ``least``) for each of q (rows -1 where fewer).

    The tree is over x lifted to the norm ``top``, or more. ``floor``: products below these are not looked for. Matrix products and distances only leave out what is farther from the
    k-th best than their rounding can be; what remains is ranked by _products.
    """
    best, rows = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    lifted = np.concatenate((q, np.zeros((len(q), 1))), 1)
    unit = _unit(x.shape[1])
    bound = np.full(len(q), -np.inf) if floor is None else floor.copy()

    def leaf(r: np.ndarray, who: np.ndarray, near: bool) -> None:
        p, e = q[who] @ x[r].T, unit * qn[who, None] * xn[r]
        if near:
            if len(r) >= k:
                bound[who] = np.maximum(bound[who], np.partition(p - e, len(r) - k, 1)[:, len(r) - k])
            return
        some = ~(p + e < np.maximum(best[who, -1], bound[who])[:, None]).all(1)
        who, p, e = who[some], p[some], e[some]
        if not len(who):
            return
        low = np.concatenate((best[who], p - e), 1)
        low = np.maximum(np.partition(low, len(r), 1)[:, len(r)], bound[who])  # the k-th largest of k + len(r)
        i, j = np.nonzero(~(p + e < low[:, None]))
        new = _products(q[who[i]], x[r[j]])
        old_i, old_j = np.nonzero(rows[who] >= 0)
        i, score, row = np.concatenate((old_i, i)), np.concatenate((best[who][old_i, old_j], new)), np.concatenate((rows[who][old_i, old_j], r[j]))
        order = np.lexsort((least[row], -score, i))
        i, score, row = i[order], score[order], row[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        best[who[i[keep]], place[keep]], rows[who[i[keep]], place[keep]] = score[keep], row[keep]

    def visit(node, who: np.ndarray, near: bool) -> None:
        """near: only the way to the nearest leaf, for a first bound."""
        if not len(who):
            return
        if node[0] is None or isinstance(node[0], str):
            leaf(node[1], who, near)
            return
        p, a, b, c, e, inner, outer = node
        d = np.sqrt(np.maximum(((lifted[who] - p) ** 2).sum(1), 0))
        if near:
            side = d < (b + c) / 2
            visit(inner, who[side], True)
            visit(outer, who[~side], True)
            return
        gap_in, gap_out = np.maximum(np.maximum(a - d, d - b), 0), np.maximum(np.maximum(c - d, d - e), 0)
        for child, gap in sorted(((inner, gap_in), (outer, gap_out)), key=lambda t: float(t[1].sum())):
            visit(child, who[~(gap > _reach(qn[who], np.maximum(best[who, -1], bound[who]), top, unit, factor))], False)

    everyone = np.arange(len(q))
    visit(tree, everyone, True)
    visit(tree, everyone, False)
    return best, rows


def _clean(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(~bad)
    return rows.withColumn("norm", F.sqrt(norm)).where("norm > 0")


def _few(k: int):
    """A mapper's first step: each distinct vector of a batch with its k + 1 smallest ids."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("th").to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, th))
            t = th[order]
            first = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
            at = np.flatnonzero(first)
            rank = np.arange(len(t)) - np.repeat(at, np.diff([*at, len(t)]))
            yield batch.take(pa.array(np.sort(order[rank <= k])))

    return of


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1).astype(np.float64)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0))[:, None]), 1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each length of ``v``."""
    sizes = np.diff(batch.column("v").offsets.to_numpy())
    for d in np.unique(sizes):
        yield int(d), batch if (sizes == d).all() else batch.take(pa.array(np.flatnonzero(sizes == d)))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of rows of x from pivots, both lifted."""
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = ((x - p) ** 2).sum(1)
    return np.sqrt(out)


def _place(shared):
    """The nearest pivot of each vector, and its distance. ``shared``: the largest norm and lifted pivots by length."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in _by_size(batch):
                top, pivots = shared.value[d]
                for i in range(0, len(part), 1024):
                    some = part.slice(i, 1024)
                    far = _distances(_lifted(_matrix(some.column("v")), top), pivots)
                    near = far.argmin(1)
                    yield pa.RecordBatch.from_arrays([*(some.column(c) for c in ("vec_id", "v", "th")), pa.array(np.full(len(some), d), pa.int32()), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(some)), near])], names=["vec_id", "v", "th", "d", "pivot", "far"])

    return of


def _build(leaf: int, shared):
    def of(table: pa.Table) -> pa.Table:
        import pickle

        import zstandard

        ids = table.column("vec_id").to_numpy()
        x = _matrix(table.column("v").combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        _, one, back = np.unique(x, axis=0, return_index=True, return_inverse=True)
        by = np.argsort(back, kind="stable")
        cut = np.searchsorted(back[by], np.arange(len(one) + 1))
        blob = pickle.dumps((build(_lifted(x[one], shared.value[x.shape[1]][0]), leaf), x[one], ids[by], cut))
        keys = [table.column(c)[:1].combine_chunks() for c in ("d", "pivot", "part")]
        return pa.table([*keys, pa.array([zstandard.ZstdCompressor(level=1).compress(blob)], pa.binary())], names=["d", "pivot", "part", "tree"])

    return of


def _route(shared, factor: float, first: bool):
    """Queries (vec_id, v, floor) in blocks to the parts of their nearest pivot's ball, or ``first`` being over to those of all other
    balls within reach. ``shared``: by length, the largest norm, lifted pivots, least and largest distance and parts of each ball.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, part in _by_size(batch):
                if d not in shared.value:
                    continue
                top, pivots, low, high, parts = shared.value[d]
                for i in range(0, len(part), QUERIES):
                    some = part.slice(i, QUERIES)
                    ids, x, floor = some.column("vec_id").to_numpy(), _matrix(some.column("v")), some.column("floor").to_numpy(zero_copy_only=False)
                    far = _distances(np.concatenate((x, np.zeros((len(x), 1))), 1), pivots)
                    there = parts[None] > 0
                    near = np.where(there, far, np.inf).argmin(1)[:, None] == np.arange(len(pivots))
                    if first:
                        go = near
                    else:
                        norm = np.sqrt((x * x).sum(1))
                        gap = np.maximum(np.maximum(low - far, far - high), 0)
                        go = there & ~near & ~(gap > _reach(norm, floor, top, _unit(d), factor)[:, None])
                    for p in np.flatnonzero(go.any(0)):
                        who = np.flatnonzero(go[:, p])
                        rows.append((d, int(p), int(parts[p]), ids[who].tobytes(), x[who].tobytes(), floor[who].tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d", "pivot", "parts", "ids", "vectors", "floors"])

    return of


def _answer(k: int, factor: float, shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import zstandard

        have = None
        for batch in batches:
            for tree, ids, vectors, floors in zip(*(batch.column(c) for c in ("tree", "ids", "vectors", "floors"))):
                if tree.is_valid:
                    have = tree
                    continue
                if isinstance(have, pa.Scalar):  # opened for the first block of queries
                    have = pickle.loads(zstandard.ZstdDecompressor().decompress(have.as_py()))
                nodes, x, own, cut = have
                qid = np.frombuffer(ids.as_py(), np.int64)
                q = np.frombuffer(vectors.as_py(), np.float64).reshape(len(qid), -1)
                # k + 1 vectors by (score, least id): an id of any other has k before it, besides the query's own.
                scores, rows = search(nodes, x, own[cut[:-1]], q, min(k + 1, len(x)), shared.value[x.shape[1]][0], factor, np.frombuffer(floors.as_py(), np.float64))
                hit = rows >= 0
                who, what, score = np.nonzero(hit)[0], rows[hit], scores[hit]
                count = cut[what + 1] - cut[what]
                pos = np.repeat(cut[what], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                who, score, vec = np.repeat(who, count), np.repeat(score, count), own[pos]
                keep = vec != qid[who]
                who, score, vec = who[keep], score[keep], vec[keep]
                order = np.lexsort((vec, -score, who))
                who, score, vec = who[order], score[order], vec[order]
                first = np.searchsorted(who, np.arange(len(qid)))
                keep = np.arange(len(who)) - first[who] < k
                yield pa.RecordBatch.from_arrays([pa.array(qid[who[keep]]), pa.array(vec[keep]), pa.array(score[keep])], schema=_FOUND)

    return of


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = 1.0, leaf: int = 256, shards: int | None = None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k of ``vectors`` (id, vector) nearest to each row of ``queries``, which never finds its own id.

    ``shards``: so many pivots, at most ``PIVOTS``, rather than one for about ``SHARD_ROWS`` vectors and 8 at least.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    rows = _clean(vectors, id, vector).withColumn("th", F.xxhash64("v"))
    # A row for each length of vectors that there is.
    sizes = {r["d"]: (r["m"] * (1 + 1e-12), r["n"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.max("norm").alias("m"), F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    few = rows.select("vec_id", "v", "th").mapInArrow(_few(k), "vec_id long, v array<double>, th long").distinct()
    few = settle(few.withColumn("_r", F.row_number().over(Window.partitionBy("th").orderBy("vec_id"))).where(F.col("_r") <= k + 1).drop("_r"))
    many = {d: min(PIVOTS, shards or max(8, math.ceil(n / SHARD_ROWS))) for d, (_, n) in sizes.items()}
    wanted = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])
    chosen = few.select("th", "v", F.size("v").alias("d")).withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("th"), "th"))).where(F.col("r") <= PIVOTS).where(F.col("r") <= wanted[F.col("d")])
    sample: dict[int, list] = {}
    for r in chosen.collect():  # at most PIVOTS of each length
        sample.setdefault(r["d"], []).append(r["v"])
    pivots = {d: (sizes[d][0], _lifted(np.unique(np.array(v, float), axis=0), sizes[d][0])) for d, v in sample.items()}
    context = spark.sparkContext
    placed = settle(few.mapInArrow(_place(context.broadcast(pivots)), "vec_id long, v array<double>, th long, d int, pivot int, far double"))
    balls = {d: [top, at, np.zeros(len(at)), np.zeros(len(at)), np.zeros(len(at), np.int64)] for d, (top, at) in pivots.items()}
    for r in placed.groupBy("d", "pivot").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect():  # a row a pivot
        for x, value in zip(balls[r["d"]][2:], (r["low"], r["high"], math.ceil(r["n"] / SHARD_ROWS))):
            x[r["pivot"]] = value
    shared = context.broadcast({d: tuple(x) for d, x in balls.items()})
    counts = F.create_map(*[F.lit(x) for d, b in balls.items() for p, n in enumerate(b[4]) if n for x in (f"{d} {p}", int(n))])
    part = F.pmod(F.xxhash64("th", F.lit(1)), counts[F.concat_ws(" ", "d", "pivot")]).cast("int")
    # Copies of a vector share a shard, which holds it once.
    trees = settle(placed.withColumn("part", part).groupBy("d", "pivot", "part").applyInArrow(_build(leaf, shared), "d int, pivot int, part int, tree binary"))
    asked = settle(_clean(queries, id, vector).select("vec_id", "v").dropDuplicates(["vec_id"]))
    none = F.lit(None).cast("binary")

    def answers(asking: DataFrame, first: bool) -> DataFrame:
        lots = asking.select("vec_id", "v", "floor").mapInArrow(_route(shared, factor, first), "d int, pivot int, parts int, ids binary, vectors binary, floors binary")
        lots = lots.select("d", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), none.alias("tree"), "ids", "vectors", "floors")
        # A tree comes first in its shard; the queries that follow it are answered as they stream by.
        both = trees.select("d", "pivot", "part", "tree", none.alias("ids"), none.alias("vectors"), none.alias("floors")).union(lots)
        both = both.repartition(partitions(spark), "d", "pivot", "part").sortWithinPartitions("d", "pivot", "part", F.col("tree").isNull())
        return both.mapInArrow(_answer(k, factor, shared), FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    near = settle(ranked(answers(asked.withColumn("floor", F.lit(float("-inf"))), True)))
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    asking = asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = ranked(near.select("query_id", "vec_id", "score").union(answers(asking, False)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
