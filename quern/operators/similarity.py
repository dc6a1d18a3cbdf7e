"""Similarity search over rows of (id, vector, attributes): exact scoring, a partitioned index, filters, upserts.

Scores: ``l2`` is the squared distance, ``cosine`` the squared distance of unit vectors, ``dot`` the inner product (larger is nearer).
Exact search is one scan with a fold in generated code, then a top-k that each task does on its own rows first. The index is a table of
postings (centroid_id, id, vector, attributes) written by centroid, and a small table of centroids: a search ranks centroids, prunes,
and reads the postings of those that are left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

METRICS = ("l2", "cosine", "dot")
MAX_ID = 64  #: bytes of an id
DISTANCES = 1 << 20  #: of a block of rows to all centroids, in a worker at one time


# Filters -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Filter:
    """``eq neq in lt lte gt gte`` of a field, ``and or`` of filters. Neq keeps rows without the field."""

    op: str
    field: str | None = None
    value: object = None
    parts: tuple[Filter, ...] = ()

    def column(self) -> Column:
        if self.op in ("and", "or"):
            out = F.lit(self.op == "and")
            for p in self.parts:
                out = out & p.column() if self.op == "and" else out | p.column()
            return out
        c = F.col(self.field)
        if self.op == "neq":
            return ~c.eqNullSafe(F.lit(self.value))
        found = {
            "eq": lambda: c == F.lit(self.value), "in": lambda: c.isin(*self.value) if self.value else F.lit(False),
            "lt": lambda: c < F.lit(self.value), "lte": lambda: c <= F.lit(self.value), "gt": lambda: c > F.lit(self.value), "gte": lambda: c >= F.lit(self.value),
        }[self.op]()
        return F.coalesce(found, F.lit(False))


def eq(field: str, value) -> Filter:
    return Filter("eq", field, value)


def neq(field: str, value) -> Filter:
    return Filter("neq", field, value)


def in_(field: str, values) -> Filter:
    return Filter("in", field, tuple(values))


def and_(*parts: Filter) -> Filter:
    return Filter("and", parts=parts)


def or_(*parts: Filter) -> Filter:
    return Filter("or", parts=parts)


def filter_of(request: dict) -> Filter:
    """From a request body: {"eq": {"field": .., "value": ..}}, {"and": [..]}, ..."""
    (op, body), *more = request.items()
    if more:
        raise ValueError("a filter has one operator")
    if op in ("and", "or"):
        return Filter(op, parts=tuple(map(filter_of, body)))
    if op not in ("eq", "neq", "in", "lt", "lte", "gt", "gte"):
        raise ValueError(f"unknown filter {op!r}")
    return Filter(op, body["field"], tuple(body["values"]) if op == "in" else body["value"])


# Scores ------------------------------------------------------------------------------------------


def normalised(v: Column) -> Column:
    """Unit length; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def score(metric: str, v: Column, q: Column) -> Column:
    """Of two vectors of doubles; cosine expects unit vectors."""
    if metric == "dot":
        return F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(F.zip_with(v, q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)


def _literal(q) -> Column:
    return F.array(*[F.lit(float(x)) for x in q])


def _unit(q) -> list[float]:
    n = math.sqrt(sum(float(x) ** 2 for x in q))
    return [float(x) / n if n else float(x) for x in q]


def _check(rows: DataFrame, vector: str, q, metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric: one of {', '.join(METRICS)}")
    if not len(q):
        raise ValueError("an empty query vector")


def scored(rows: DataFrame, q, metric: str = "l2", vector: str = "vector", where: Filter | None = None) -> DataFrame:
    """``rows`` that pass the filter, with score. Vectors of another length raise while it runs."""
    _check(rows, vector, q, metric)
    if where is not None:
        rows = rows.where(where.column())
    q = _unit(q) if metric == "cosine" else [float(x) for x in q]
    v = doubles(F.col(vector))
    v = normalised(v) if metric == "cosine" else v
    found = F.when(F.size(vector) != len(q), F.raise_error(F.lit(f"vectors of other than {len(q)} dimensions")).cast("double")).otherwise(score(metric, v, _literal(q)))
    return rows.withColumn("score", found)


def top(rows: DataFrame, k: int, metric: str, id: str = "id") -> DataFrame:
    """The k best rows, best first, ties by id: each task keeps k."""
    return rows.orderBy(F.desc("score") if metric == "dot" else F.asc("score"), F.asc(id)).limit(k)


def search(rows: DataFrame, q, k: int, metric: str = "l2", where: Filter | None = None, fields: list[str] | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """Exact nearest neighbours: id, score, and the attributes asked for (None: all; []: none)."""
    return project(top(scored(rows, q, metric, vector, where), k, metric, id), fields, id)


def project(rows: DataFrame, fields: list[str] | None, id: str = "id") -> DataFrame:
    return rows.select(id, "score", *[c for c in rows.columns if c not in (id, "score") and (fields is None or c in fields)])


def search_many(rows: DataFrame, queries: list[tuple[object, list[float]]], k: int, metric: str = "l2", id: str = "id", vector: str = "vector") -> DataFrame:
    """query_id, rank, id, score for many queries in one scan: blocks of rows times the queries, k kept a batch and query.

    The queries travel with the tasks: a list that the caller holds already.
    """
    ids = [i for i, _ in queries]
    q = np.array([_unit(x) if metric == "cosine" else x for _, x in queries], float)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(float)
            if metric == "cosine":
                n = np.sqrt((x * x).sum(1, keepdims=True))
                x = x / np.where(n > 0, n, 1)
            own = batch["id"].to_numpy()
            for i, one in enumerate(q):
                s = (x * one).sum(1) if metric == "dot" else ((x - one) ** 2).sum(1)
                best = np.lexsort((own, -s if metric == "dot" else s))[:k]
                yield pd.DataFrame({"n": i, "id": own[best], "score": s[best]})

    kind = rows.schema[id].dataType.simpleString()
    found = rows.select(F.col(id).alias("id"), doubles(F.col(vector)).alias("v")).mapInPandas(of, f"n int, id {kind}, score double")
    order = F.desc("score") if metric == "dot" else F.asc("score")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("n").orderBy(order, "id"))).where(F.col("rank") <= k)
    names = F.create_map(*[x for i, n in enumerate(ids) for x in (F.lit(i), F.lit(n))])
    return found.select(names[F.col("n")].alias("query_id"), "rank", F.col("id").alias(id), "score")


def search_blocks(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id: str = "id", vector: str = "vector", shard_rows: int = 1 << 16, lot: int = 256) -> DataFrame:
    """query_id, rank, id, score for a table of queries (id, vector) of any size, each against all rows.

    Rows are dealt out to shards of about ``shard_rows``, which hold them as one block; queries travel in lots to every shard and are
    answered as they stream by, k kept a shard, so no task holds more than a shard and a lot.
    """
    _check(rows, vector, [0.0], metric)
    spark, kind = rows.sparkSession, rows.schema[id].dataType.simpleString()
    shards = max(1, math.ceil(rows.count() / shard_rows))
    v = normalised(doubles(F.col(vector))) if metric == "cosine" else doubles(F.col(vector))

    def block(ids: pa.Array, vectors: pa.Array) -> tuple[list, bytes]:
        return ids.to_pylist(), vectors.flatten().to_numpy(zero_copy_only=False).astype(float).tobytes()

    def pack(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, x = block(t.column("id").combine_chunks(), t.column("v").combine_chunks())
        return pa.table([t.column("shard")[:1], pa.array([0], pa.int32()), pa.array([ids], pa.list_(t.schema.field("id").type)), pa.array([x], pa.binary())], names=["shard", "part", "ids", "x"])

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), lot):
                ids, x = block(batch.column("id").slice(i, lot), batch.column("v").slice(i, lot))
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(batch.schema.field("id").type)), pa.array([x], pa.binary())], names=["ids", "x"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, ids, x in zip(*(batch.column(c) for c in ("part", "ids", "x"))):
                if part.as_py() == 0:
                    own = ids.values.to_numpy(zero_copy_only=False)
                    have = np.frombuffer(x.as_py(), float).reshape(len(own), -1)
                    continue
                asked = ids.as_py()
                q = np.frombuffer(x.as_py(), float).reshape(len(asked), -1)
                found = []
                for one in q:
                    s = (have * one).sum(1) if metric == "dot" else ((have - one) ** 2).sum(1)
                    found.append((best := np.lexsort((own, -s if metric == "dot" else s))[:k], s[best]))
                n = min(k, len(own))
                places = np.concatenate([b for b, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array([a for a in asked for _ in range(n)], ids.values.type), pa.array(own[places], ids.values.type), pa.array(np.concatenate([s for _, s in found]))], names=["query_id", "id", "score"])

    schema = f"ids array<{kind}>, x binary"
    packed = rows.select(F.pmod(F.xxhash64(id), F.lit(shards)).cast("int").alias("shard"), F.col(id).alias("id"), v.alias("v")).groupBy("shard").applyInArrow(pack, f"shard int, part int, {schema}")
    asked = queries.select(F.col(id).alias("id"), v.alias("v")).mapInArrow(lots, schema).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("part"), "ids", "x")
    both = packed.union(asked).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard").sortWithinPartitions("shard", "part")
    found = both.select("part", "ids", "x").mapInArrow(answer, f"query_id {kind}, id {kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score") if metric == "dot" else F.asc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id), "score")


# The partitioned index ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """``centroids``: at most a few thousand rows in the driver, a number the caller chose. ``postings``: every row under its centroid."""

    centroids: np.ndarray
    postings: DataFrame
    metric: str
    id: str
    vector: str
    columns: tuple[str, ...] = field(default=())
    copies: int = 1  #: centroids that hold each row

    def search(self, q, k: int, nprobe: int | None = None, epsilon: float | None = None, where: Filter | None = None, fields: list[str] | None = None) -> DataFrame:
        """k nearest of the postings of the nearest centroids: ``nprobe`` of them (default: k, at least 10, at most 100), less those that
        are farther than the nearest by a factor of 1 + ``epsilon`` (squared for distances). Filters hold before the top k.
        """
        chosen = self.probe(q, nprobe or min(max(k, 10), 100), epsilon)
        rows = self.postings.where(F.col("centroid_id").isin(*chosen)).drop("centroid_id")
        found = scored(rows, q, self.metric, self.vector, where)
        if self.copies > 1:
            found = found.dropDuplicates([self.id])  # copies of a row have one score
        return project(top(found, k, self.metric, self.id), fields, self.id)

    def probe(self, q, nprobe: int, epsilon: float | None = None) -> list[int]:
        q = np.array(_unit(q) if self.metric == "cosine" else q, float)
        d = -(self.centroids @ q) if self.metric == "dot" else ((self.centroids - q) ** 2).sum(1)
        order = np.argsort(d, kind="stable")[:nprobe]
        if epsilon is not None and len(order) and (self.metric != "dot" or d[order[0]] < 0):
            if self.metric == "dot":
                order = order[d[order] <= d[order[0]] / (1 + epsilon)]
            else:
                order = order[d[order] <= (1 + epsilon) ** 2 * d[order[0]]]
        return [int(i) for i in order]


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * (x @ c.T), 1)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        if (n == 0).any():  # a centroid without rows begins anew at one of the largest cluster
            c[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
    return c


def build(rows: DataFrame, centroids: int, metric: str = "l2", sample: int = 100_000, seed: int = 0, id: str = "id", vector: str = "vector") -> Index:
    """Centroids by k-means on at most about ``sample`` rows; every row goes to its nearest one."""
    v = doubles(F.col(vector))
    v = normalised(v) if metric == "cosine" else v
    n = rows.count()
    luck = F.pmod(F.xxhash64(id, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    x = np.array([r[0] for r in rows.where(luck * n < sample).select(v).collect()], float)
    c = lloyd(x, min(centroids, len(x)), seed=seed) if len(x) else np.zeros((0, 0))
    return assigned(rows, c, metric, id, vector)


def _nearest(x: pd.Series, c: np.ndarray, copies: int) -> list[np.ndarray]:
    """Numbers of the nearest centroids of each vector, by blocks: what is in memory grows neither with rows nor with centroids."""
    found, own = [], (c * c).sum(1)
    for i in range(0, len(x), block := max(1, DISTANCES // len(c))):
        d = own - 2 * (np.stack(x.iloc[i : i + block].to_numpy()).astype(float) @ c.T)
        best = np.argmin(np.where(np.isnan(d), np.inf, d), 1)[:, None] if copies == 1 else np.argsort(d, 1, kind="stable")[:, :copies]
        found.extend(best.astype(np.int32))
    return found


def assigned(rows: DataFrame, centroids: np.ndarray, metric: str = "l2", id: str = "id", vector: str = "vector", copies: int = 1) -> Index:
    """The index of these centroids (a number the caller chose): every row goes to its nearest one, or to its ``copies`` nearest."""
    c, v = np.asarray(centroids, float), doubles(F.col(vector))
    v = normalised(v) if metric == "cosine" else v
    shared = rows.sparkSession.sparkContext.broadcast(c)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def nearest(x: pd.Series) -> pd.Series:
        return pd.Series(_nearest(x, shared.value, copies), dtype=object)

    postings = rows.withColumn("centroid_id", F.explode(nearest(v)) if len(c) else F.lit(0))
    return Index(c, postings, metric, id, vector, tuple(rows.columns), copies)


def maintained(index: Index, split: int = 150, merge: int = 50, rounds: int = 20, sample: int = 20_000) -> Index:
    """The index with lists of at most ``split`` rows, as far as their vectors differ, and lists of fewer than ``merge`` given up.

    Each round divides lists that are too long in two, by 2-means on at most about ``sample`` of their rows a list, and drops the
    centroids of lists that are too short; rows then go to their nearest centroid, as neighbours of a changed list may have to. Rows
    are assigned on executors; the driver holds centroids, and of each list to be divided the sums of two halves.
    """
    rows = index.postings.select(*index.columns).distinct() if index.copies > 1 else index.postings.select(*index.columns)
    v = doubles(F.col(index.vector))
    v = normalised(v) if index.metric == "cosine" else v
    for turn in range(rounds):
        index = assigned(rows, index.centroids, index.metric, index.id, index.vector)
        n = {r["centroid_id"]: r["count"] for r in index.postings.groupBy("centroid_id").count().collect()}
        long = [i for i, x in n.items() if x > split]
        short = [i for i in range(len(index.centroids)) if n.get(i, 0) < merge] if turn % 2 == 0 and turn < rounds - 2 else [i for i in range(len(index.centroids)) if i not in n]
        short = short[: max(0, len(index.centroids) - 1)] if len(short) == len(index.centroids) else short
        if not long and not short:
            break

        def halves(pdf: pd.DataFrame) -> pd.DataFrame:
            c = lloyd(np.stack(pdf["v"].to_numpy()).astype(float), 2, 8)
            return pd.DataFrame({"centroid_id": int(pdf["centroid_id"].iloc[0]), "c": list(c)})

        sizes = index.postings.sparkSession.createDataFrame([(i, n[i]) for i in long], "centroid_id int, n long")
        luck = F.pmod(F.xxhash64(index.id, F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        some = index.postings.join(F.broadcast(sizes), "centroid_id").where(luck * F.col("n") < sample).select("centroid_id", v.alias("v"))
        new = [r["c"] for r in some.groupBy("centroid_id").applyInPandas(halves, "centroid_id int, c array<double>").orderBy("centroid_id", "c").collect()]
        gone = {*long, *short}
        kept = [c for i, c in enumerate(index.centroids) if i not in gone]
        centroids = np.array([*kept, *new], float).reshape(-1, index.centroids.shape[1])
        if len(centroids) == 0:
            centroids = index.centroids[:1]
        index = assigned(rows, centroids, index.metric, index.id, index.vector)
    return index


def write(index: Index, path: str) -> None:
    """Postings as Parquet, a folder a centroid, so that a search opens only those it probes; centroids beside them."""
    spark = index.postings.sparkSession
    index.postings.repartition("centroid_id").write.mode("overwrite").partitionBy("centroid_id").parquet(f"{path}/postings")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.centroids)], "centroid_id int, vector array<double>").write.mode("overwrite").parquet(f"{path}/centroids")


def read(spark, path: str, metric: str = "l2", id: str = "id", vector: str = "vector") -> Index:
    c = spark.read.parquet(f"{path}/centroids").orderBy("centroid_id").collect()
    return Index(np.array([r["vector"] for r in c]), spark.read.parquet(f"{path}/postings"), metric, id, vector)


# Writes ------------------------------------------------------------------------------------------


def validated(rows: DataFrame, dimensions: int, schema: dict[str, str] | None = None, id: str = "id", vector: str = "vector") -> DataFrame:
    """``rows``, or an error while it runs: ids of at most 64 bytes, vectors there and of ``dimensions``. With a schema (name: type)
    unknown attributes and wrong types are errors at once.
    """
    if schema:
        for f in rows.schema.fields:
            if f.name in (id, vector, "seq", "deleted"):
                continue
            if f.name not in schema:
                raise ValueError(f"unknown attribute {f.name!r}")
            if f.dataType.simpleString() != schema[f.name]:
                raise ValueError(f"attribute {f.name!r} is {f.dataType.simpleString()}, not {schema[f.name]}")
    live = ~F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in rows.columns else F.lit(True)
    wrong = (
        F.when(F.col(id).isNull() | (F.octet_length(F.col(id).cast("string")) > MAX_ID), F.lit(f"an id of 1 to {MAX_ID} bytes is needed"))
        .when(live & F.col(vector).isNull(), F.lit("the vector is missing"))
        .when(live & (F.size(vector) != dimensions), F.lit(f"vectors need {dimensions} dimensions"))
    )
    return rows.withColumn(id, F.when(wrong.isNotNull(), F.raise_error(wrong).cast(rows.schema[id].dataType)).otherwise(F.col(id)))


def upserted(log: DataFrame, id: str = "id", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The live rows of a log of writes: the last operation of each id wins; deletes of what isn't there do nothing."""
    rest = [c for c in log.columns if c != id]
    last = log.groupBy(id).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(id, "_r.*")
    return last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(seq, deleted)


def get(rows: DataFrame, ids: list, fields: list[str] | None = None, id: str = "id") -> DataFrame:
    """Rows of the ids, those that are missing left out, in the order asked for."""
    place = F.array_position(F.array(*map(F.lit, ids)), F.col(id))
    found = rows.where(F.col(id).isin(*ids)).orderBy(place)
    return found if fields is None else found.select(id, *[c for c in fields if c != id])


def lookup(rows: DataFrame, wanted: DataFrame, fields: list[str] | None = None, id: str = "id") -> DataFrame:
    """The rows of the ids in ``wanted`` (id, place), in the order of the places; ids that are missing are left out."""
    found = wanted.select(F.col(id), F.col("place").alias("_place")).join(rows, id).orderBy("_place", id).drop("_place")
    return found if fields is None else found.select(id, *[c for c in fields if c != id])


def request(rows: DataFrame, body: dict, metric: str = "l2", index: Index | None = None, id: str = "id", vector: str = "vector", text: str | None = None) -> DataFrame:
    """A search request: {vector | bm25: {query}, k, nprobe, filter, includeFields}. Both kinds at once are an error."""
    where = filter_of(body["filter"]) if body.get("filter") else None
    fields = body.get("includeFields")
    if ("vector" in body) == ("bm25" in body):
        raise ValueError("one of vector and bm25 is needed")
    if "bm25" in body:
        from .fulltext import search as bm25

        return bm25(rows, body["bm25"].get("field", text), body["bm25"]["query"], body["k"], where, fields, id)
    if index is not None:
        return index.search(body["vector"], body["k"], body.get("nprobe"), where=where, fields=fields)
    return search(rows, body["vector"], body["k"], metric, where, fields, id, vector)
