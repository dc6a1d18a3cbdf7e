"""Links from LSH bands without pairs of a whole band: clusters, exact closure in bounded blocks, rounds for what has no room in one.

Items that share a band key, directly or through others, form a cluster; most clusters are small. A cluster of at most ``LIMIT`` bytes
is one block: one task holds its sets, counts what all pairs share over an inverted index, and returns its components as at most one link
an item. A larger cluster is dealt out over several blocks, each with the items that meet most others, so that copies find what they
were made from at the cost of their number. Where that leaves it in several components, all pairs of its blocks are compared but those
within one component, if that sends no more rows than its items have band keys (as when one component holds nearly all). Else the groups
of single band keys that are still in several components are closed in the same way, by blocks and at last by pairs of blocks. So no link between two items of one group is lost, no pair becomes a row, and no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _bytes as B
from ._spark import partitions, release, settle
from .graph import components, contracted

U = np.uint64
PAIRS = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pivot", pa.int64())])
_GATHER = 1 << 20  #: band keys that a mapper sorts at a time
LIMIT = 1 << 20  #: bytes of text (and ``_EACH`` an item) that are compared in one block
_EACH = 512
_HEADS = 16  #: items that stand in every block of a group that has several
Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _stars(key: np.ndarray, id: np.ndarray, alone: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and id: keys, ids, and the least id of each key; one place of each (key, id). Not ``alone``: of keys in several places."""
    order = B.order(key)
    key = key[order]
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = key[1:] == key[:-1]
    tied = np.flatnonzero(again[1:] | again[:-1])  # only these are to be sorted by id
    part, of = order[tied], key[tied]
    order[tied] = part[np.lexsort((id[part], of))]
    if not alone:
        key, order = of, order[tied]
    id = id[order]
    one = np.concatenate(([True], (key[1:] != key[:-1]) | (id[1:] != id[:-1]))) if len(key) else np.zeros(0, bool)
    key, id = key[one], id[one]
    cut = B.run_starts(key)
    return key, id, np.repeat(id[cut], np.diff(cut, append=len(id)))


def _send(buckets: int):
    def flush(keys: list, ids: list) -> pa.RecordBatch:
        key, id, pivot = _stars(np.concatenate(keys), np.concatenate(ids))
        near = id != pivot
        rows, at = [B_pairs(key[near], id[near], pivot[near])] if near.any() else [], [-1] * bool(near.any())
        key, id = key[~near], id[~near]
        bucket = (key % U(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # small numbers are sorted by their digits
        order = np.argsort(bucket, kind="stable")
        key, id, bucket = key[order], id[order], bucket[order]
        cut = [*B.run_starts(bucket), len(bucket)]
        short = (key // U(buckets)).view(np.uint8).reshape(-1, 8)[:, :5]
        for i, j in zip(cut, cut[1:]):
            at.append(int(bucket[i]))
            rows.append(np.ascontiguousarray(short[i:j]).tobytes() + id[i:j].tobytes())
        at = [b if b >= 0 else -1 - int(id[0]) % 64 for b in at]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "data"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, n = [], [], 0
        for batch in batches:
            data, at = B.texts(batch.column("bands"))
            count = np.diff(at) // 8
            keys.append(np.frombuffer(data.tobytes(), U))
            ids.append(np.repeat(B.longs(batch.column("id")), count))
            if (n := n + len(keys[-1])) >= _GATHER:
                yield flush(keys, ids)
                keys, ids, n = [], [], 0
        if n:
            yield flush(keys, ids)

    return of


def B_pairs(*columns: np.ndarray) -> bytes:
    return np.stack([c.view(np.int64) for c in columns], 1).tobytes()


def _meet(buckets: int):
    def of(table: pa.Table) -> pa.Table:
        values = table.column("data").to_pylist()
        b = table.column("bucket")[0].as_py()
        if b < 0:
            key, id, pivot = np.concatenate([np.frombuffer(v, np.int64).reshape(-1, 3) for v in values]).T
            key = (key.view(U) % U(buckets)) | (((key.view(U) // U(buckets)) & U(2**40 - 1)) << U(24))
            return pa.table([key.view(np.int64), id, pivot], schema=PAIRS)
        keys, ids = [], []
        for v in values:
            n = len(v) // 13
            k = np.zeros((n, 8), np.uint8)
            k[:, 3:] = np.frombuffer(v, np.uint8, n * 5).reshape(n, 5)
            keys.append(k.view(U).ravel())
            ids.append(np.frombuffer(v, np.int64, n, n * 5))
        key, id, pivot = _stars(np.concatenate(keys), np.concatenate(ids), alone=False)
        near = id != pivot
        key |= U(b)
        return pa.table([key[near].view(np.int64), id[near], pivot[near]], schema=PAIRS)

    return of


def stars(items: DataFrame, buckets: int | None = None) -> DataFrame:
    """key, id, pivot from items (id, bands: 8-byte keys one after the other); an item alone in its groups gives none."""
    n = min(buckets or 4 * partitions(items.sparkSession), 1 << 24)
    return items.select("id", "bands").mapInArrow(_send(n), "bucket int, data binary").groupBy("bucket").applyInArrow(_meet(n), "key long, id long, pivot long")


def _columns(h: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items by hash; where the items of each hash that several have begin, how many they are, and how many hashes have these same items."""
    order = B.order(h)
    h, item = h[order], item[order]
    start = B.run_starts(h)
    count = np.diff(start, append=len(h))
    some = count > 1
    if not some.any():
        return item, start[:0], count[:0], count[:0]
    each = B.mix(np.arange(1, item.max() + 2, dtype=U) * U(B.BASE))
    mark = np.add.reduceat(each[item], start)[some]
    by = B.order(mark)
    cut = B.run_starts(mark[by])
    return item, start[some][by[cut]], count[some][by[cut]], np.diff(cut, append=len(by))


def _count(both: np.ndarray, at: np.ndarray, place: np.ndarray, item: np.ndarray, start: np.ndarray, count: np.ndarray, weight: np.ndarray) -> None:
    """Add each column's weight to both[at[x] + place[y]] for all its items x and y."""
    pairs = np.concatenate(([0], np.cumsum(count**2)))
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(pairs, pairs[i] + (1 << 18), "right")) - 1)
        n, begin = count[i:j], start[i:j]
        times = np.repeat(n, n)
        left = np.repeat(at[item[B.spread(begin, n)]], times)
        right = place[item[B.spread(np.repeat(begin, n), times)]]
        np.add.at(both, left + right, np.repeat(weight[i:j], n * n).astype(both.dtype))
        i = j


def _small(h: np.ndarray, cut: np.ndarray, block: np.ndarray, label: np.ndarray, side: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between labels of the sets h[cut[i]:cut[i+1]] of one block, for many blocks (0, 1, ..., sets in their order) of few sets at once."""
    size = np.diff(cut)
    n = np.bincount(block)
    first = np.cumsum(n) - n
    base = np.cumsum(n * n) - n * n
    place = np.arange(len(block)) - first[block]
    at = base[block] + place * n[block]
    item, start, count, weight = _columns(B.mix(h ^ np.repeat(B.mix((block + 1).astype(U) * U(B.RUN)), size)), np.repeat(np.arange(len(block)), size))
    both = np.zeros(int((n * n).sum()), np.int32)
    _count(both, at, place, item, start, count, weight)
    some = np.flatnonzero(both)
    of = np.searchsorted(base, some, "right") - 1
    x, y = divmod(some - base[of], n[of])
    x, y = x + first[of], y + first[of]
    shared = both[some].astype(np.int64)
    sided = (np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first))[of]
    alike = (x < y) & ((100 + hundredths) * shared >= hundredths * (size[x] + size[y])) & (label[x] != label[y]) & (~sided | (side[x] != side[y]))
    return contracted(label[x[alike]], label[y[alike]])


def _closure(h: np.ndarray, cut: np.ndarray, label: np.ndarray, side: np.ndarray, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between labels, one fewer than it joins, of the sets h[cut[i]:cut[i+1]] of one block with that Jaccard similarity or more.

    With two sides, only sets of different sides are compared. What two sets share is counted over an inverted index: hashes that the
    same sets have are one column of some weight; columns of many sets by a matrix product, those of few pair by pair.
    """
    size, n = np.diff(cut), len(cut) - 1
    names, root = np.unique(label, return_inverse=True)
    none = names[:0], names[:0]
    if len(names) < 2:
        return none
    item, start, count, weight = _columns(h, np.repeat(np.arange(n), size))
    both = np.zeros((n, n), np.float32 if size.max() < 1 << 24 else np.float64)  # whole numbers are exact
    many = count * 10 > n
    for lot in np.array_split(np.flatnonzero(many), -(-int(many.sum()) // 1024)) if many.any() else []:
        x = np.zeros((n, len(lot)), both.dtype)
        x[item[B.spread(start[lot], count[lot])], np.repeat(np.arange(len(lot)), count[lot])] = 1
        both += (x * weight[lot].astype(both.dtype)) @ x.T
    _count(both.reshape(-1), np.arange(n) * n, np.arange(n), item, start[~many], count[~many], weight[~many])
    sided = side.min() != side.max()
    ends = []
    for i in range(0, n, 256):
        shared = both[i : i + 256].astype(np.int64)
        alike = ((100 + hundredths) * shared >= hundredths * (size[i : i + 256, None] + size)) & (root[i : i + 256, None] < root)
        if sided:
            alike &= side[i : i + 256, None] != side
        a, b = np.nonzero(alike)
        if len(a):
            ends.append(contracted(root[a + i], root[b]))
    if not ends:
        return none
    a, b = contracted(*(np.concatenate(x) for x in zip(*ends)))
    return names[a], names[b]


def _close(sets: Sets, hundredths: int):
    """Links between the labels c of each block (key, chunk); rows come sorted by block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.tidy()
        now, held = None, []  # the block that is not known to have ended: labels, sides, hashes and sizes of its sets
        for batch in batches:
            for part, data, at in B.blocks([batch], limit=1 << 19, first=False):
                h, cut = sets(data, at)
                key, chunk, side, c = (B.longs(part.column(x)) for x in ("key", "chunk", "side", "c"))
                begin = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1]))))
                end = np.append(begin[1:], len(key))
                found = []
                # The first block here may go on from before, the last may not end here; of those between, the small ones are closed at once.
                few = np.flatnonzero((end - begin > 1) & (end - begin <= 64))
                few = few[(few > 0) & (few < len(begin) - 1)]
                if len(few):
                    size = (end - begin)[few]
                    row = B.spread(begin[few], size)
                    bytes_ = np.diff(cut)[row]
                    found.append(_small(h[B.spread(cut[row], bytes_)], np.concatenate(([0], np.cumsum(bytes_))), np.repeat(np.arange(len(few)), size), c[row], side[row], hundredths))
                single = np.setdiff1d(np.flatnonzero(end - begin > 64), few)
                for n in sorted({0, len(begin) - 1, *single.tolist()}):
                    i, j = begin[n], end[n]
                    if (key[i], chunk[i]) != now:
                        found.append(_block(held, hundredths))
                        now, held = (key[i], chunk[i]), []
                    held.append((c[i:j], side[i:j], h[cut[i] : cut[j]], np.diff(cut[i : j + 1])))
                held = [tuple(x if x.base is None else x.copy() for x in part_) for part_ in held]
                yield _links(found)
        yield _links([_block(held, hundredths)])

    return of


def _block(held: list, hundredths: int) -> tuple[np.ndarray, np.ndarray]:
    if sum(len(part[0]) for part in held) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, side, h, size = (np.concatenate(x) for x in zip(*held))
    return _closure(h, np.concatenate(([0], np.cumsum(size))), c, side, hundredths)


def _links(found: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64()) for x in (zip(*found) if found else ((), ()))], names=["a", "b"])


def _parts(weight: Column, limit: int) -> Column:
    """So many blocks does a group of that weight take."""
    return F.when(weight <= limit, 1).otherwise(F.ceil(weight * 2 / limit)).cast("int")


def _dealt(groups: DataFrame, heads: DataFrame | None, seed: int) -> DataFrame:
    """Blocks (key, chunk, side, c, id) of the members (key, parts, c, id) of groups, dealt out by chance; heads stand in each."""
    out = groups.select("key", F.pmod(F.xxhash64("id", F.lit(seed)), F.col("parts")).alias("chunk"), F.lit(0).alias("side"), "c", "id")
    if heads is not None:
        out = out.union(heads.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("chunk"), F.lit(0).alias("side"), "c", "id")).distinct()
    return out


def _heads(groups: DataFrame, degrees: DataFrame) -> DataFrame:
    """Of each group with several blocks, the members that share band keys with most others."""
    w = Window.partitionBy("key").orderBy(F.desc("degree"), "id")
    ranked = groups.where("parts > 1").join(degrees, "id").withColumn("r", F.row_number().over(w))
    return ranked.where(F.col("r") <= _HEADS).select("key", "parts", "c", "id")


def _crossing(groups: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """key, cost: so many rows would _crossed() send for a group."""
    per = groups.join(weights, "id").groupBy("key", "c").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    per = per.withColumn("p", F.when(F.col("w") * 2 > limit, F.ceil(F.col("w") * 2 / limit)).otherwise(0))
    all_ = per.groupBy("key").agg((F.sum("p") + F.ceil(F.sum(F.when(F.col("p") == 0, F.col("w")).otherwise(0)) * 4 / limit)).alias("all"))
    return per.join(all_, "key").groupBy("key").agg(F.sum(F.col("n") * (F.col("all") - F.col("p"))).alias("cost"))


def _crossed(groups: DataFrame, weights: DataFrame, limit: int) -> DataFrame:
    """Blocks of all pairs of chunks of a group. A chunk holds a part of one large component, or some small components: those
    chunks are also compared with themselves, while chunks of one component are not compared with each other."""
    sized = settle(groups.join(weights, "id"))
    comps = sized.groupBy("key", "c").agg(F.sum("w").alias("w"))
    own = comps.where(F.col("w") * 2 > limit).select("key", "c", F.ceil(F.col("w") * 2 / limit).alias("p"))
    rest = comps.where(F.col("w") * 2 <= limit).groupBy("key").agg(F.ceil(F.sum("w") * 4 / limit).alias("q"))
    x = sized.join(own, ["key", "c"], "left").join(rest, "key", "left")
    large = F.col("p").isNotNull()
    place = F.when(large, F.pmod(F.xxhash64("id"), F.col("p"))).otherwise(F.pmod(F.xxhash64("c"), F.col("q")))
    x = settle(x.select("key", "id", "c", F.when(large, F.col("c")).alias("of"), F.xxhash64(large, F.when(large, F.col("c")), place).alias("part")))
    parts = x.groupBy("key", "part", "of").agg(F.count("*").alias("n"))
    other = parts.select("key", F.col("part").alias("part2"), F.col("of").alias("of2"))
    pairs = parts.join(other, "key").where("part < part2 and not (of <=> of2 and of is not null) or part = part2 and of is null")
    pairs = pairs.select("key", "part", "part2", F.xxhash64("part", "part2").alias("chunk"))
    sides = pairs.select("key", "chunk", "part", F.lit(0).alias("side")).union(pairs.where("part <> part2").select("key", "chunk", "part2", F.lit(1)))
    return x.join(sides, ["key", "part"]).select("key", "chunk", "side", "c", "id")


def linked(items: DataFrame, found: DataFrame, sets: Sets, hundredths: int, limit: int | None = None, rounds: int = 2) -> DataFrame:
    """id, component of all items with a link inside a band group.

    ``found``: settled stars (key, id, pivot); ``items``: settled (id, text, size in bytes), an id once for each of its texts.
    Clusters that have room in one block are closed at once; the others by pairs of blocks where that is cheap. Else groups of band keys
    follow: each is dealt out anew for ``rounds`` rounds while it is in several components and has several blocks; at last pairs of its
    blocks are compared.
    """
    limit, comps, links = limit or LIMIT, None, None

    def close(blocks: DataFrame) -> None:
        nonlocal comps, links
        rows = blocks.join(texts.select("id", "text"), "id").repartition(partitions(items.sparkSession), "key", "chunk").sortWithinPartitions("key", "chunk")
        more = rows.select("key", "chunk", "side", "c", "id", "text").mapInArrow(_close(sets, hundredths), "a long, b long")
        old, links = links, settle(more if comps is None else more.union(comps.toDF("a", "b")))
        comps = components(links)
        release(old)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.drop("c").join(comps, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")

    def still_open(groups: DataFrame) -> DataFrame:
        groups = labelled(groups)
        keys = groups.groupBy("key").agg(F.min("c").alias("_x"), F.max("c").alias("_y")).where("_x < _y").select("key")
        return settle(groups.join(keys, "key", "left_semi"))

    weights, texts = items.groupBy("id").agg(F.sum(F.col("size") + _EACH).alias("w")), items
    clusters = settle(components(found.select(F.col("id").alias("a"), F.col("pivot").alias("b"))).join(weights, "id"))
    parts = clusters.groupBy("component").agg(_parts(F.sum("w"), limit).alias("parts"))
    members = settle(clusters.join(parts, "component").select(F.col("component").alias("key"), "parts", F.col("id").alias("c"), "id", "w"))
    release(clusters)
    weights, large = members.where("parts > 1").select("id", "w"), members.where("parts > 1").drop("w")
    if not large.limit(1).count():
        close(_dealt(members, None, 0))
        return comps
    held = found.join(large.select("id"), "id", "left_semi")  # the pivot is of the same cluster
    keys = settle(held.select("key", "id").union(held.select("key", "pivot")).distinct())
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    degrees = settle(keys.join(shared, "key").groupBy("id").agg(F.sum("n").alias("degree")))
    close(_dealt(members, _heads(large, degrees), 0))
    texts = settle(items.join(large.select("id"), "id", "left_semi"))  # no others are compared from here on
    open_ = still_open(large)
    whole = settle(_crossing(open_, weights, limit).join(keys.join(large.select("id", "key").withColumnRenamed("key", "cluster"), "id").groupBy("cluster").agg(F.count("*").alias("held")), F.col("key") == F.col("cluster")).where("cost <= held").select("key"))
    if whole.limit(1).count():
        close(_crossed(open_.join(whole, "key", "left_semi").select("key", "c", "id"), weights, limit))
        open_ = open_.join(whole, "key", "left_anti")
    if open_.limit(1).count():
        keys = keys.join(open_.select("id"), "id", "left_semi")
        one = shared.groupBy("n", "x", "y").agg(F.min("key").alias("key"))  # keys of the same items: one is enough
        groups = still_open(keys.join(one, "key", "left_semi"))
        heavy = groups.join(weights, "id").groupBy("key").agg(_parts(F.sum("w"), limit).alias("parts"))
        groups = settle(groups.join(heavy, "key"))
        close(_dealt(groups, _heads(groups, degrees), 1))
        groups = still_open(groups.where("parts > 1"))
        for seed in range(2, rounds + 1):
            if groups.limit(1).count():
                close(_dealt(groups, _heads(groups, degrees), seed))
                groups = still_open(groups)
        if groups.limit(1).count():
            close(_crossed(groups.select("key", "c", "id"), weights, limit))
    return comps
