"""Substring dedup over bytes by suffix sorting, deep-shallow.

A string is ``width`` bytes of one document, taken whole. Its anchor is the first place of the least hash among its grams
of ``GRAM`` bytes. Consecutive strings with one least hash travel as one segment to its bucket, so equal strings meet.
A mapper sends a segment that occurs more than once in its block a single time, already decided. In a bucket:

1. segments alone under their hash, which they have at one place, hold no equal strings and fall out; equal segments are decided;
2. the anchors left are sorted by what follows them and, reversed, by what precedes them: multikey quicksort over
   8-byte symbols to a shallow depth, then blind tries order each remaining group with a long common prefix;
3. two strings with the anchor at one offset o are equal exactly if their anchors share o bytes before and width - o
   after, which the common-prefix lengths of the two orders tell without looking at the bytes again.

Defined results: null or empty text: no bytes. Texts shorter than ``width``: nothing removed. Every place of a string that
also starts anywhere else goes, first places included, in the same document too (overlaps count). Rows repeated with one
doc_id are places of their own. Null doc_id: a row like any other. Other columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._spark import keyed, partitions, small_batches
from .substring import RANGES, SENT, sent, unpack

U = np.uint64
GRAM = 16
SHALLOW = 32
_HEAD = np.dtype([("k", "<i8"), ("th", "<i8"), ("first", "<i4"), ("size", "<i4"), ("least", "<u8"), ("dup", "<i4"), ("many", "<i4")])


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``size`` bytes at each position."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    forward, back = B.powers(B.BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(B.byte_values()[data] * forward[:-1], out=sums[1:])
    return B.mix((sums[size:] - sums[:-size]) * back[:n])


def _send(width: int, buckets: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, at in B.blocks(batches):
            if len(data) < width:
                continue
            hashes = _hashes(data, GRAM)
            least = B.sliding_min(hashes, width - GRAM + 1)
            count = np.maximum(np.diff(at) - width + 1, 0)
            win = B.spread(at[:-1], count)
            if not len(win):
                continue
            row = np.repeat(np.arange(len(count)), count)
            cut = np.flatnonzero(np.concatenate(([True], (win[1:] != win[:-1] + 1) | (row[1:] != row[:-1]) | (least[win[1:]] != least[win[:-1]]))))
            first, last = win[cut], win[np.concatenate((cut[1:], [len(win)])) - 1] + width
            row, size = row[cut], last - first
            forward, back = B.powers(B.BASE, len(data) + 1)
            sums = np.concatenate((np.zeros(1, U), np.cumsum(B.byte_values()[data] * forward[:-1])))
            key = B.mix((sums[last] - sums[first]) * back[first] + size.astype(U))
            head = np.zeros(len(first), _HEAD)
            head["k"], head["th"] = B.longs(batch.column("k"))[row], B.longs(batch.column("th"))[row]
            head["first"], head["size"], head["least"] = first - at[row], size, least[first]
            one, dup = _same(key, B.eights(data), first, size)
            head["dup"], head["many"][one] = dup, _many(hashes, first[one], size[one], least[first[one]])
            bucket = (head["least"] % U(buckets)).astype(np.int64)
            yield sent(bucket[one], head[one], data, first[one], size[one])
            if len(gone := np.flatnonzero(dup)):
                yield sent(-1 - (bucket[gone] % 64), head[gone], data, first[gone], np.zeros(len(gone), np.int64))

    return of


def _many(hashes: np.ndarray, first: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether each segment has its least hash at several places."""
    out, size = np.zeros(len(first), bool), size - GRAM + 1
    part = np.cumsum(size) >> 20
    for i in np.split(np.arange(len(first)), B.run_starts(part)[1:]):
        hit = hashes[B.spread(first[i], size[i])] == np.repeat(least[i], size[i])
        out[i] = np.add.reduceat(hit, np.cumsum(size[i]) - size[i], dtype=np.int64) > 1
    return out


def _same(key: np.ndarray, view: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each string, and for all places whether theirs has others. Equal hashes count where bytes are equal."""
    order = np.argsort(key, kind="stable")
    cut = B.run_starts(key[order])
    lead = np.empty(len(key), np.int64)
    lead[order] = np.repeat(order[cut], np.diff([*cut, len(order)]))
    other = np.flatnonzero(lead != np.arange(len(key)))
    ok = size[other] == size[lead[other]]
    ok[ok] = B.equal(view, start[other[ok]], start[lead[other[ok]]], size[other[ok]])
    lead[other[~ok]] = other[~ok]  # alike by hash alone: left for the sort
    dup = np.bincount(lead, minlength=len(key)) > 1
    return np.flatnonzero(lead == np.arange(len(key))), dup[lead]


def common(view: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, depth: int = 0) -> np.ndarray:
    """How many bytes at a and b are equal, from a depth known to be, at most ``most``."""
    out = most.copy()
    todo = np.flatnonzero(most > depth)
    out[most <= depth] = most[most <= depth]
    while len(todo):
        x = view[a[todo] + depth] ^ view[b[todo] + depth]
        low = x & (~x + U(1))  # the lowest bit that differs
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, U(1)).astype(np.float64)) // 8).astype(np.int64))
        out[todo] = np.minimum(most[todo], depth + same)
        depth += 8
        todo = todo[(x == 0) & (most[todo] > depth)]
    return out


def _blind(parts: list[bytes], depth: int) -> list[int]:
    """The order of strings that share ``depth`` bytes, by a blind trie.

    A node is [length, {byte: child}]; a leaf is a list of indices of equal strings. Insertion walks down by the
    branching bytes alone, compares once with a leaf it arrives at, and splits where the two part.
    """
    root: list | tuple = ("leaf", [0])

    def leaf_of(node) -> int:
        while node[0] != "leaf":
            node = next(iter(node[1].values()))
        return node[1][0]

    for i in range(1, len(parts)):
        s, node = parts[i], root
        while node[0] != "leaf":
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        t = parts[leaf_of(node)]
        n = min(len(s), len(t))
        if s[depth:n] == t[depth:n]:
            same = n
        else:
            x = int.from_bytes(s[depth:n], "little") ^ int.from_bytes(t[depth:n], "little")
            same = depth + ((x & -x).bit_length() - 1) // 8
        if same == len(s) == len(t):
            node[1].append(i)
            continue
        up, node, edge = None, root, None
        while node[0] != "leaf" and node[0] < same:
            edge = s[node[0]] if node[0] < len(s) else -1
            up, node = node, node[1][edge]
        mine = ("leaf", [i])
        if node[0] == same:
            node[1][s[same] if same < len(s) else -1] = mine
            continue
        new = (same, {(s[same] if same < len(s) else -1): mine, (t[same] if same < len(t) else -1): node})
        if up is None:
            root = new
        else:
            up[1][edge] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] == "leaf":
            out += node[1]
        else:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
    return out


def deep_shallow(data: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings (start, size in data) within groups, and the bytes each shares with the one before it (-1 at a group's begin)."""
    big = B.eights(data)
    order = np.argsort(group, kind="stable")
    g = group[order]
    new = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    for depth in range(0, shallow, 8):  # multikey quicksort: the members of an equal part go on to the next symbol
        part = np.cumsum(new) - 1
        many = np.flatnonzero(np.bincount(part)[part] > 1) if len(part) else part
        if not len(many):
            break
        i = order[many]
        left = np.clip(size[i] - depth, 0, 8)
        symbol = big[np.minimum(start[i] + depth, len(data))].astype("<u8").byteswap()
        symbol = np.where(left == 8, symbol, np.where(left == 0, U(0), symbol & ~((U(1) << (U(64) - U(8) * np.maximum(left, 1).astype(U))) - U(1))))
        by = np.lexsort((left, symbol, part[many]))
        order[many] = i[by]
        symbol, left, p = symbol[by], left[by], part[many]
        new[many[1:]] |= (p[1:] == p[:-1]) & ((symbol[1:] != symbol[:-1]) | (left[1:] != left[:-1]))
    part = np.cumsum(new) - 1
    sizes = np.bincount(part) if len(part) else part
    ends = np.cumsum(sizes)
    raw = data.tobytes() if len(sizes) and sizes.max() > 1 else b""
    for p in np.flatnonzero(sizes > 1):
        a = ends[p] - sizes[p]
        i = order[a : ends[p]]
        if size[i[0]] <= shallow and (size[i] <= shallow).all():
            continue
        order[a : ends[p]] = i[_blind([raw[s : s + n] for s, n in zip(start[i].tolist(), size[i].tolist())], min(shallow, int(size[i].min())))]
    a, b = order[:-1], order[1:]
    lcp = np.full(len(order), -1, np.int64)
    lcp[1:] = np.where(group[a] == group[b], common(big, start[a], start[b], np.minimum(size[a], size[b])), -1)
    return order, lcp


class _Least:
    """Least value of any stretch of an array, by a sparse table."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while 2 ** len(self.rows) <= len(x):
            h = 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-h], self.rows[-1][h:]))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(x[a + 1 : b + 1]), where a < b."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for j in np.unique(level):
            i = np.flatnonzero(level == j)
            out[i] = np.minimum(self.rows[j][a[i] + 1], self.rows[j][b[i] + 1 - 2**j])
        return out


def _anchored(data: np.ndarray, at: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Segment, place, and least and largest offset in its strings of each anchor."""
    seg = np.repeat(np.arange(len(least)), np.diff(at))
    h = _hashes(data, GRAM)
    n = len(h)
    place = np.flatnonzero((h == least[seg[:n]]) & (np.arange(n) + GRAM <= at[seg[:n] + 1]))
    seg = seg[place]
    before = np.concatenate(([-1], place[:-1]))
    before[np.concatenate(([True], seg[1:] != seg[:-1]))] = -1
    high = np.minimum(place - np.maximum(before + 1, at[seg]), width - GRAM)  # strings that begin after the anchor before
    low = np.maximum(place + width - at[seg + 1], 0)
    ok = low <= high
    return seg[ok], place[ok], low[ok], high[ok]


def _sort(width: int):
    def of(table: pa.Table) -> pa.Table:
        head, data = unpack(table.column("data").to_pylist(), _HEAD)
        if table.column("bucket")[0].as_py() < 0:
            return pa.table([head["k"], head["th"], head["first"].astype(np.int64), head["first"].astype(np.int64) + head["size"]], schema=RANGES)
        size = head["size"].astype(np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        forward, back = B.powers(B.BASE, len(data) + 1)
        sums = np.concatenate((np.zeros(1, U), np.cumsum(B.byte_values()[data] * forward[:-1])))
        one, dup = _same(B.mix((sums[at[1:]] - sums[at[:-1]]) * back[at[:-1]] + size.astype(U)), B.eights(data), at[:-1], size)
        whole = np.flatnonzero(dup & (head["dup"] == 0))
        out = [(whole, np.zeros(len(whole), np.int64), size[whole])]
        _, group, members = np.unique(head["least"][one], return_inverse=True, return_counts=True)
        one = one[(members[group] > 1) | (head["many"][one] > 0)]  # else alone under its hash: no equal anywhere
        if len(one):
            sub = data[B.spread(at[:-1][one], size[one])]
            at1 = np.concatenate(([0], np.cumsum(size[one])))
            seg, place, low, high = _anchored(sub, at1, head["least"][one], width)
            _, group = np.unique(head["least"][one][seg], return_inverse=True)
            order, lcp = deep_shallow(sub, place, width - low, group)
            right = np.empty(len(order), np.int64)
            right[order] = np.arange(len(order))
            back_order, back_lcp = deep_shallow(sub[::-1].copy(), len(sub) - place, high, group)
            left = np.empty(len(order), np.int64)
            left[back_order] = np.arange(len(order))
            item = np.repeat(np.arange(len(seg)), high - low + 1)
            o = B.spread(low, high - low + 1)
            by = np.lexsort((left[item], o, group[item]))
            item, o = item[by], o[by]
            new = np.ones(len(item), bool)
            i = np.flatnonzero((group[item[1:]] == group[item[:-1]]) & (o[1:] == o[:-1])) + 1
            new[i] = _Least(back_lcp).of(left[item[i - 1]], left[item[i]]) < o[i]
            kind = np.cumsum(new)
            by = np.lexsort((right[item], kind))
            item, o, kind = item[by], o[by], kind[by]
            i = np.flatnonzero(kind[1:] == kind[:-1]) + 1
            i = i[_Least(lcp).of(right[item[i - 1]], right[item[i]]) >= width - o[i]]
            hit = np.zeros(len(item), bool)
            hit[i] = hit[i - 1] = True
            hit &= ~(dup | (head["dup"] > 0))[one[seg[item]]]
            item, o = item[hit], o[hit]
            start = place[item] - o - at1[seg[item]]
            out.append((one[seg[item]], start, start + width))
        row, start, end = (np.concatenate(x) for x in zip(*out))
        row, start, end = B.merged(row, start, end)
        first = head["first"][row].astype(np.int64)
        return pa.table([head["k"][row], head["th"][row], start + first, end + first], schema=RANGES)

    return of


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            text = (text.as_py() or "").encode()
            kept, at, found = [], 0, []
            for s, e in sorted((s["start"], s["end"]) for s in spans.as_py() or ()):
                if found and s <= found[-1][1]:
                    found[-1][1] = max(e, found[-1][1])
                else:
                    found.append([s, e])
            for s, e in found:
                kept.append(text[at:s])
                at = e
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in found]))
        cols = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup_bytes(docs: DataFrame, width: int = 400, buckets: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed bytes), a row for each row of ``docs``. ``width``: 16 or more."""
    spark = docs.sparkSession
    small_batches(spark)
    # A row of its own for each copy: strings of repeated rows are at two places.
    docs = keyed(docs)
    sent_ = docs.select("k", "th", "text").mapInArrow(_send(width, buckets or 16 * partitions(spark)), SENT)
    found = sent_.groupBy("bucket").applyInArrow(_sort(width), "k long, th long, start long, end long")
    spans = found.groupBy("k", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return docs.join(spans, ["k", "th"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
