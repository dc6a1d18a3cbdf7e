"""Best-fit packing of token sequences by large-item matching.

Tokens are byte-level BPE ids, id 2 after each document. Longer documents are cut so that only the first piece is shorter than
``size``. Full pieces are sequences of their own. Of the others only the histogram of lengths, at most ``size`` numbers, goes to
the driver: lengths above a third pair at most twice a bin, the longest first, each with the longest partner that fits; shorter
ones, the longest first, go where the least room is left over. What comes back is a table of bin kinds, broadcast (its rows are
bounded by the histogram's steps, not by the data); pieces find their place there by their rank among pieces of their length: the
task that makes them counts those of each length, and a small table of its counts gives each task's base.

Defined results: null or empty text: the one token 2. Rows repeated: packed each. Null doc_id: null. Empty table: no rows.
Other columns: ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import _bytes as B
from ._spark import settle, small_batches

END = 2
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: Beyond these, ranks and tokenizer may cut white space differently: such texts take the slow way.
_PLAIN = frozenset([*range(0x20, 0x7F), 0x0A, *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x370, 0x530)]) - {0xAD}


def _encoders(json: str, ranks: str | None):
    """Ids of a list of texts. The rank file holds the tokenizer's own vocabulary, and its library is several times faster."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if ranks is None:
        slow = Tokenizer.from_file(json)
        return lambda texts: [x.ids for x in slow.encode_batch(texts, add_special_tokens=False)]
    import base64

    import regex
    import tiktoken
    from public_tokenizers import PATTERN

    with open(ranks, "rb") as lines:
        fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    odd = regex.compile("<\\||[^" + "".join(f"\\u{c:04x}" for c in sorted(_PLAIN)) + "]")
    slow = lambda: B.kept(f"encoders of {json}", lambda: Tokenizer.from_file(json))  # noqa: E731  for the few texts that need it
    return lambda texts: [slow().encode(t, add_special_tokens=False).ids if odd.search(t) else fast.encode_ordinary(t) for t in texts]


def _pieces(json: str, ranks: str | None, size: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        B.tidy("encoders")
        encode = B.kept(f"encoders {json} {ranks}", lambda: _encoders(json, ranks))
        seen = [0] * (size + 1)  # pieces of each length so far, in this task
        for whole in batches:
            for batch, _, _ in B.blocks([whole], first=False):
                rows = []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                one = list(dict.fromkeys(texts))
                ids_of = dict(zip(one, map(lambda ids: np.array([*ids, END], "<u4"), encode(one))))
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                    ids = ids_of[text]
                    cut = [0, *range(len(ids) % size or size, len(ids) + 1, size)]
                    for i, (a, b) in enumerate(zip(cut, cut[1:])):
                        rows.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes()), seen[b - a]))
                        seen[b - a] += 1
                cols = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*_COLUMNS, "local"])

    return of


def bins(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of bins (lengths in order) and how many of each, for counts of lengths of 1 to size."""
    large = {n: c for n, c in counts.items() if 3 * n > size and c}
    made: list[tuple[tuple[int, ...], int]] = []
    while large:
        a = max(large)
        b = max((n for n in large if n <= size - a and (n != a or large[a] > 1)), default=None)
        if b is None:
            made.append(((a,), large.pop(a)))
            continue
        n = large[a] // 2 if a == b else min(large[a], large[b])
        made.append(((a, b), n))
        for x in (a, b):
            large[x] -= n
            if not large[x]:
                del large[x]
    room: dict[int, list] = defaultdict(list)
    for kind, n in made:
        room[size - sum(kind)].append((kind, n))
    for x in sorted((n for n, c in counts.items() if 3 * n <= size and c), reverse=True):
        left = counts[x]
        while left:
            gap = min((g for g, kinds in room.items() if g >= x and kinds), default=None)
            if gap is None:  # new bins, each as full of this length as it gets
                each = min(size // x, left)
                n = left // each
                room[size - each * x].append(((x,) * each, n))
                left -= each * n
                continue
            kind, n = room[gap].pop()
            each = min(gap // x, left)
            take = min(n, left // each)
            if take < n:
                room[gap].append((kind, n - take))
            room[gap - each * x].append(((*kind, *(x,) * each), take))
            left -= take * each
    return [k for kinds in room.values() for k in kinds if k[1]]


def _places(made: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first bin and offset of each stretch of its pieces."""
    out: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for kind, n in made:
        at = 0
        for x in kind:
            out[x].append((used[x], base, at))
            used[x] += n
            at += x
        base += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in out.items()}


def _place(places):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (B.longs(batch.column(c)) for c in ("length", "rank"))
            seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                i = np.flatnonzero(length == x)
                first, base, at = places.value[int(x)]
                j = np.searchsorted(first, rank[i], "right") - 1
                seq[i], offset[i] = base[j] + rank[i] - first[j], at[j]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "rank"), pa.array(seq), pa.array(offset)], names=[*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])

    return of


def _counted(docs: DataFrame, json: str, ranks: str | None, size: int) -> DataFrame:
    """The columns of pieces(), and ``local``: how many pieces of its length stand before it in its task."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_pieces(json, ranks, size), SCHEMA + ", local long")


def pieces(docs: DataFrame, json: str, ranks: str | None = None, size: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each row of ``docs``."""
    return _counted(docs, json, ranks, size).select(*_COLUMNS)


def pack(docs: DataFrame, json: str, ranks: str | None = None, size: int = 1024) -> DataFrame:
    """The pieces of ``docs`` with sequence_id and offset. ``json``: a tokenizer's file; ``ranks``: its vocabulary as ranks, for speed."""
    rows = settle(_counted(docs, json, ranks, size).withColumn("part", F.spark_partition_id()))
    parts = settle(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    rows = rows.join(base, ["part", "length"]).select(*_COLUMNS, (F.col("local") + F.col("base")).alias("rank"))
    places = _places(bins(counts, size))
    return rows.mapInArrow(_place(docs.sparkSession.sparkContext.broadcast(places)), SCHEMA + ", sequence_id long, offset long")
