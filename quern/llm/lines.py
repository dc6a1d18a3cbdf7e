"""Line dedup, fuzzy, by MinHash of character shingles.

A line is what stands between line feeds. Lines with no sign but white space are never removed. A line's set is its distinct
shingles of ``SHINGLE`` characters (fewer characters: the whole line). Signatures of 96 values in 16 bands of 6 rows find
candidates: pairs of similarity 0.8 with probability 0.992, of 0.85 with 0.9995, of 0.9 with 1 - 5e-6. Lines of up to
``LONG`` distinct shingles take minimum and maximum of 48 permutations; longer ones one permutation in 96 bins, where empty bins
borrow from the next; lines of sizes that may pair across this border have both kinds of bands. Candidates are confirmed by
exact Jaccard similarity on whole lines; distributed union-find makes components. Of each component, equal lines included,
the line that comes first by (doc_id, line number) stays.

Defined results: null text: no lines, null kept text. Empty text: one blank line, kept. Null doc_id: after all others. Rows
repeated with one doc_id and text: the first occurrence is kept in each of them. Other columns: ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._spark import keyed, settle, small_batches
from .banding import linked, stars
from .neardup import band_keys, min_max, unique_by_row

U = np.uint64
SHINGLE, VALUES, ROWS, LONG = 5, 96, 6, 128
SHORT, CELL_BITS = LONG * 5 // 4, 10
CELLS = 1 << CELL_BITS


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, first and past-the-end byte of each line of each row."""
    feeds = np.flatnonzero(data == 0x0A)
    row = np.searchsorted(at, feeds, "right") - 1
    rows = np.arange(len(at) - 1)
    start, end = np.concatenate((at[:-1], feeds + 1)), np.concatenate((at[1:], feeds))
    row_s, row_e = np.concatenate((rows, row)), np.concatenate((rows, row))
    start = start[np.lexsort((start, row_s))]
    by = np.lexsort((end, row_e))
    row, end = row_e[by], end[by]
    first = np.searchsorted(row, rows)
    return row, np.arange(len(row)) - first[row], start, end


def _ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of each line, as two longs; blank lines have none (0, 0)."""
    raw, none, of = data.tobytes(), bytes(16), hashlib.blake2b
    ids = [of(x, digest_size=16).digest() if x and not x.isspace() else none for x in map(raw.__getitem__, map(slice, start.tolist(), end.tolist()))]
    return np.frombuffer(b"".join(ids), np.int64).reshape(-1, 2)


def char_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the character shingles of each text."""
    row, h = _shingles(data, at)
    return unique_by_row(row, h, len(at) - 1)


_BYTES = (np.uint64(1) << (np.uint64(8) * np.arange(5, dtype=U))) - U(1)  #: masks of 0 to 4 bytes


def _shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each character shingle, by row."""
    if not len(data) or data.max() < 0x80:
        chars, first = (data.astype(U) + U(1)) * U(B.BASE), at
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        chars, first = data[lead].astype(U), np.searchsorted(lead, at)
        wide = np.flatnonzero(chars >= U(0xC0))
        size = np.minimum(np.append(lead, len(data))[wide + 1] - lead[wide], 4)
        chars[wide] = B.eights(data)[lead[wide]] & _BYTES[size]
        chars += U(1)
        chars *= U(B.BASE)
    n = np.diff(first)
    h = B.grams(chars, SHINGLE)
    ok = np.ones(len(h), bool)
    for k in range(1, SHINGLE):  # those that begin less than SHINGLE characters before a text's end go beyond it
        beyond = first[1:] - k
        ok[beyond[(beyond >= 0) & (beyond < len(h))]] = False
    h, row_h = h[ok], np.repeat(np.arange(len(n)), np.maximum(n - SHINGLE + 1, 0))
    parts, rows = [h], [row_h]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(n == k)
        if len(few):
            parts.append(B.mix(B.grams(chars, k)[first[few]] + U(k)))
            rows.append(few)
    if len(parts) == 1:
        return row_h, h
    row, h = np.concatenate(rows), np.concatenate(parts)
    by = np.argsort(row, kind="stable")
    return row[by], h[by]


def _bins(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One-permutation signatures: the least hash of each bin, or of the next that has any."""
    none = U(2**64 - 1)
    out = np.full((rows, VALUES), none, U)
    np.minimum.at(out.reshape(-1), row * VALUES + (((h >> U(32)) * U(VALUES)) >> U(32)).astype(np.int64), h)
    i, j = np.nonzero(out == none)
    while len(i):  # only what is still empty is looked at again
        got = out[i, (j + 1) % VALUES]
        full = got != none
        if not full.any():
            break
        out[i[full], j[full]] = got[full] + U(B.GRAM)
        i, j = i[~full], j[~full]
    return out


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and id of each line that is not blank; ``lead``: the first of its kind in its row."""
    for batch, data, at in B.blocks(batches, limit=1 << 20):
        row, number, start, end = _lines(data, at)
        ids = _ids(data, start, end)
        some = (ids != 0).any(1)
        row, number, ids = row[some], number[some], ids[some]
        order = np.lexsort((number, ids[:, 1], ids[:, 0], row))
        lead = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        lead[a] = (row[a] != row[b]) | (ids[a] != ids[b]).any(1)
        yield pa.RecordBatch.from_arrays([pa.array(B.longs(batch.column(c))[row]) for c in ("k", "th")] + [pa.array(x.astype(np.int64)) for x in (number, ids[:, 0], ids[:, 1])] + [pa.array(lead)], names=["k", "th", "line", "id", "id2", "lead"])


def _sizes(row: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many distinct shingles each line has, as far as it counts: exact up to SHORT, above that a number above it.

    A line of fewer shingles than LONG has no more distinct ones. Of the others, those whose hashes fall to more cells than a short
    line may have shingles are long; what is still open is counted.
    """
    size, many = n.copy(), np.flatnonzero(n >= LONG)
    if not len(many):
        return size
    low = many[0]
    begin = np.searchsorted(row, low)
    cell = row[begin:] - low
    cell <<= CELL_BITS
    cell += (h[begin:] >> U(64 - CELL_BITS)).view(np.int64)
    cells = np.zeros((len(n) - low) * CELLS, np.uint8)
    cells[cell] = 1
    eight = np.add.reduce(cells.view(U).reshape(-1, CELLS // 8), 1)  # sums of each eighth byte, CELLS / 8 at most
    size[many] = eight.view(np.uint8).reshape(-1, 8).sum(1, dtype=np.int64)[many - low]
    many = many[size[many] <= SHORT]
    if len(many):
        place = np.full(len(n), -1)
        place[many] = np.arange(len(many))
        inside = place[row] >= 0
        size[many] = np.diff(unique_by_row(place[row[inside]], h[inside], len(many))[1])
    return size


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, at in B.blocks(batches, limit=1 << 18):
        _, _, start, end = _lines(data, at)
        ids = _ids(data, start, end)[:, 0]
        ids, one = np.unique(ids, return_index=True)
        one, ids = one[ids != 0], ids[ids != 0]
        order = np.argsort(end[one] - start[one], kind="stable")  # by length: lines of one kind mostly follow each other
        one, ids = one[order], ids[order]
        size = end[one] - start[one]
        text, where = data[B.spread(start[one], size)], np.concatenate(([0], np.cumsum(size)))
        row, h = _shingles(text, where)
        n = np.bincount(row, minlength=len(one))
        first = np.concatenate(([0], np.cumsum(n)))
        size = _sizes(row, h, n)
        kinds = np.stack((size <= SHORT, size >= LONG), 1)
        place = np.cumsum(kinds).reshape(-1, 2) - 1  # of each line's keys of each kind
        bands = np.empty((np.count_nonzero(kinds), VALUES // ROWS), U)
        for kind, take in enumerate(kinds.T):
            which = np.flatnonzero(take)
            if not len(which):
                continue
            low, high = which[0], which[-1] + 1
            if 4 * len(which) >= 3 * (high - low):  # a few others between them are no matter
                mine, rows, count = h[first[low] : first[high]], row[first[low] : first[high]] - low, n[low:high]
            else:
                inside = take[row]
                mine, rows, count = h[inside], (np.cumsum(take) - 1)[row[inside]], n[which]
            values = _bins(mine, rows, len(count)) if kind else min_max(mine, np.concatenate(([0], np.cumsum(count))), VALUES // 2)
            if len(count) > len(which):
                values = values[which - low]
            bands[place[which, kind]] = band_keys(values, ROWS, 1000 * kind)
        cut = np.concatenate(([0], (place[:, 1] + 1) * (8 * bands.shape[1]))).astype(np.int32)
        keys = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(bands.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(ids), keys], names=["id", "bands"])


def _of_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines whose ids each row lists, with their texts."""
    for batch in batches:
        ids, texts = [], []
        for text, want in zip(batch.column("text"), batch.column("want")):
            text, want = text.as_buffer().to_pybytes().split(b"\n"), want.as_py()
            for w in want:
                ids.append(w["id"])
                texts.append(text[w["line"]])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


def _cut(keep_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                text, gone = text.as_buffer().to_pybytes() if text.is_valid else None, set(gone.as_py() or ())
                n_lines = 0 if text is None else text.count(b"\n") + 1
                kept = text if not gone else b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone)
                rows.append((n_lines, len(gone), hashlib.sha256(kept or b"").hexdigest(), kept if keep_text else None))
            n_lines, n_removed, sha, kept = zip(*rows) if rows else [()] * 4
            own = batch.schema.names[:-1] if keep_text else batch.schema.names[:-2]  # without gone, and the text
            cols = [*(batch.column(c) for c in own), *(pa.array(c, pa.int64()) for c in (n_lines, n_removed)), *([pa.array(kept, pa.string())] if keep_text else []), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*own, "n_lines", "n_removed", *(["kept"] if keep_text else []), "kept_sha256"])

    return of


def repeated_lines(docs: DataFrame, hundredths: int = 80) -> DataFrame:
    """k, th, line of each line that is not the first of its component. ``docs``: as keyed() gives them."""
    small_batches(docs.sparkSession)
    texts = docs.select("k", "th", "text").where("text is not null")
    places = settle(texts.mapInArrow(_occurrences, "k long, th long, line long, id long, id2 long, lead boolean"))
    if getattr(docs, "_repeated", True):
        least = F.min(F.struct("k", "th", "line"))
    else:  # of numbers alone, which needs no sort: a row is known by its k, and in it the line by its lead
        least = F.struct(F.min("k").alias("k"), F.lit(0).cast("long").alias("th"), F.min_by("line", F.when(F.col("lead"), F.col("k"))).alias("line"))
    classes = places.groupBy("id", "id2").agg(least.alias("first"), F.count("*").alias("n"))
    classes = settle(classes)
    found = settle(stars(texts.mapInArrow(_sign, "id long, bands binary")))
    need = found.select("id").union(found.select("pivot")).distinct()
    needed = settle(classes.join(need.hint("shuffle_hash"), "id"))
    want = needed.select("id", "first.*").groupBy("k", "th").agg(F.collect_set(F.struct("id", "line")).alias("want"))
    items = settle(texts.join(want.hint("shuffle_hash"), ["k", "th"]).select("text", "want").mapInArrow(_of_id, "id long, text string").withColumn("size", F.octet_length("text")))
    near = settle(needed.join(linked(items, found, char_sets, hundredths), "id"))
    least = near.groupBy("component").agg(F.min("first").alias("least"))
    # Only lines with an equal or a near one can go. One without an equal one is in its class's place; the others are looked up.
    stay = near.join(least, "component").select("id", "id2", "first", "n", F.col("least").alias("stay"))
    several = classes.where("n > 1")
    equal = several.join(near.where("n > 1").select("id", "id2"), ["id", "id2"], "left_anti").select("id", "id2", F.col("first").alias("stay"))
    equal = equal.union(stay.where("n > 1").select("id", "id2", "stay"))
    gone = places.join(equal.hint("shuffle_hash"), ["id", "id2"]).where(F.struct("k", "th", "line") != F.col("stay")).select("k", "th", "line")
    return gone.union(stay.where("n = 1 and first <> stay").select("first.*"))


def dedup_lines(docs: DataFrame, hundredths: int = 80, keep_text: bool = True) -> DataFrame:
    """The columns of ``docs`` (doc_id, text and any others but k, th, gone), and n_lines, n_removed, kept (text), kept_sha256.

    Not ``keep_text``: without text and kept.
    """
    own = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = keyed(docs, *[F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(own)])
    gone = repeated_lines(rows, hundredths).groupBy("k", "th").agg(F.collect_set("line").alias("gone"))
    rows = rows.join(gone.hint("shuffle_hash"), ["k", "th"], "left").select("doc_id", *[f"_own{i}" for i in range(len(own))], "text", "gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: -1 if keep_text else -2])
    out = rows.mapInArrow(_cut(keep_text), f"{schema}, n_lines long, n_removed long, {'kept string, ' if keep_text else ''}kept_sha256 string")
    taken = {"n_lines", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])}
    return out.select("doc_id", *(["text"] if keep_text else []), *[F.col(f"_own{i}").alias(c) for i, c in enumerate(own) if c not in taken], *sorted(taken))
