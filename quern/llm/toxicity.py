"""Toxicity by compression distance: windows' lengths under a zstandard dictionary trained on toxic text and one on ordinary text.

A window is a word (letters, lower-cased; of a run longer than ``WORD`` bytes, as scripts without blanks have, each ``WORD`` bytes,
``STEP`` apart, the last ones at its end) in a fixed frame that both dictionaries know, so that lengths differ by the word alone.
The toxic dictionary is trained on words that toxic documents have far more often than ordinary ones (by themselves or by
their first letters), the ordinary one on words of ordinary documents; each on windows drawn from half of the sample, at most
``toxic_windows`` and ``ordinary_windows`` of them. A document's features are the shares of
its words whose two lengths differ by at least each of nine thresholds; logistic regression calibrates these on a bounded
sample of labelled documents, at most about ``most`` of each label. Words are compressed once a block, and kept by hash in a
table of fixed size; texts are taken whole.

Defined results: null text or text without words: the score of no shares. No training document of either label: score 0.5 * the
share of toxic ones, that is 0 if none. Null doc_id: held out. Null labels: not trained on. Different labels of one doc_id:
each trains; a label repeated counts once. Repeated rows: each is a row. Other columns: ignored.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._spark import settle, small_batches
from .learn import fold, made, sample

U = np.uint64
FRAME = b"|0123456789#ABCDEFGHIJKLMNOPQRSTUVWXYZ#9876543210| "
#: All bytes but letters and those of characters beyond ASCII.
APART = bytes(b for b in range(128) if not chr(b).isalpha())
LOW, HIGH = -4, 8
KEPT = 1 << 20  #: words whose lengths a task keeps
TOXIC_SIZE, ORDINARY_SIZE, WORD, STEP = 32 << 10, 112 << 10, 64, 32


def _window(word: bytes) -> bytes:
    return FRAME + word + b" "


def compressors(dictionaries: list[bytes]) -> list[zstandard.ZstdCompressor]:
    out = []
    for d in dictionaries:
        d = zstandard.ZstdCompressionDict(d)
        p = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=15, search_log=5, min_match=3, target_length=64, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False, write_checksum=False)
        d.precompute_compress(compression_params=p)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
    return out


def _lengths(words: list[bytes], toxic: zstandard.ZstdCompressor, ordinary: zstandard.ZstdCompressor) -> np.ndarray:
    """How much shorter each word is under the toxic dictionary."""
    return np.clip(np.array([len(ordinary.compress(x)) - len(toxic.compress(x)) for x in map(_window, words)], np.int64), LOW, HIGH)


def shares(d: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Features of each text from its words' differences: log shares at or above HIGH, HIGH - 1, ..."""
    n = len(cut) - 1
    kinds = HIGH - LOW + 1
    h = np.bincount(np.repeat(np.arange(n), np.diff(cut)) * kinds + d - LOW, minlength=n * kinds).reshape(n, kinds)
    return np.log1p(200 * h[:, ::-1].cumsum(1)[:, :9] / np.maximum(np.diff(cut), 1)[:, None])


def _contrast(a: Counter, b: Counter, na: int, nb: int, x: bytes) -> float:
    m, n = a[x], b[x]
    if m + n <= 3:
        return 0.0
    return math.log((m + 0.5) * (nb + 1) / ((n + 0.5) * (na + 1))) / math.sqrt(1 / (m + 0.5) + 1 / (n + 0.5))


def _parts(words: set[bytes]) -> set[bytes]:
    return words | {b"^" + w[:k] for w in words for k in (4, 5, 6) if len(w) >= k}


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights of columns, bias last, by Newton's method."""
    x = np.concatenate((x, np.ones((len(x), 1))), 1)
    w, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, l2), 1e-9)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(keep + 1e-9), g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _words(data: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes; first and past-the-end byte and hash of each word or window of a longer one; each row's first, with the end."""
    w, raw = B.Words(data, at, APART, lower=True), data.tobytes().lower()
    start, end, hash_ = w.start, w.end, w.hash
    count = 1 + np.maximum(end - start - WORD + STEP - 1, 0) // STEP
    long = count > 1
    if not long.any():
        return raw, start, end, hash_, w.first
    upto = np.concatenate(([0], np.cumsum(count)))
    number = np.arange(upto[-1]) - np.repeat(upto[:-1], count)
    start, end, hash_, long = (np.repeat(x, count) for x in (start, end, hash_, long))
    start = np.where(long, np.minimum(start + number * STEP, end - WORD), start)
    end = np.where(long, start + WORD, end)
    forward, back = B.powers(B.BASE, len(data) + 1)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(B.byte_values(APART, True)[data] * forward[:-1], dtype=U)))
    hash_[long] = B.mix((sums[end[long]] - sums[start[long]]) * back[start[long]])
    return raw, start, end, hash_, upto[w.first]


def _train(toxic_windows: int, ordinary_windows: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, y = [], []
        for batch, data, at in B.blocks(batches):
            raw, start, end, _, first = _words(data, at)
            words = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
            docs += [words[a:b] for a, b in zip(first, first[1:])]
            y += batch.column("toxic").to_pylist()
        y = np.array(y, np.int64)
        sure = y.mean() if len(y) else 0.0
        model = None
        if 0 < sure < 1:
            order = np.random.default_rng(0).permutation(len(y))
            # Dictionaries come from one half, thresholds from the other: words by heart would look too certain.
            half = order[: len(order) // 2]
            counts = [Counter(), Counter()]
            for i in half:
                counts[y[i]].update(_parts(set(docs[i])))
            n = [int((y[half] == c).sum()) for c in (0, 1)]
            score: dict[bytes, float] = {}
            for x in {x for i in half if y[i] for x in docs[i]}:
                score[x] = max([_contrast(counts[1], counts[0], n[1], n[0], p) for p in _parts({x})])
            toxic = [x for i in half if y[i] for x in sorted(set(docs[i])) if score[x] >= 3 and counts[0][x] <= 0.002 * n[0]]
            ordinary = [x for i in half if not y[i] for x in docs[i]]
            pick = np.random.default_rng(1)
            parts = [[_window(x[j]) for j in pick.permutation(len(x))[:most]] for x, most in ((toxic, toxic_windows), (ordinary, ordinary_windows))]
            try:
                dictionaries = [zstandard.train_dictionary(size, x).as_bytes() for size, x in zip((TOXIC_SIZE, ORDINARY_SIZE), parts)]
            except zstandard.ZstdError:  # too little text to train on
                dictionaries = []
            if dictionaries:
                both = compressors(dictionaries)
                rest = order[len(order) // 2 :]
                known: dict[bytes, int] = {}
                new = sorted({x for i in rest for x in docs[i]})
                known = dict(zip(new, _lengths(new, *both).tolist()))
                d = np.array([known[x] for i in rest for x in docs[i]], np.int64)
                f = shares(d, np.concatenate(([0], np.cumsum([len(docs[i]) for i in rest]))))
                model = dictionaries, logistic(f, y[rest])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model, float(sure)))], pa.binary())], names=["model"])

    return of


def _score(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sure = pickle.loads(shared.value) if shared.value else (None, 0.0)
        if model:
            both, weights = compressors(model[0]), model[1]
            keys, values = np.zeros(KEPT, U), np.zeros(KEPT, np.int8)
        for batch, data, at in B.blocks(batches):
            score = np.full(len(batch), 0.5 * sure)
            if model:
                raw, start, end, hash_, begin = _words(data, at)
                one, first, back = np.unique(hash_, return_index=True, return_inverse=True)
                place = (one & U(KEPT - 1)).astype(np.int64)
                d = values[place].astype(np.int64)
                new = np.flatnonzero(keys[place] != one)
                if len(new):
                    at_ = first[new]
                    d[new] = _lengths([raw[s:e] for s, e in zip(start[at_].tolist(), end[at_].tolist())], *both)
                    keys[place[new]], values[place[new]] = one[new], d[new]
                f = shares(d[back], begin)
                score = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(score)], names=[*(c for c in batch.schema.names if c != "text"), "score"])

    return of


def fit(docs: DataFrame, labels: DataFrame, most: int = 2500, toxic_windows: int = 30_000, ordinary_windows: int = 100_000) -> bytes | None:
    """A model from documents of the training fold with a label: at most about ``most`` ordinary and as many toxic ones, and
    dictionaries from at most ``toxic_windows`` and ``ordinary_windows`` windows of half of these.

    Labels are sampled before they meet documents, so that what is broadcast has that bound and no text is dealt out.
    """
    small_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", 5) != 0)).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    few = settle(sample(marked, "toxic", most, by=("doc_id",)))
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic")
    return made(rows, _train(toxic_windows, ordinary_windows))


def score(docs: DataFrame, model: bytes | None) -> DataFrame:
    """doc_id, held_out, score, predicted, a row for each row of ``docs``. Only text is looked at."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, most: int = 2500, toxic_windows: int = 30_000, ordinary_windows: int = 100_000) -> DataFrame:
    return score(docs, fit(docs, labels, most, toxic_windows, ordinary_windows))
