"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased and all but letters becomes one kind of blank. Grams of 1 to 3 characters are hashed into ``FEATURES``
numbers; term frequencies are shares of a text's grams, document frequencies are counted over all training documents. Weights
are sparse: follow-the-regularised-leader with elastic-net penalties, on a sample of at most about ``most`` documents of each
language. A temperature fitted on a fifth of the sample that was not trained on calibrates the probabilities.

Defined results: null text or no letter: ``und`` and score 0. No training document: all ``und``. Null doc_id: held out. Null
lang: not trained on. Repeated rows: each is a row (and trains as often). Other columns: ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _bytes as B
from ._spark import small_batches
from .learn import fold, made, sample

U = np.uint64
ORDERS, FEATURES = (1, 2, 3), 1 << 15
BLANK = 0x20


def _letters() -> np.ndarray:
    """For each character its lower case, or the blank where it is no letter."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            table[c] = ord(y) if len(y) == 1 else c
    return table


def features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: features of all grams, where each text's begin (with the end); and whether texts have letters."""
    chars = B.kept("letters", _letters)[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    first = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    some = np.concatenate(([0], np.cumsum(chars != BLANK)))
    some = some[first[1:]] > some[first[:-1]]
    n = np.diff(first)
    code = chars.astype(U) + U(1)
    x = code
    for k in ORDERS:
        if k > 1:
            x = x[:-1] * U(1 << 21) + code[k - 1 :]
        h = ((x * U(B.BASE + 2 * k)) >> U(64 - 15)).astype(np.int32) if len(x) else np.zeros(0, np.int32)
        count = np.maximum(n - k + 1, 0)
        yield h[B.spread(first[:-1], count)], np.concatenate(([0], np.cumsum(count))), some


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch, data, at in B.blocks(batches, limit=1 << 18):
        flags = np.zeros((len(batch), FEATURES), bool)
        for h, cut, _ in features(data, at):
            flags.reshape(-1)[np.repeat(np.arange(len(batch)) * FEATURES, np.diff(cut)) + h] = True
        df += flags.sum(0)
        n += len(batch)
    parts = df.reshape(32, -1)
    yield pa.RecordBatch.from_arrays([pa.array(range(32), pa.int32()), pa.array([n] * 32, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "n", "df"])


def _sum(table: pa.Table) -> pa.Table:
    df = sum(np.frombuffer(x, np.int64) for x in table.column("df").to_pylist())
    return pa.table([pa.array([table.column("part")[0].as_py()], pa.int32()), pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([df.tobytes()], pa.binary())], names=["part", "n", "df"])


def idf(rows: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows; 32 rows of counts come to the driver."""
    got = rows.select("text").mapInArrow(_frequencies, "part int, n long, df binary").groupBy("part").applyInArrow(_sum, "part int, n long, df binary").collect()
    df, n = np.zeros(FEATURES, np.int64), max([0, *(r["n"] for r in got)])
    for r in got:
        df.reshape(32, -1)[r["part"]] = np.frombuffer(r["df"], np.int64)
    return np.log((1 + n) / (1 + df)) + 1


def ftrl(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha=0.5, beta=1.0, l1=0.05, l2=0.05, epochs=3, seed=1) -> np.ndarray:
    """Weights (features and a bias, classes) by follow-the-regularised-leader, a document at a time."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) > l1, w, 0.0)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            i, x = docs[d]
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[d]] -= 1
            g = np.outer(x, p)
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    return weights(slice(None))


SCALE = 30.0  #: of a text's features, whose shares would be small numbers


def _train(weight: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, names = [], []
        for batch, data, at in B.blocks(batches, limit=1 << 20):
            parts = list(features(data, at))
            for j, name in enumerate(batch.column("lang").to_pylist()):
                if not parts[0][2][j]:
                    continue
                x = np.zeros(FEATURES)
                for h, cut, _ in parts:
                    x += np.bincount(h[cut[j] : cut[j + 1]], minlength=FEATURES)
                i = np.flatnonzero(x)
                docs.append((np.append(i, FEATURES), np.append(SCALE * x[i] / x.sum() * weight[i], 1.0)))
                names.append(name)
        if not names:
            return
        known = sorted(set(names))
        y = np.array([known.index(x) for x in names])
        order = np.random.default_rng(0).permutation(len(y))
        rest, fit = order[: len(y) // 5], order[len(y) // 5 :]
        w = ftrl([docs[d] for d in fit], y[fit], len(known))
        s = np.array([docs[d][1] @ w[docs[d][0]] for d in rest]).reshape(len(rest), len(known))

        def loss(t: float) -> float:
            u = s / t
            u -= u.max(1, keepdims=True)
            return float((np.log(np.exp(u).sum(1)) - u[np.arange(len(rest)), y[rest]]).mean())

        t = min(np.geomspace(0.2, 20, 60), key=loss) if len(rest) else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((known, (w[:-1] * weight[:, None] * SCALE).astype(np.float32), w[-1], float(t)))], pa.binary())], names=["model"])

    return of


def _predict(shared):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, bias, t = pickle.loads(shared.value) if shared.value else ([], None, None, 1.0)
        for batch, data, at in B.blocks(batches, limit=1 << 18):
            rows = len(batch)
            langs, scores = np.full(rows, "und", object), np.zeros(rows)
            if known:
                s, total = np.zeros((rows, len(known))), np.zeros(rows)
                for h, cut, some in features(data, at):
                    full = np.flatnonzero(np.diff(cut))
                    total += np.diff(cut)
                    if len(full):
                        for c in range(len(known)):
                            s[full, c] += np.add.reduceat(np.ascontiguousarray(w[:, c])[h], cut[full], dtype=np.float64)
                s = (s / np.maximum(total, 1)[:, None] + bias) / t
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                langs[some] = np.array(known, object)[best[some]]
                scores[some] = p[np.arange(rows), best][some]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names), pa.array(langs, pa.string()), pa.array(scores)], names=[*batch.schema.names, "lang_pred", "score"])

    return of


def fit(docs: DataFrame, most: int = 1500) -> bytes | None:
    """A model of lang from text: documents of the training fold only; weights from at most about ``most`` of each language."""
    small_batches(docs.sparkSession)
    rows = docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    return made(sample(rows, "lang", most, by=("doc_id", "text")).select("lang", "text"), _train(idf(rows)))


def predict(docs: DataFrame, model: bytes | None) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced). Only text is looked at."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("text", "lang_pred", "score")], F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, most: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score, a row for each row of ``docs`` (doc_id, text, lang)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "text")
    return predict(rows, fit(docs, most)).select("doc_id", "held_out", "lang_pred", "score")
