"""What the two classifiers share: folds, bounded training samples, a model made in one executor task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._spark import settle


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def sample(rows: DataFrame, label: str, most: int, by: tuple[str, ...], labels: int = 1024) -> DataFrame:
    """About ``most`` rows of each label at most, by a hash of the columns ``by``; all of a label that has no more.

    More than ``labels`` labels are an error: a model of them all would not have room in one task, and none is left out in silence.
    """
    counts = settle(rows.groupBy(label).agg(F.count("*").alias("_n")))
    if (n := counts.count()) > labels:
        raise ValueError(f"{n} values of {label}; a model is fitted for {labels} at most")
    luck = F.pmod(F.xxhash64(*by, label), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(F.broadcast(counts), label).where(luck * F.col("_n") < most).drop("_n")


def made(rows: DataFrame, train, fallback: bytes | None = None) -> bytes | None:
    """What ``train`` (an Arrow mapper of one task) makes of a bounded sample."""
    got = settle(rows.repartition(1).sortWithinPartitions(*rows.columns).mapInArrow(train, "model binary")).head()
    return bytes(got["model"]) if got is not None else fallback
