"""A training corpus from raw documents: five stages, each of which reads what the one before it wrote.

Every stage handles null and empty texts, repeated rows and extra columns as its operator's docstring says. The
filtering stages drop: texts in no known language; documents with nothing left once their lines were found elsewhere; all
but the least doc_id of a group of near duplicates (rows repeated with one doc_id stay together); contaminated documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import decontaminate, langid, lines, neardup, packing
from quern.llm._spark import checkpoint_folder

#: Below this probability a text counts as in no known language.
SURE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. The model learns from the stage's own input."""
    own = {c: f"_own_{c}" for c in ("lang_pred", "score") if c in docs.columns}
    found = langid.predict(docs.withColumnsRenamed(own), langid.fit(docs))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return found.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere, exactly or nearly; n_chars follows. Those left with nothing go."""
    own = {c: f"_own_{c}" for c in ("n_lines", "n_removed", "kept", "kept_sha256") if c in docs.columns}
    found = lines.dedup_lines(docs.withColumnsRenamed(own))
    found = found.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", r"[\s]+", " ")) != ""))
    cols = {c: F.col(own.get(c, c)) for c in docs.columns} | {"text": F.col("kept")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[x.alias(c) for c, x in cols.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    gone = neardup.near_duplicates(docs, width=5, hundredths=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), size=1024)


STAGES = [("language_id", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", best_fit_packing)]

#: Model scores and similarity components have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is written to the session's checkpoint folder."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
