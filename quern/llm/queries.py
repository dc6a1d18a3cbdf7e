"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate as d, langid, lines, neardup, packing, shards, substring, suffix, toxicity, vptree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_substrings(_table(spark, sf_dir, "documents"), keep_text=False).drop("n_spans")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = d.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), d.sha256_of_items(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"), 40)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vptree.nearest(rows, rows.where("vec_id % 20 = 0"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_bytes(_table(spark, sf_dir, "documents")).drop("spans")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", "n_lines", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_decontamination, op3_sharding, op4_minhash_near_dedup, op5_language_id, op6_toxicity, op7_best_fit_packing, op8_nearest_neighbours, op9_suffix_array_dedup, op10_line_dedup)
}

# Where DuckDB can follow whole tables in seconds. Rows are told apart by doc_id, as in the tables.
_SPACED = r"'[^\x20\x09-\x0D]+'"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS h FROM d, unnest(range(1, len(w) - 11)) u(i)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (h) WHERE first < g.doc_id) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256 FROM d LEFT JOIN gone USING (doc_id)""",
    "op2_decontamination": f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark)),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM b, unnest(range(1, len(w) - n + 2)) u(i) WHERE n > 0),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) u(i)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op4_minhash_near_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
e AS (SELECT doc_id, len(x) AS n, hash(unnest(x)) AS h FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS to_id FROM ends UNION SELECT r.doc_id, l.b FROM reach r JOIN ends l ON l.a = r.to_id),
lowest AS (SELECT doc_id, min(to_id) AS m FROM reach GROUP BY doc_id)
SELECT doc_id, len(x) AS n_shingles, least(coalesce(m, doc_id), doc_id) AS component_id, least(coalesce(m, doc_id), doc_id) = doc_id AS kept FROM s LEFT JOIN lowest USING (doc_id)""",
    "op8_nearest_neighbours": """WITH e AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(v) = len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, x: a + x) AS score FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM p WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20""",
}
