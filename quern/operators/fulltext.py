"""Ranked full-text search (BM25) over a text column.

Tokens are runs of letters, digits and underscores, inner apostrophes and full stops included, lower-cased; no stemming, no stop words.
Scripts without spaces between words come as whole runs. Document lengths are exact, or one byte's worth with ``quantised``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .similarity import Filter, project

TOKEN = r"[\p{L}\p{N}_]+(?:['.][\p{L}\p{N}_]+)*"
K1, B = 1.2, 0.75


def quantised(length: Column) -> Column:
    """The least length that one byte tells from this one: exact below 64, then four significant bits; at most 30 bits are told apart."""
    n = F.least(length.cast("bigint"), F.lit((1 << 30) - 1))
    drop = F.greatest(F.length(F.bin(n)) - 4, F.lit(0))
    return F.when(n < 64, n).otherwise(F.call_function("shiftleft", F.call_function("shiftright", n, drop), drop))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def postings(docs: DataFrame, text: str, id: str = "id") -> DataFrame:
    """term, id, tf, dl: how often a document has a term, and its number of tokens."""
    words = docs.where(F.col(text).isNotNull()).select(id, tokens(F.col(text)).alias("_t"))
    return words.select(id, F.size("_t").cast("bigint").alias("dl"), F.explode("_t").alias("term")).groupBy("term", id, "dl").agg(F.count("*").alias("tf"))


def stats(docs: DataFrame, text: str) -> DataFrame:
    """n_docs with the field, total_length, avgdl."""
    n = docs.where(F.col(text).isNotNull()).select(F.size(tokens(F.col(text))).cast("bigint").alias("dl"))
    return n.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length"), F.avg("dl").alias("avgdl"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln((n_docs - df + 0.5) / (df + 0.5) + 1)


def hit(idf_: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    w = idf_ * (K1 + 1)
    return w - w / (1 + tf / (K1 * ((1 - B) + B * dl / avgdl)))


def query_terms(spark, query: str) -> list[str]:
    """Distinct tokens in order of appearance; cut by the tokenizer that cuts documents."""
    row = spark.range(1).select(F.array_distinct(tokens(F.lit(query))).alias("t")).first()
    return list(row["t"])


def _times(term: str) -> Column:
    return F.size(F.filter("_t", lambda x: x == F.lit(term)))


def scored(docs: DataFrame, text: str, query: str, id: str = "id", where: Filter | None = None) -> DataFrame:
    """id, score of the documents that hold a term of the query.

    One scan counts the query's terms in each document without exploding its tokens, and corpus statistics are one aggregated row.
    Statistics cover all documents; the filter holds for hits alone.
    """
    spark = docs.sparkSession
    terms = query_terms(spark, query)
    if not terms:
        return docs.select(id).where(F.lit(False)).withColumn("score", F.lit(0.0))
    cols = [c for c in ({id, text} | set(_fields(where)))]
    words = docs.where(F.col(text).isNotNull()).select(*cols, tokens(F.col(text)).alias("_t"))
    counts = words.select(*[c for c in cols if c != text or c == id], F.size("_t").cast("double").alias("dl"), *[_times(t).cast("double").alias(f"tf{i}") for i, t in enumerate(terms)])
    total = counts.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.when(F.col(f"tf{i}") > 0, 1.0).otherwise(0.0)).alias(f"df{i}") for i in range(len(terms))])
    found = counts.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0.0)) > 0)
    if where is not None:
        found = found.where(where.column())
    found = found.crossJoin(F.broadcast(total))  # one row
    parts = [F.when(F.col(f"tf{i}") > 0, hit(idf(F.col("n"), F.col(f"df{i}")), F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))).otherwise(0.0) for i in range(len(terms))]
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return found.select(id, score.alias("score"))


def _fields(where: Filter | None) -> list[str]:
    if where is None:
        return []
    return [where.field] if where.field else [x for p in where.parts for x in _fields(p)]


def search(docs: DataFrame, text: str, query: str, k: int, where: Filter | None = None, fields: list[str] | None = None, id: str = "id") -> DataFrame:
    """id, score and attributes of the k best documents, best first, ties by id."""
    best = scored(docs, text, query, id, where).orderBy(F.desc("score"), F.asc(id)).limit(k)
    if fields == []:
        return best
    rest = docs.select(id, *[c for c in docs.columns if c != id and (fields is None or c in fields)])
    return project(rest.join(F.broadcast(best), id), fields, id).orderBy(F.desc("score"), F.asc(id))  # best: k rows


def indexed_scores(index: DataFrame, corpus: DataFrame, terms: list[str], id: str = "id", byte_lengths: bool = False) -> DataFrame:
    """id, score from stored postings (see postings(); best written sorted by term, whose filter then skips row groups) and stats().

    ``byte_lengths``: documents have quantised() lengths; the average stays exact.
    """
    hits = index.where(F.col("term").isin(*terms))
    dfs = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))  # a row for each term of the query
    both = hits.join(F.broadcast(dfs), "term").crossJoin(F.broadcast(corpus))
    each = hit(idf(F.col("n_docs").cast("double"), F.col("df")), F.col("tf").cast("double"), (quantised(F.col("dl")) if byte_lengths else F.col("dl")).cast("double"), F.col("avgdl"))
    return both.groupBy(id).agg(F.sum(each).alias("score"))
