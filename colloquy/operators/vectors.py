"""TF-IDF vectors, sparse and dense, cosine similarity and rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import scratch

DIMENSIONS = 256
RRF_K = 60
#: Query vectors that are broadcast at once.
QUERY_BLOCK = 4096


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(counts: DataFrame, n_docs: Column | int, size: int = DIMENSIONS, min_df: int = 1) -> DataFrame:
    """term, df, idf of the most frequent terms by document, ties by term."""
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    top = df.orderBy(F.desc("df"), "term").limit(size)
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return top.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def normalised(weights: DataFrame, key: str | tuple[str, ...]) -> DataFrame:
    """key, term, w with unit length per key."""
    keys = [key] if isinstance(key, str) else list(key)
    norms = weights.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.join(norms, keys).where("norm > 0").select(*keys, "term", (F.col("w") / F.col("norm")).alias("w"))


def embed(docs: DataFrame, key: str | tuple[str, ...], text: str, vocab: DataFrame) -> DataFrame:
    """Sparse embedding: key, term, w = tf / tokens * idf, normalised. ``vocab`` is bounded.

    Texts of several rows with the same key count as one text. The number of
    tokens is a factor of the whole vector, so normalising removes it and
    only the vocabulary's terms are counted.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = docs.select(*keys, F.explode(X.embed_tokens(F.col(text))).alias("term")).join(F.broadcast(vocab), "term").groupBy(*keys, "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
    return normalised(counts.select(*keys, "term", (F.col("tf") * F.col("idf")).alias("w")), key)


def fit_embedder(docs: DataFrame, key: str, text: str, size: int = DIMENSIONS) -> DataFrame:
    """The embedder's state: term, df, idf; rows with the same key are one document."""
    counts = term_counts(docs, key, X.embed_tokens(F.col(text)))
    return vocabulary(counts, docs.agg(F.countDistinct(key)).scalar(), size)


def dense(sparse: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """key, embedding: ARRAY<FLOAT> in the order of ``terms`` (a bounded vocabulary)."""
    maps = sparse.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"))
    return maps.select(key, F.transform(F.array(*map(F.lit, terms)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(0.0)).cast("float")).alias("embedding"))


def cosine(a: Column, b: Column) -> Column:
    """Of two dense vectors; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def similar(sparse: DataFrame, key: str | tuple[str, ...], query: DataFrame) -> DataFrame:
    """key, score: dot product with one query vector (term, w), by an equi-join on terms."""
    q = query.select("term", F.col("w").alias("q"))
    return sparse.join(F.broadcast(q), "term").groupBy(*([key] if isinstance(key, str) else key)).agg(F.sum(F.col("w") * F.col("q")).alias("score"))


def ranked(scored: DataFrame, key: str, limit: int, score: str = "score") -> DataFrame:
    """The best ``limit`` rows with their rank from 0, ties by key; only these reach one task."""
    return scored.orderBy(F.desc(score), key).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)


def fuse(lists: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (key, rank): sum of 1 / (60 + rank + 1)."""
    rows = lists[0].select(key, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank") + 1)).alias("rrf"))


NEAREST = "query_id long, vec_id long, cosine double"
_NEAREST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("cosine", pa.float64())])


def _unit(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Rows of unit length; a row without length stays zero."""
    column = batch["embedding"].combine_chunks() if isinstance(batch, pa.Table) else batch["embedding"]
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(held, k: int, digits: int):
    """Each task's own best ``k`` rows of every query, kept as it reads and handed on at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = held.value
        best, near = np.full((len(ids), 0), 0.0), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                vec = part["vec_id"].to_numpy()
                order = np.argsort(vec, kind="stable")  # ties go to the smaller id
                cosine = np.round(queries @ _unit(part)[order].T, digits) + 0.0
                top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                both, names = np.concatenate([best, np.take_along_axis(cosine, top, axis=1)], axis=1), np.concatenate([near, vec[order][top]], axis=1)
                order = np.lexsort((names, -both), axis=1)[:, :k]
                best, near = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, near.shape[1])), pa.array(near.ravel()), pa.array(best.ravel())], schema=_NEAREST)

    return run


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, block: int = QUERY_BLOCK, digits: int = 5) -> DataFrame:
    """query_id, vec_id, cosine: the ``k`` rows most similar to each query, itself included.

    Both have vec_id and embedding (dense, of one length). Every query meets
    every row: queries are written in blocks of about ``block``, and one block
    at a time is broadcast for one pass over the rows; each task hands on its
    best ``k`` of a query only. Cosines are rounded to ``digits`` and ties go
    to the smaller id. Rows without an embedding are left out.
    """
    spark = embeddings.sparkSession
    rows, asked = (d.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding") for d in (embeddings, queries))
    asked = scratch.table(asked, "queries")
    blocks = max(1, -(-asked.count() // block))
    path = scratch.new_path(spark, "nearest")
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if part.num_rows:
            held = spark.sparkContext.broadcast((part["vec_id"].to_numpy(), _unit(part)))
            rows.mapInArrow(_best(held, k, digits), NEAREST).write.mode("append").parquet(path)
            held.destroy()
    found = spark.read.schema(NEAREST).parquet(path) if asked.limit(1).count() else spark.createDataFrame([], NEAREST)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "vec_id", "cosine")
