"""Vector cache: keys, misses, pruning, and cosine nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import joined_id

QUERY_BLOCK = 4096


def vector_key(text: Column, provider: str, model: str, dimension: int, version: str) -> Column:
    return joined_id(F.sha2(text, 256), F.lit(provider), F.lit(model), F.lit(str(dimension)), F.lit(version))


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    return wanted.join(cache.select("key").distinct(), "key", "left_anti")


def prune(cache: DataFrame, retained: DataFrame, on: str) -> DataFrame:
    """The cache without vectors of chunks that are gone."""
    return cache.join(retained.select(on).distinct(), on, "left_semi")


def compatible(cache: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: vectors, dimensions, and whether all have the same."""
    return cache.agg(F.count("*").alias("n_vectors"), F.min(F.size(vector)).alias("min_dimension"), F.max(F.size(vector)).alias("max_dimension")).withColumn("ok", F.col("min_dimension") == F.col("max_dimension"))


def hashed_embedding(text: Column, dimension: int = 64) -> Column:
    """A deterministic embedding without a model: signed hashed words, unit length."""
    from sheafline.functions.text import terms

    # the words are hashed once and bound, not made again for every slot
    bound = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    slots = F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(dimension * 2)))
    signs = lambda ss: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(ss, F.lit(0.0), lambda a, x: a + F.when(x == i, 1.0).when(x == i + dimension, -1.0).otherwise(0.0)))
    unit = lambda counts: bound(F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)), lambda norm: F.transform(counts, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm)))
    return bound(bound(slots, signs), unit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, rank, cosine: the k nearest vectors of each query against all vectors, exact.

    The stated queries go out in blocks of ``QUERY_BLOCK``; a partition keeps only its k best per query, as matrix products,
    and the final ranking is over partitions times k rows.
    """
    spark = vectors.sparkSession
    out = None
    block: list = []

    def flush(rows: list) -> None:
        nonlocal out
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            best_id = np.zeros((len(ids), 0), dtype=np.int64)
            best_sim = np.zeros((len(ids), 0))
            for batch in batches:
                if not len(batch):
                    continue
                v = np.stack(batch[vector].to_numpy()).astype(np.float64)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                sims = q @ v.T
                names = np.broadcast_to(batch[key].to_numpy(dtype=np.int64), sims.shape)
                sims = np.where(ids[:, None] == names, -np.inf, sims)
                best_sim, best_id = np.concatenate((best_sim, sims), axis=1), np.concatenate((best_id, names), axis=1)
                if best_sim.shape[1] > k:
                    keep = np.lexsort((best_id, -best_sim), axis=1)[:, :k]
                    best_sim, best_id = np.take_along_axis(best_sim, keep, 1), np.take_along_axis(best_id, keep, 1)
            n = best_sim.shape[1]
            frame = pd.DataFrame({"query_id": np.repeat(ids, n), key: best_id.ravel(), "cosine": best_sim.ravel()})
            yield frame[np.isfinite(frame["cosine"])]

        part = vectors.where(F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias(key), vector).mapInPandas(run, f"query_id bigint, {key} bigint, cosine double")
        out = part if out is None else out.unionByName(part)

    for row in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == QUERY_BLOCK:
            flush(block)
            block = []
    if block:
        flush(block)
    if out is None:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, rank int, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", key, "rank", F.round("cosine", 6).alias("cosine"))


def upsert(cache: DataFrame, fresh: DataFrame, key: str = "key") -> DataFrame:
    """The cache with fresh records in place of older ones of their key; a payload's text is not kept."""
    new = fresh.drop("text")
    return cache.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


class Providers:
    """Embedding providers by name; a provider states model, dimension and version, and makes a vector column of a text column."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, int, str, Callable[[Column], Column]]] = {}

    def register(self, name: str, model: str, dimension: int, version: str, embed: Callable[[Column], Column]) -> None:
        if name in self.known:
            raise ValueError(f"provider {name} exists")
        if not (name and model and version) or dimension < 1 or not callable(embed):
            raise ValueError("a provider needs a name, a model, a version, a dimension and a function of a text column")
        self.known[name] = (model, dimension, version, embed)

    def refresh(self, cache: DataFrame, chunks: DataFrame, name: str, text: str = "text") -> DataFrame:
        """key, embedding: only texts the cache lacks are embedded; vectors of texts that are gone are dropped."""
        model, dimension, version, embed = self.known[name]
        wanted = chunks.where(F.col(text).isNotNull()).select(vector_key(F.col(text), name, model, dimension, version).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        made = misses(wanted, cache).select("key", "text", embed(F.col("text")).alias("embedding"))
        return prune(upsert(cache, made), wanted, "key")
