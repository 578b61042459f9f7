"""A search index kept as tables: postings partitioned by a hash of the term, lengths, and one row of statistics.

A query reads the partitions of its own terms and, within them, the row groups that can hold a term; the texts are not read.
Phrases, NEAR and ^first are decided by positions. A prefix reads the sorted terms of all partitions, whose row groups
are skipped by their least and greatest term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.functions.text import terms
from sheafline.operators.search import Node, idf, parse, postings

BUCKETS = 64


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def write(chunks: DataFrame, folder: str, key: str = "id", tie: tuple[str, ...] = ("concept_id", "ordinal"), buckets: int = BUCKETS) -> None:
    """Writes the index of chunks below a shared folder; chunks without a text are not part of it."""
    rows = chunks.where(F.col("text").isNotNull())
    p = postings(rows, key).withColumn("bucket", _bucket(F.col("term"), buckets))
    p.repartition(buckets, "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    lengths = rows.select(key, *tie, F.size(terms(F.col("text"))).alias("dl"))
    lengths.write.mode("overwrite").parquet(f"{folder}/lengths")
    stats = rows.sparkSession.read.parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.lit(buckets).alias("buckets"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{folder}/stats")


def _leaves(node: Node) -> list[Node]:
    return [x for a in node.args for x in _leaves(a)] if node.op in ("and", "or", "not") else [node]


def _words(node: Node) -> list[str]:
    return list(node.args[0]) if node.op == "near" else [] if node.op == "prefix" else list(node.args)


class Index:
    """A written index; every answer is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "id", tie: tuple[str, ...] = ("concept_id", "ordinal")):
        self.spark, self.folder, self.key, self.tie = spark, folder, key, tie
        self.stats = spark.read.parquet(f"{folder}/stats").first()  # one row
        lengths = spark.read.parquet(f"{folder}/lengths").schema
        self.schema = f"term string, `{key}` {lengths[key].dataType.simpleString()}, tf bigint, positions array<int>, bucket int"

    def postings(self, words: list[str], prefixes: list[str] = ()) -> DataFrame:
        """term, key, positions of the words (their partitions only) and of the terms with a prefix."""
        p = self.spark.read.schema(self.schema).parquet(f"{self.folder}/postings")
        cond = F.lit(False)
        if words:
            buckets = sorted({r.b for r in self.spark.createDataFrame([(w,) for w in words], "w string").select(_bucket(F.col("w"), self.stats.buckets).alias("b")).collect()})
            cond = F.col("bucket").isin(*buckets) & F.col("term").isin(*words)
        for x in prefixes:
            cond = cond | ((F.col("term") >= x) & F.col("term").startswith(x))
        return p.where(cond).select("term", self.key, "positions")

    def ranked(self, query: str) -> DataFrame:
        """key, tie columns, score of every chunk the query matches; smaller is better."""
        tree = parse(query)
        leaves = _leaves(tree)
        words = list(dict.fromkeys(w for n in leaves for w in _words(n)))
        prefixes = list(dict.fromkeys(n.args[0] for n in leaves if n.op == "prefix"))
        held = self.postings(words, prefixes).groupBy(self.key).agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))  # the query's terms of one chunk
        at = F.col("at")
        none = F.array().cast("array<int>")
        of = lambda w: F.coalesce(F.try_element_at(at, F.lit(w)), none)

        def hits(n: Node) -> Column:
            """How often a term, prefix or phrase stands in the chunk."""
            if n.op == "prefix":
                return F.aggregate(F.map_values(F.map_filter(at, lambda t, _: t.startswith(n.args[0]))), F.lit(0), lambda acc, x: acc + F.size(x))
            if n.op == "first":
                return F.array_contains(of(n.args[0]), 0).cast("int")
            if n.op == "phrase":
                return F.size(F.filter(of(n.args[0]), lambda p: _all([F.array_contains(of(w), p + k) for k, w in enumerate(n.args)])))
            return F.size(of(n.args[0]))

        def near(n: Node) -> Column:
            """Positions at which a window begins that holds all of NEAR's words."""
            ws, dist = n.args
            within = lambda w, p: F.exists(of(w), lambda q: (q >= p) & (q < p + dist + len(ws)))
            return F.filter(F.flatten(F.array(*[of(w) for w in ws])), lambda p: _all([within(w, p) for w in ws]))

        def holds(n: Node) -> Column:
            if n.op == "and":
                return holds(n.args[0]) & holds(n.args[1])
            if n.op == "or":
                return holds(n.args[0]) | holds(n.args[1])
            if n.op == "not":
                return holds(n.args[0]) & ~holds(n.args[1])
            return F.size(near(n)) > 0 if n.op == "near" else hits(n) > 0

        def phrases(n: Node) -> list[tuple[Column, Column]]:
            if n.op == "and":
                return phrases(n.args[0]) + phrases(n.args[1])
            if n.op == "not":
                return phrases(n.args[0])
            if n.op == "or":
                return [(has, F.when(holds(a), tf).otherwise(0)) for a in n.args for has, tf in phrases(a)]
            if n.op == "near":
                ws, dist = n.args
                wide = dist + len(ws)
                return [(F.size(of(w)) > 0, F.size(F.filter(of(w), lambda q: F.exists(near(n), lambda p: (p <= q) & (q < p + wide))))) for w in ws]
            return [(hits(n) > 0, hits(n))]

        parts = phrases(tree)
        rows = held.select(self.key, holds(tree).alias("hit"), *[c for i, (has, tf) in enumerate(parts) for c in (has.alias(f"has{i}"), tf.alias(f"tf{i}"))])
        df = rows.agg(*[F.count_if(F.col(f"has{i}")).alias(f"df{i}") for i in range(len(parts))])  # one row
        n, avgdl = F.lit(self.stats.n), F.lit(self.stats.avgdl)
        norm = 1.2 * (0.25 + 0.75 * F.col("dl") / avgdl)
        score = sum((idf(n, F.col(f"df{i}")) * (F.col(f"tf{i}") * 2.2) / (F.col(f"tf{i}") + norm) for i in range(len(parts))), F.lit(0.0))
        lengths = self.spark.read.parquet(f"{self.folder}/lengths")
        return rows.where("hit").join(lengths, self.key).crossJoin(F.broadcast(df)).select(self.key, *self.tie, (-score).alias("score"))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        if limit <= 0:
            raise ValueError("limit must be positive")
        return self.ranked(query).orderBy("score", *self.tie).limit(limit)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
