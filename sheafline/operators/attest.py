"""Leaf hashes, Merkle trees and inclusion proofs, level by level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import cut

EMPTY_ROOT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def canonical(body: Column) -> Column:
    """Line ends as LF, no white space at line ends."""
    return F.regexp_replace(F.regexp_replace(body, "\\r\\n?", "\n"), "(?m)[ \\t]+$", "")


def leaves(concepts: DataFrame, path: str, body: str) -> DataFrame:
    """path, leaf."""
    return concepts.select(F.col(path).alias("path"), F.sha2(canonical(F.coalesce(F.col(body), F.lit(""))), 256).alias("leaf"))


def numbered(leaf_rows: DataFrame) -> DataFrame:
    """Adds the leaf's index in path order: a range partitioning and per-partition offsets, no single-task sort."""
    spark = leaf_rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(leaf_rows.repartitionByRange(n, "path", "leaf").sortWithinPartitions("path", "leaf").withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy("path", "leaf")
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a partition
    offset, at = {}, 0
    for part, size in sizes:
        offset[part] = at
        at += size
    start = spark.createDataFrame(list(offset.items()) or [(0, 0)], "part int, start long")
    return ranged.withColumn("r", F.row_number().over(w) - 1).join(F.broadcast(start), "part").select("path", "leaf", (F.col("start") + F.col("r")).alias("idx"))


def parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


#: levels of the tree that one task folds at once: aligned runs of 2 ** FOLD nodes
FOLD = 10


def fold(nodes: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(level, index, node) above an aligned run of nodes, FOLD levels up; an unpaired last node is carried up as it is."""
    for level in range(1, FOLD + 1):
        nodes = [hashlib.sha256(b"\x01" + nodes[i] + nodes[i + 1]).digest() if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        for i, x in enumerate(nodes):
            yield level, i, x


def tree(leaf_rows: DataFrame, inner: bool = True) -> tuple[DataFrame, DataFrame, int]:
    """(path, leaf, idx; level, idx, node; number of leaves): the whole tree in one round for every FOLD levels.

    Without ``inner`` only the nodes of every FOLD-th level are kept, which end in the root.
    """
    own = cut(numbered(leaf_rows))
    n = own.count()
    level = own.select(F.lit(0).alias("level"), "idx", F.col("leaf").alias("node"))
    out, base, left = level, 0, n
    while left > 1:

        def run(batches: Iterator[pd.DataFrame], base=base) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for block, nodes in zip(batch["block"], batch["nodes"], strict=True):
                    for up, i, x in fold([bytes.fromhex(v["node"]) for v in nodes]):
                        if inner or up == FOLD:
                            rows.append((base + up, (int(block) << (FOLD - up)) + i, x.hex()))
                yield pd.DataFrame(rows, columns=["level", "idx", "node"])

        runs = level.groupBy(F.shiftright("idx", FOLD).alias("block")).agg(F.array_sort(F.collect_list(F.struct("idx", "node"))).alias("nodes"))  # at most 2 ** FOLD nodes
        above = cut(runs.mapInPandas(run, "level int, idx long, node string"))
        base += FOLD
        left = -(-left >> FOLD)
        level = above.where(F.col("level") == base)
        out = out.unionByName(above)
    return own, out, n


def merkle_root(leaf_rows: DataFrame) -> DataFrame:
    """n_leaves, root: one row."""
    _, nodes, n = tree(leaf_rows, inner=False)
    if n == 0:
        return leaf_rows.sparkSession.createDataFrame([(0, EMPTY_ROOT)], "n_leaves long, root string")
    return nodes.where("idx = 0").orderBy(F.desc("level")).limit(1).select(F.lit(n).cast("bigint").alias("n_leaves"), F.col("node").alias("root"))


def proofs(leaf_rows: DataFrame) -> DataFrame:
    """path, step, sibling, side: the siblings from the leaf up."""
    own, nodes, n = tree(leaf_rows)
    steps = max(0, (n - 1).bit_length())
    if not steps:
        return leaf_rows.sparkSession.createDataFrame([], "path string, step int, sibling string, side string")
    asked = own.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda k: F.struct(k.alias("step"), F.expr("shiftright(idx, 0)").alias("at")))).alias("s"))
    asked = asked.select("path", "s.step", F.expr("(s.at >> s.step) ^ 1L").alias("sib"))
    named = nodes.select(F.col("level").alias("step"), F.col("idx").alias("sib"), F.col("node").alias("sibling"))
    return asked.join(named, ["step", "sib"]).select("path", "step", "sibling", F.when(F.col("sib") % 2 == 1, "right").otherwise("left").alias("side"))


def verify(leaf_rows: DataFrame, attested: DataFrame) -> DataFrame:
    """path, state: ok, changed, missing or unexpected against attested (path, leaf)."""
    a, b = leaf_rows.select("path", F.col("leaf").alias("now")), attested.select("path", F.col("leaf").alias("then"))
    state = F.when(F.col("then").isNull(), "unexpected").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("then"), "changed").otherwise("ok")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def canonical_json(fields: dict[str, Column]) -> Column:
    """A flat JSON object with its keys sorted and no white space, the same bytes for the same values."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]), {"ignoreNullFields": "false"})


def proven(leaf_rows: DataFrame, proof_rows: DataFrame, root: str) -> DataFrame:
    """path, ok: does each leaf's proof lead to the root?"""
    steps = proof_rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", "sibling", "side"))).alias("steps"))
    up = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<step:int,sibling:string,side:string>>")), F.col("leaf"), lambda acc, s: F.when(s["side"] == "right", parent(acc, s["sibling"])).otherwise(parent(s["sibling"], acc)))
    return leaf_rows.join(steps, "path", "left").select("path", (up == root).alias("ok"))


def verified(leaf_rows: DataFrame, attested: DataFrame, root: str) -> DataFrame:
    """One row: map_ok (the same paths and leaves), root_ok, proofs_ok, and the counts of each state."""
    states = verify(leaf_rows, attested).agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("ok", "changed", "missing", "unexpected")])
    own = merkle_root(leaf_rows).select((F.col("root") == root).alias("root_ok"))
    held = proven(leaf_rows, proofs(leaf_rows), root).agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("proofs_ok"))
    return states.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(held)).select(((F.col("n_changed") + F.col("n_missing") + F.col("n_unexpected")) == 0).alias("map_ok"), "root_ok", "proofs_ok", *[f"n_{s}" for s in ("ok", "changed", "missing", "unexpected")])


def statement(leaf_rows: DataFrame, root: str, version: str = "1") -> DataFrame:
    """part, line: an in-toto statement in lines that a distributed writer can save: a head, an output a leaf in path order, a foot.

    The lines joined are one JSON document; no task holds all outputs.
    """
    n = numbered(leaf_rows)
    line = F.concat(F.when(F.col("idx") == 0, "").otherwise(","), F.to_json(F.struct("path", F.col("leaf").alias("sha256"))))
    rows = n.select((F.col("idx") + 1).alias("part"), line.alias("line"))
    head = '{"_type":"https://in-toto.io/Statement/v1","subject":[{"name":"bundle","digest":{"sha256":"' + root + '"}}],"predicate":{"schema_version":"' + version + '","merkle_root":"' + root + '","outputs":['
    ends = leaf_rows.sparkSession.createDataFrame([(0, head), (2**62, "]}}")], "part long, line string")
    return rows.unionByName(ends)
