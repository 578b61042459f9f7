"""Skip cache, ownership sync and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cached(results: DataFrame, files: DataFrame) -> DataFrame:
    """relpath, sha256, cached: whether an earlier run converted the same bytes at the same path."""
    ok = results.where("status = 'ok' and sha256 is not null").select("relpath", "sha256").distinct().withColumn("hit", F.lit(True))
    return files.join(ok, ["relpath", "sha256"], "left").select("relpath", "sha256", F.coalesce("hit", F.lit(False)).alias("cached"))


def current_files(docs: DataFrame) -> DataFrame:
    """relpath, sha256 of the latest conversion of each path."""
    w = Window.partitionBy("source_relpath").orderBy(F.desc("converted_at"), F.desc("canon_id"))
    return docs.where("source_relpath is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("source_relpath").alias("relpath"), F.col("source_sha256").alias("sha256"))


def sync_merge(state: DataFrame, outputs: DataFrame) -> DataFrame:
    """source_sha256, current_relpath, generation: seen sources move on by one generation, new ones start at 1."""
    o = outputs.groupBy(F.col("sha256").alias("source_sha256")).agg(F.min("relpath").alias("seen_relpath"))
    s = state.select("source_sha256", "current_relpath", "generation")
    return s.join(o, "source_sha256", "full_outer").select("source_sha256", F.coalesce("seen_relpath", "current_relpath").alias("current_relpath"), F.when(F.col("generation").isNull(), 1).when(F.col("seen_relpath").isNull(), F.col("generation")).otherwise(F.col("generation") + 1).cast("int").alias("generation"))


def reconcile(state: DataFrame, files: DataFrame) -> DataFrame:
    """source_sha256, action: unchanged, renamed (the smallest path with these bytes is another) or deleted_candidate."""
    f = files.groupBy(F.col("sha256").alias("source_sha256")).agg(F.min("relpath").alias("smallest"))
    j = state.select("source_sha256", "current_relpath").join(f, "source_sha256", "left")
    action = F.when(F.col("smallest").isNull(), "deleted_candidate").when(F.col("smallest") != F.col("current_relpath"), "renamed").otherwise("unchanged")
    return j.select("source_sha256", action.alias("action"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, removed or changed; equal rows are left out."""
    o, n = old.select(key, F.col(digest).alias("o")), new.select(key, F.col(digest).alias("n"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").otherwise("changed")
    return o.join(n, key, "full_outer").where(~F.col("o").eqNullSafe(F.col("n"))).select(key, change.alias("change"))


def engine_plan(capabilities: DataFrame, files: DataFrame, requested: str | None = None) -> DataFrame:
    """relpath, engine, rank: the engines for a file's suffix, the requested first, then by priority and name."""
    from sheafline.functions.text import suffix

    f = files.select("relpath", suffix(F.col("relpath")).alias("ext"))
    j = f.join(F.broadcast(capabilities), F.array_contains(F.col("extensions"), F.col("ext")))  # a fixed catalogue of engines
    w = Window.partitionBy("relpath").orderBy(F.when(F.col("engine") == requested, 0).otherwise(1) if requested else F.lit(0), "priority", "engine")
    return j.withColumn("rank", F.row_number().over(w)).select("relpath", "engine", "rank")
