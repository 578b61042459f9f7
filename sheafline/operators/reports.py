"""Run reports: statuses, engines, diagnostics, errors, merged history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import directory, percent


def distinct_runs(results: DataFrame) -> DataFrame:
    """Rows recorded more than once, once."""
    w = Window.partitionBy("result_id", "run_no", "relpath").orderBy("recorded_at")
    return results.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def by_status(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n")).withColumn("n", F.col("n"))


def success_rate(results: DataFrame) -> DataFrame:
    ok, total = F.count_if(F.col("status") == "ok"), F.count("*")
    return results.agg(total.alias("n_results"), ok.alias("n_ok"), percent(ok, total).alias("success"))


def by_engine(results: DataFrame) -> DataFrame:
    """engine, n, ok, failed, error_rate, avg_seconds."""
    g = results.groupBy(F.coalesce(F.nullif("engine", F.lit("")), F.lit("unknown")).alias("engine"))
    n, failed = F.count("*"), F.count_if(F.col("status") == "failed")
    return g.agg(n.alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), failed.alias("n_failed"), F.round(failed / n, 6).alias("error_rate"), F.round(F.avg("duration_seconds"), 6).alias("avg_seconds"))


def engine_matrix(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("engine", F.lit("unknown")).alias("engine"), "status").agg(F.count("*").alias("n"))


def codes(results: DataFrame) -> DataFrame:
    d = results.select(F.explode("diagnostics").alias("d"))
    return d.groupBy(F.col("d.code").alias("code"), F.col("d.severity").alias("severity")).agg(F.count("*").alias("n"))


def top_errors(results: DataFrame, k: int = 10) -> DataFrame:
    """error, n of the most frequent errors, and the rest in one row."""
    errors = results.where("status = 'failed'").groupBy(F.substring(F.replace(F.coalesce("error_text", F.lit("")), F.lit("|"), F.lit("\\|")), 1, 120).alias("error")).agg(F.count("*").alias("n"))
    best = errors.orderBy(F.desc("n"), "error").limit(k)
    rest = errors.agg(F.sum("n").alias("all_n")).crossJoin(F.broadcast(best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top_n")))).select(F.lit("(others)").alias("error"), (F.coalesce("all_n", F.lit(0)) - F.col("top_n")).alias("n"))
    return best.unionByName(rest)


def merged_history(results: DataFrame, recent: int = 20) -> DataFrame:
    """run_no, n, n_ok, total_to_date of the most recent runs; totals accumulate over all runs.

    The total up to a run is that of all runs less the later ones, so that only the recent rows are ordered.
    """
    runs = results.groupBy("run_no").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"))
    latest = runs.orderBy(F.desc("run_no")).limit(recent)
    later = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("run_no")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = runs.agg(F.sum("n").alias("all_n"))
    return latest.withColumn("later", later).crossJoin(F.broadcast(total)).select("run_no", "n", "n_ok", (F.col("all_n") - F.col("later")).alias("total_to_date"))


def directory_index(concepts: DataFrame, key: str = "concept_id") -> DataFrame:
    """dir, n, first, last: what a directory's index lists."""
    d = concepts.select(F.coalesce(F.nullif(directory(F.col(key)), F.lit("")), F.lit(".")).alias("dir"), F.col(key))
    return d.groupBy("dir").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last"))


def collisions(docs: DataFrame) -> DataFrame:
    """Concept paths that several source paths would write."""
    from sheafline.functions.text import concept_path

    pairs = docs.where("source_relpath is not null").select(concept_path(F.col("source_relpath")).alias("concept_id"), "source_relpath").distinct()
    return pairs.groupBy("concept_id").agg(F.count("*").alias("n_sources")).where("n_sources > 1")


def attachment_budget(docs: DataFrame, max_bytes: int, max_members: int, max_total: int) -> DataFrame:
    """canon_id, n_kept, n_quarantined, bytes_kept: a fold over each document's attachments; what is skipped uses no budget."""
    state = "struct<kept:bigint, total:bigint, skipped:bigint>"
    start = F.struct(F.lit(0).cast("bigint").alias("kept"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("skipped")).cast(state)

    def step(acc, a):
        fits = (a["byte_size"] <= max_bytes) & (acc["kept"] < max_members) & (acc["total"] + a["byte_size"] <= max_total)
        return F.struct((acc["kept"] + F.when(fits, 1).otherwise(0)).alias("kept"), (acc["total"] + F.when(fits, a["byte_size"]).otherwise(0)).alias("total"), (acc["skipped"] + F.when(fits, 0).otherwise(1)).alias("skipped")).cast(state)

    s = docs.where(F.size("attachments") > 0).select("canon_id", F.aggregate("attachments", start, step).alias("s"))
    return s.select("canon_id", F.col("s.kept").alias("n_kept"), F.col("s.skipped").alias("n_quarantined"), F.col("s.total").alias("bytes_kept"))
