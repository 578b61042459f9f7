"""Claims in chunk texts, their conflicts and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import joined_id, squeeze

#: kinds of claims in the order they are looked for, with their patterns (fixed values)
PATTERNS = {
    "owner": "(?im)^owner:\\s*(.+)$",
    "amount": "\\$([0-9][0-9,]*(?:\\.[0-9]{2})?)\\b",
    "status_label": "(?im)^status:\\s*(.+)$",
    "date": "\\b([0-9]{4}-[0-9]{2}-[0-9]{2})\\b",
}
CAP = 5000


def normalized(c: Column) -> Column:
    return F.lower(squeeze(c))


def claims(chunks: DataFrame, key: str, text: str, scope: Column) -> DataFrame:
    """claim_id, kind, value, chunk, scope, kind_no, position. The texts are read once, for all kinds."""
    def of(kind: str, no: int) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1)), lambda raw, i: F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), F.lit(no).alias("kind_no"), i.alias("position")))

    found = [of(kind, no) for no, kind in enumerate(PATTERNS)]
    out = chunks.select(F.col(key).cast("string").alias("chunk"), scope.alias("scope"), F.explode(F.concat(*found)).alias("f"))
    out = out.select("chunk", "scope", "f.kind", normalized(F.col("f.raw")).alias("value"), "f.kind_no", "f.position")
    return out.withColumn("claim_id", joined_id(F.col("kind"), F.col("value"), F.col("chunk")))


def checked(all_claims: DataFrame, order: str = "chunk", cap: int = CAP, kinds_off: tuple[str, ...] = ()) -> DataFrame:
    """finding, scope, kind, left_value, right_value, n_pairs: the findings of a bundle's claims.

    Of more than ``cap`` claims there is one finding ``claims_too_many`` and no conflict. Else every two different values of a
    kind and scope conflict, given once with the number of claim pairs behind it, so that pairs of equal values in a hot scope
    are never enumerated. ``kinds_off``: kinds whose conflicts a policy has switched off.
    """
    size = all_claims.agg(F.count("*").alias("total"))  # one row
    per_value = all_claims.where(~F.col("kind").isin(*kinds_off) if kinds_off else F.lit(True)).groupBy("scope", "kind", "value").agg(F.count("*").alias("n"))
    # within the cap there are at most `cap` values; beyond it the join is never filled
    few = per_value.crossJoin(F.broadcast(size)).where(F.col("total") <= cap)
    left = few.select("scope", "kind", F.col("value").alias("left_value"), F.col("n").alias("ln"))
    right = few.select("scope", "kind", F.col("value").alias("right_value"), F.col("n").alias("rn"))
    pairs = left.join(right, ["scope", "kind"]).where("left_value < right_value")
    conflicts_ = pairs.select(F.lit("claim_conflict").alias("finding"), "scope", "kind", "left_value", "right_value", (F.col("ln") * F.col("rn")).alias("n_pairs"))
    null = F.lit(None).cast("string")
    many = size.where(F.col("total") > cap).select(F.lit("claims_too_many").alias("finding"), null.alias("scope"), null.alias("kind"), null.alias("left_value"), null.alias("right_value"), F.col("total").alias("n_pairs"))
    return conflicts_.unionByName(many)


def capped(all_claims: DataFrame, cap: int = CAP) -> DataFrame:
    """total, kept, too_many: a bundle with more claims than the cap keeps the first and gets one finding instead of conflicts."""
    return all_claims.agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(cap)).alias("kept"), (F.col("total") > cap).alias("too_many"))


def suppressed(all_claims: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return all_claims.withColumn("status", F.when(F.col("kind").isin(*kinds), "suppressed").otherwise("unverified"))


def conflicts(all_claims: DataFrame) -> DataFrame:
    """scope, kind, n_values, n_claims, n_conflicts: claims of a kind and scope whose values differ.

    The number of conflicting pairs follows from the counts per value, so pairs within a hot scope are never enumerated.
    """
    per_value = all_claims.groupBy("scope", "kind", "value").agg(F.count("*").alias("n"))
    g = per_value.groupBy("scope", "kind").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_claims"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    return g.where("n_values > 1").select("scope", "kind", "n_values", "n_claims", ((F.col("n_claims") * F.col("n_claims") - F.col("sq")) / 2).cast("bigint").alias("n_conflicts"))


def stale_sources(docs: DataFrame, today: str) -> DataFrame:
    """source_sha256, stale_after where the date has passed (strictly); one finding a source and date."""
    d = docs.where(F.col("okf_stale_after").isNotNull() & (F.col("okf_stale_after") < today)).select("source_sha256", F.col("okf_stale_after").alias("stale_after")).distinct()
    return d.withColumn("finding_id", joined_id(F.lit("stale"), F.concat("source_sha256", "stale_after")))


def first_per(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
