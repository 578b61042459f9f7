"""Review as an append-only log: claims, decisions and their race rules, folded to states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATES = ("open", "claimed", "decided", "suppressed")


def fold(events: DataFrame) -> DataFrame:
    """item, state, reviewer, rejected from events (item, seq, action in claim, decide, suppress; reviewer).

    The first claim holds an item; a claim or decision by another reviewer is rejected, one by the same is idempotent.
    """
    w = Window.partitionBy("item").orderBy("seq")
    holder = F.first(F.when(F.col("action") == "claim", F.col("reviewer")), True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first_claim = F.min(F.when(F.col("action") == "claim", F.col("seq"))).over(Window.partitionBy("item"))
    e = events.withColumn("holder", holder).withColumn("claimed_at", first_claim)
    valid = (F.col("action") == "suppress") | ((F.col("reviewer") == F.col("holder")) & (F.col("seq") >= F.col("claimed_at")))
    e = e.withColumn("valid", F.coalesce(valid, F.lit(False)))
    state = F.when(F.max(F.when(F.col("valid") & (F.col("action") == "suppress"), 1)) == 1, "suppressed").when(F.max(F.when(F.col("valid") & (F.col("action") == "decide"), 1)) == 1, "decided").when(F.max(F.when(F.col("valid") & (F.col("action") == "claim"), 1)) == 1, "claimed").otherwise("open")
    return e.groupBy("item").agg(state.alias("state"), F.max("holder").alias("reviewer"), F.count_if(~F.col("valid")).alias("rejected"))


def evidence_packet(docs: DataFrame, chunks: DataFrame, per_document: int = 5) -> DataFrame:
    """canon_id, chunk id, page, text of the first chunks of each document under review."""
    pending = docs.where("okf_verified = 'human:pending'").select("canon_id", "source_sha256")
    # the first chunks of a source are those of each of its documents: cut before the join, so a source of many chunks or
    # documents multiplies nothing
    w = Window.partitionBy("source_sha256").orderBy("ordinal", "id")
    first = chunks.where("source_sha256 is not null").select("id", "source_sha256", "ordinal", "text", F.col("citation.page").alias("page")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_document)
    return pending.join(first, "source_sha256").select("canon_id", "id", "page", "text")


def decide(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """canon_id, before, after, reviewer, action of each pending document decided on; the first decision by time counts.

    ``decisions``: canon_id, action (approve or reject), reviewer, at. Documents that are not pending are left alone.
    """
    first = decisions.where(F.col("action").isin("approve", "reject")).groupBy("canon_id").agg(F.min(F.struct("at", "reviewer", "action")).alias("d"))
    pending = docs.where("okf_verified = 'human:pending'").select("canon_id", F.col("okf_verified").alias("before"))
    after = F.when(F.col("d.action") == "approve", F.concat(F.lit("human:"), "d.reviewer")).otherwise("human:rejected")
    return pending.join(first, "canon_id").select("canon_id", "before", after.alias("after"), F.col("d.reviewer").alias("reviewer"), F.col("d.action").alias("action"))
