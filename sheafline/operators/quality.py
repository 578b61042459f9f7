"""Lint, policy, readiness, review queue, health and redaction of concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import SHA256

SECRET = "\\bsk-[A-Za-z0-9_-]{20,}\\b"
#: profile -> (needs review below, ready from) (fixed values)
PROFILES = {"default": (0.5, 0.85), "rag": (0.6, 0.9), "publication": (0.7, 0.95)}
#: rule packs: name -> (parents, rules of (id, severity, condition)) (fixed values)
PACKS: dict[str, tuple[tuple[str, ...], tuple[tuple[str, str, str], ...]]] = {
    "research": ((), (("sources-required", "error", "sources.missing"), ("review-pending", "warning", "verified.pending"))),
    "legal-hold": ((), (("sources-required", "error", "sources.missing"), ("review-pending", "error", "verified.pending"))),
    "pii-safe": (("research",), (("redaction-proposed", "warning", "redaction.proposed"),)),
    "publication": (("research",), (("diagnostics-present", "warning", "diagnostics.present"),)),
    "rag-ready": (("research",), (("readiness-not-ready", "warning", "readiness.not_ready"),)),
}


def concept_lint(concepts: DataFrame) -> DataFrame:
    """concept_id, severity, rule of every violated rule on frontmatter and body."""

    def rule(cond: Column, severity: str, name: str) -> Column:
        return F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(name).alias("rule")))

    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    found = F.array_compact(
        F.array(
            rule(empty("okf_type"), "error", "type-required"),
            rule(F.length("okf_type") > 60, "warning", "type-length"),
            rule(empty("source_uri"), "error", "sources-uri"),
            rule(~F.coalesce(F.col("source_sha256").rlike(SHA256), F.lit(False)), "error", "sources-sha256"),
            rule(empty("okf_status"), "warning", "status-missing"),
            rule(empty("okf_verified"), "warning", "verified-missing"),
            rule(empty("body_md"), "warning", "body-empty"),
        )
    )
    return concepts.select("canon_id", F.explode(found).alias("f")).select("canon_id", "f.severity", "f.rule")


def markdown_lint(docs: DataFrame, longest: int = 200) -> DataFrame:
    """canon_id, line_no, rule: skipped heading levels, an odd number of fences, long lines."""
    lines = docs.select("canon_id", F.posexplode(F.split("body_md", "\n")).alias("line_no", "line"))
    level = F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1))
    heads = lines.where(level > 0).select("canon_id", "line_no", level.alias("level"))
    w = Window.partitionBy("canon_id").orderBy("line_no")
    skips = heads.withColumn("before", F.lag("level").over(w)).where("level > before + 1").select("canon_id", "line_no", F.lit("heading-skip").alias("rule"))
    fences = lines.where(F.col("line").rlike("^```")).groupBy("canon_id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("canon_id", F.lit(-1).alias("line_no"), F.lit("fence-odd").alias("rule"))
    long = lines.where(F.length("line") > longest).select("canon_id", "line_no", F.lit("line-length").alias("rule"))
    return skips.unionByName(fences).unionByName(long)


def severities(findings: DataFrame) -> DataFrame:
    return findings.agg(*[F.sum((F.col("severity") == s).cast("bigint")).alias(s) for s in ("error", "warning", "info")])


def policy(docs: DataFrame, types: tuple[str, ...], statuses: tuple[str, ...], verified: tuple[str, ...]) -> DataFrame:
    """canon_id, rule of each trust rule a concept breaks; ``*`` admits any value that is not empty."""

    def allowed(c: str, names: tuple[str, ...]) -> Column:
        v = F.coalesce(F.col(c), F.lit(""))
        return v != "" if "*" in names else v.isin(*names)

    bad = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in (("type", allowed("okf_type", types)), ("status", allowed("okf_status", statuses)), ("verified", allowed("okf_verified", verified)), ("sources", F.col("source_uri").isNotNull()), ("sha256", F.coalesce(F.col("source_sha256").rlike(SHA256), F.lit(False))))]))
    return docs.select("canon_id", F.explode(bad).alias("rule"))


def pack_rules(name: str, seen: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """The rules of a pack, parents' first; a cycle or a rule given twice is an error."""
    if name in seen:
        raise ValueError(f"cycle of packs at {name}")
    parents, own = PACKS[name]
    rules: list[tuple[str, str, str]] = []
    for p in parents:
        rules.extend(pack_rules(p, (*seen, name)))
    rules.extend(own)
    ids = [r[0] for r in rules]
    if len(ids) != len(set(ids)):
        raise ValueError(f"a rule is given twice in {name}")
    return rules


def pack_findings(concepts: DataFrame, name: str) -> DataFrame:
    """canon_id, rule, severity; the rules are constants of the plan, so nothing is joined."""
    conditions = {
        "sources.missing": F.col("source_uri").isNull(),
        "verified.pending": F.coalesce(F.col("okf_verified"), F.lit("human:pending")) == "human:pending",
        "redaction.proposed": F.coalesce(F.col("body_md").rlike(SECRET), F.lit(False)),
        "diagnostics.present": F.coalesce(F.col("n_diagnostics") > 0, F.lit(False)) if "n_diagnostics" in concepts.columns else F.lit(False),
        "readiness.not_ready": F.coalesce(F.col("grade") != "ready", F.lit(False)) if "grade" in concepts.columns else F.lit(False),
        "stale.expired": F.col("okf_stale_after").isNotNull(),
    }
    found = F.array_compact(F.array(*[F.when(conditions[cond], F.struct(F.lit(rule).alias("rule"), F.lit(sev).alias("severity"))) for rule, sev, cond in pack_rules(name)]))
    return concepts.select("canon_id", F.explode(found).alias("f")).select("canon_id", "f.rule", "f.severity")


def readiness(docs: DataFrame, now: str, profile: str = "default") -> DataFrame:
    """canon_id, score, grade: deductions for citation, chunks, OCR, freshness and human review."""
    review, ready = PROFILES[profile]
    cost = {
        "citation": F.when(F.col("source_sha256").isNull(), 0.1).otherwise(0.0),
        "chunks": F.when(F.coalesce(F.col("n_chunks"), F.lit(0)) == 0, 0.1).otherwise(0.0),
        "ocr": F.when(F.element_at("metadata", "ocr_enabled") == "true", 0.1).otherwise(0.0),
        "freshness": F.when(F.col("okf_stale_after").isNull(), 0.1).when(F.col("okf_stale_after") < now, 0.2).otherwise(0.0),
        "human": F.when(F.coalesce(F.col("okf_verified"), F.lit("")).startswith("human:") & (F.col("okf_verified") != "human:pending"), 0.0).otherwise(0.3),
    }
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cost.values()), F.lit(0.0))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - total)), 9)
    # a score between the two bounds needs review; below the lower one it is blocked
    grade = F.when((score <= 0) | (score < review), "blocked").when(score < ready, "needs_review").otherwise("ready")
    return docs.select("canon_id", score.alias("score"), grade.alias("grade"))


def queue(docs: DataFrame, now: str, limit: int | None = None) -> DataFrame:
    """canon_id, priority: factors pending, ocr, stale and age (half weight), highest first."""
    days = F.datediff(F.to_date(F.lit(now)), F.to_date("converted_at"))
    factors = [
        F.when(F.col("okf_verified") == "human:pending", 1.0).otherwise(0.0),
        F.when(F.element_at("metadata", "ocr_enabled") == "true", 1.0).otherwise(0.0),
        F.when(F.col("okf_stale_after") < now, 1.0).otherwise(0.0),
        F.round(0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), days / 365.0)), 9),
    ]
    priority = F.round(sum((F.coalesce(f, F.lit(0.0)) for f in factors), F.lit(0.0)), 9)
    out = docs.select("canon_id", "source_sha256", priority.alias("priority"))
    return out if limit is None else out.orderBy(F.desc("priority"), "source_sha256", "canon_id").limit(limit)


def queue_states(events: DataFrame) -> DataFrame:
    """The state of each item by its last event (item, ts, state)."""
    return events.groupBy("item").agg(F.max_by("state", "ts").alias("state"), F.max("ts").alias("since"))


def health(n_concepts: DataFrame, errors: DataFrame) -> DataFrame:
    """total, errors, score; half a point rounds to the even number, and many errors make it negative."""
    return n_concepts.crossJoin(F.broadcast(errors)).select("total", "errors", F.when(F.col("total") == 0, F.lit(100)).otherwise(F.bround(100.0 * (F.col("total") - F.col("errors")) / F.col("total"))).cast("bigint").alias("score"))


def secrets(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ordinal, value_sha256 of every secret."""
    return df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit("(" + SECRET + ")"), F.lit(1))).alias("ordinal", "value")).select(key, (F.col("ordinal") + 1).alias("ordinal"), F.sha2("value", 256).alias("value_sha256"))


def without_secrets(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "[REDACTED]")


def trust_badge(verified: Column, status: Column, stale_after: Column, today: str) -> Column:
    base = F.when(verified.startswith("human:") & (verified != "human:pending"), "human-reviewed").when(verified.startswith("process:"), "machine-confirmed").otherwise("unverified")
    return F.when(status == "deprecated", "deprecated").when(stale_after <= today, "stale").otherwise(base)


def lint_all(docs: DataFrame, path: str = "source_relpath") -> DataFrame:
    """canon_id, severity, rule: concept rules below an ``okf`` folder, Markdown rules below ``_md``, both elsewhere."""
    parts = F.split(F.coalesce(F.col(path), F.lit("")), "/")
    only_concept, only_markdown = F.array_contains(parts, "okf"), F.array_contains(parts, "_md")
    concept = concept_lint(docs.where(~only_markdown | only_concept))
    markdown = markdown_lint(docs.where(~only_concept & F.col("body_md").isNotNull())).select("canon_id", F.lit("warning").alias("severity"), "rule")
    return concept.unionByName(markdown)
