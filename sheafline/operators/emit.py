"""Sinks: Markdown with frontmatter, JSON lines, directory indexes, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import concept_path, path_tags


def rendered(elements: Column) -> Column:
    """Elements (ordinal, kind, text) as Markdown."""
    one = lambda e: F.when(e["kind"] == "heading", F.concat(F.lit("# "), e["text"])).when(e["kind"] == "quote", F.concat(F.lit("> "), e["text"])).when(e["kind"] == "code", F.concat(F.lit("```\n"), e["text"], F.lit("\n```"))).otherwise(e["text"])
    return F.array_join(F.transform(F.array_sort(elements), one), "\n\n")


def _yaml(value: Column) -> Column:
    """A scalar, quoted where YAML would read it as something else."""
    risky = value.rlike("^[\\s\\-?:,\\[\\]{}#&*!|>'\"%@`]|: | #|[\\s:]$|^(?i)(true|false|null|yes|no|on|off|~)$|^[0-9.+-]")
    return F.when(value.isNull(), F.lit("null")).when(risky | (value == ""), F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))).otherwise(value)


def frontmatter(fields: dict[str, Column]) -> Column:
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), _yaml(v)) for k, v in fields.items()]), F.lit("\n---\n\n"))


def concept_files(docs: DataFrame) -> DataFrame:
    """path, text of every concept file."""
    fields = {"type": F.col("okf_type"), "title": F.col("title"), "status": F.col("okf_status"), "generated": F.col("okf_generated"), "verified": F.col("okf_verified"), "stale_after": F.col("okf_stale_after"), "tags": F.concat(F.lit("tags-"), F.array_join(path_tags(F.col("source_relpath")), "-")), "resource": F.col("source_uri"), "sha256": F.col("source_sha256")}
    return docs.where("source_relpath is not null").select(concept_path(F.col("source_relpath")).alias("path"), F.concat(frontmatter(fields), F.regexp_replace(F.coalesce("body_md", F.lit("")), "\\s+$", ""), F.lit("\n")).alias("text"))


def write_files(files: DataFrame, root: str) -> None:
    """Writes path, text as files below a shared folder, each through a temporary name."""

    def save(rows) -> None:
        import os
        import tempfile

        for row in rows:
            target = os.path.join(root, *[p for p in row.path.split("/") if p not in ("", "..", ".")])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            handle, name = tempfile.mkstemp(dir=os.path.dirname(target))
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                f.write(row.text)
            os.replace(name, target)

    files.foreachPartition(save)


def webhook_payload(results: DataFrame) -> DataFrame:
    """One row: the status summary as JSON."""
    s = results.groupBy("status").agg(F.count("*").alias("n"))
    return s.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("payload"))


def safe_json(c: Column) -> Column:
    """JSON that can stand in a script element."""
    return F.replace(F.to_json(c), F.lit("<"), F.lit("\\u003c"))


def wiki_fields(docs: DataFrame) -> DataFrame:
    """Flat extra fields for note-taking vaults; colons are not allowed in their values."""
    plain = lambda c: F.replace(F.col(c), F.lit(":"), F.lit("_"))
    return docs.select("canon_id", plain("source_uri").alias("source"), F.col("source_sha256").alias("sha256"), plain("okf_generated").alias("generated_by"), plain("okf_verified").alias("verified_by"), F.col("okf_stale_after").alias("stale_on"))
