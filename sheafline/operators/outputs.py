"""What a run leaves behind: plain Markdown, table sidecars, the log entry, manifests, JSON lines, safe fixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.operators.emit import frontmatter
from sheafline.session import cut

TTL_DAYS = 180


def description(relpath: Column, engine: Column) -> Column:
    return F.format_string("Document derived from %s via %s.", relpath, engine)


def stale_after(now: Column, days: int = TTL_DAYS) -> Column:
    return F.date_format(F.date_add(now, days), "yyyy-MM-dd")


def timestamp(text: Column) -> Column:
    """A strict ISO time in UTC (``2025-01-31T10:00:00Z``); null for anything else."""
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def plain_files(docs: DataFrame) -> DataFrame:
    """path (the source path with .md appended), text: frontmatter of the source's facts and the body."""
    fields = {"title": F.col("title"), "source": F.col("source_relpath"), "format": F.col("source_format"), "engine": F.col("engine"), "sha256": F.col("source_sha256"), "generated_at": F.date_format("converted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")}
    body = F.concat(F.regexp_replace(F.coalesce("body_md", F.lit("")), "\\s+$", ""), F.lit("\n"))
    return docs.where("source_relpath is not null").select(F.concat("source_relpath", F.lit(".md")).alias("path"), F.concat(frontmatter(fields), body).alias("text"))


def table_sidecars(cells: DataFrame, key: str) -> DataFrame:
    """key, n_rows, csv, json of each document's table cells (key, row, col, value): header row first, then objects a row."""
    quoted = F.when(F.col("value").rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col("value"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("value"))
    lines = cells.withColumn("q", quoted).groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", "value", "q"))).alias("cs"))
    tables = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("row", "cs"))).alias("rs"))  # the rows of one document
    csv = F.concat(F.array_join(F.transform("rs", lambda r: F.array_join(F.transform(r["cs"], lambda c: c["q"]), ",")), "\n"), F.lit("\n"))
    header = F.transform(F.get("rs", F.lit(0))["cs"], lambda c: c["value"])
    objects = F.transform(F.slice("rs", 2, F.greatest(F.size("rs") - 1, F.lit(0))), lambda r: F.map_from_entries(F.zip_with(header, F.transform(r["cs"], lambda c: c["value"]), lambda h, v: F.struct(F.coalesce(h, F.lit("")).alias("k"), v.alias("v")))))
    return tables.select(key, (F.size("rs") - 1).alias("n_rows"), csv.alias("csv"), F.to_json(objects).alias("json"))


def log_entry(runs: DataFrame) -> DataFrame:
    """run_no, entry: the Markdown section a run adds to the bundle's log; errors in path order."""
    counts = runs.groupBy("run_no", F.coalesce("engine", F.lit("no-adapter")).alias("engine"), F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))
    per = counts.groupBy("run_no", "engine").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["status"])), ", ").alias("bits"), F.sum("n").alias("n"))
    summary = per.groupBy("run_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("engine", "bits"))), lambda x: F.concat(F.lit("  - `"), x["engine"], F.lit("`: "), x["bits"])), "\n").alias("summary"), F.sum("n").alias("total"))
    failed = runs.where("status = 'failed' and error_text is not null and error_text <> ''").groupBy("run_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("relpath", "error_text"))), lambda x: F.concat(F.lit("  - "), F.coalesce(x["relpath"], F.lit("")), F.lit(": "), x["error_text"])), "\n").alias("errors"))  # of one run
    entry = F.concat(F.lit("- Total: "), F.col("total").cast("string"), F.lit(" files\n\n### Per-engine\n\n"), "summary", F.lit("\n"), F.when(F.col("errors").isNull(), "").otherwise(F.concat(F.lit("\n### Errors\n\n"), "errors", F.lit("\n"))))
    return summary.join(failed, "run_no", "left").select("run_no", entry.alias("entry"))


def manifest_lines(runs: DataFrame) -> DataFrame:
    """relpath, line: one JSON object a result, keys in a fixed order, nulls kept out."""
    return runs.select("relpath", F.to_json(F.struct("run_no", "relpath", "engine", "status", "sha256", F.col("error_text").alias("error"))).alias("line"))


def append_lines(lines: DataFrame, folder: str, batch: str) -> DataFrame:
    """Adds a batch of lines to a manifest folder once: a batch written before is overwritten by itself, never doubled."""
    lines.select("line").write.mode("overwrite").text(f"{folder}/batch={batch}")
    return lines.sparkSession.read.text(folder)


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """id, line: the export of chunks as JSON lines."""
    return chunks.select("id", F.to_json(F.struct("id", "concept_id", "source_sha256", "ordinal", "heading_path", "text", "citation", "token_estimate")).alias("line"))


def safe_fixes(docs: DataFrame, now: str) -> DataFrame:
    """canon_id, target, additions, status, verified, stale_after: what can be filled in without inventing anything.

    A concept without a type or a source is left to people. Targets are file names alone: of several with one name the
    last by path stays, as each would overwrite the one before.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    added = F.array_compact(F.array(F.when(empty("okf_status"), F.lit("+status")), F.when(empty("okf_verified"), F.lit("+verified")), F.when(empty("okf_stale_after"), F.lit("+stale_after"))))
    name = F.regexp_extract(F.regexp_replace("source_relpath", "\\.[^./]+$", ".md"), "([^/]+)$", 1)
    rows = docs.where(~empty("okf_type") & ~empty("source_uri") & F.col("source_relpath").isNotNull()).select("canon_id", "source_relpath", name.alias("target"), F.array_join(added, "; ").alias("additions"), F.when(empty("okf_status"), "unverified").otherwise(F.col("okf_status")).alias("status"), F.when(empty("okf_verified"), "human:pending").otherwise(F.col("okf_verified")).alias("verified"), F.when(empty("okf_stale_after"), stale_after(F.to_date(F.lit(now)))).otherwise(F.col("okf_stale_after")).alias("stale_after"))
    last = rows.where("additions <> '' and target <> 'index.md'").groupBy("target").agg(F.max(F.struct("source_relpath", "canon_id", "additions", "status", "verified", "stale_after")).alias("r"))
    return last.select("r.canon_id", "target", "r.additions", "r.status", "r.verified", "r.stale_after")


def rendered_same(left: Column, right: Column) -> Column:
    """Do two renderings have the same headings, in order? (the check of a rendered page)"""
    heads = lambda c: F.transform(F.regexp_extract_all(c, F.lit("(?m)^#{1,6}\\s+(.+?)\\s*$"), F.lit(1)), lambda x: F.lower(x))
    return heads(left) == heads(right)


def refreshed(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: how many there were and are, and what a snapshot's refresh added, removed and changed."""
    a, b = before.select(key, F.col(digest).alias("old")), after.select(key, F.col(digest).alias("new"))
    j = a.withColumn("was", F.lit(True)).join(b.withColumn("now", F.lit(True)), key, "full_outer")
    was, now = F.coalesce("was", F.lit(False)), F.coalesce("now", F.lit(False))
    return j.agg(F.count_if(was).alias("n_before"), F.count_if(now).alias("n_after"), F.count_if(~was & now).alias("n_added"), F.count_if(was & ~now).alias("n_removed"), F.count_if(was & now & ~F.col("old").eqNullSafe(F.col("new"))).alias("n_changed"))


def walk_manifest(files: DataFrame, engines: DataFrame) -> DataFrame:
    """relpath, engine, supported: every file with the engine of its suffix (the least priority number, then the name).

    ``engines``: engine, extensions, priority, as many rows as there are engines.
    """
    per = engines.select("engine", "priority", F.explode("extensions").alias("ext")).groupBy("ext").agg(F.min(F.struct("priority", "engine")).alias("e"))
    ext = F.lower(F.regexp_extract("relpath", "(\\.[^./]+)$", 1))
    return files.select("relpath", ext.alias("ext")).join(F.broadcast(per), "ext", "left").select("relpath", F.col("e.engine").alias("engine"), F.col("e").isNotNull().alias("supported"))


def index_pages(concepts: DataFrame, key: str = "concept_id") -> DataFrame:
    """dir, page: the Markdown index of each directory, a line a concept by name, with its title and words."""
    name = F.regexp_extract(key, "([^/]+)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(key, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    words = F.size(F.filter(F.split(F.coalesce("body_md", F.lit("")), " "), lambda w: w != ""))
    rows = concepts.select(folder.alias("dir"), F.struct(name.alias("name"), F.concat(F.lit("- ["), name, F.lit("]("), name, F.lit(") — "), F.coalesce("title", F.lit("(untitled)")), F.lit(" ("), words.cast("string"), F.lit(" words)")).alias("line")).alias("r"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")  # the concepts of one directory
    return rows.groupBy("dir").agg(F.concat(F.lit("# Index\n\n"), lines, F.lit("\n")).alias("page"))


def numbered_within(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds n, the row's number within its group (from 1): a range partitioning and offsets, so a group of any size is many tasks."""
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, group, order).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy(group, "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most `parts` rows a group
    own = F.row_number().over(Window.partitionBy(group, "part").orderBy(order))
    return ranged.withColumn("own", own).join(before.select(group, "part", "before"), [group, "part"]).withColumn("n", F.col("before") + F.col("own")).drop("part", "own", "before")


def message_paths(docs: DataFrame, source: str = "source_sha256", key: str = "canon_id") -> DataFrame:
    """key, path: ``<stem>-0001.md`` and so on for the messages of one mailbox file, in key order."""
    rows = docs.where(F.col(source).isNotNull() & F.col("source_relpath").isNotNull()).select(key, source, "source_relpath")
    stem = F.regexp_replace(F.regexp_replace("source_relpath", "\\.[^./]+$", ""), "-\\d{4}$", "")
    return numbered_within(rows, source, key).select(key, F.format_string("%s-%04d.md", stem, "n").alias("path"))


def progress_events(runs: DataFrame) -> DataFrame:
    """run_no, event, relpath, status: a start and a finish a run and a row a file between them."""
    ends = runs.select("run_no").distinct().select("run_no", F.explode(F.array(F.lit("start"), F.lit("finish"))).alias("event"), F.lit(None).cast("string").alias("relpath"), F.lit(None).cast("string").alias("status"))
    return ends.unionByName(runs.select("run_no", F.lit("file").alias("event"), "relpath", "status"))


def catalog_nodes(concepts: DataFrame, longest: int = 8000) -> DataFrame:
    """id, type, title, group, size, status, body: what a viewer shows of a concept; the group is the first folder."""
    group = F.when(F.col("concept_id").contains("/"), F.substring_index("concept_id", "/", 1)).otherwise("(root)")
    size = F.greatest(F.lit(24), F.least(F.lit(70), 24 + F.floor(F.length(F.coalesce("body_md", F.lit(""))) / 200)))
    return concepts.select(F.col("concept_id").alias("id"), F.coalesce("okf_type", F.lit("Unknown")).alias("type"), F.coalesce("title", F.col("concept_id")).alias("title"), group.alias("group"), size.cast("bigint").alias("size"), "okf_status", F.substring(F.coalesce("body_md", F.lit("")), 1, longest).alias("body"))
