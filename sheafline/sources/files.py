"""Folder scans, bundle scans and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheafline.functions.text import glob_regex

#: folders a walk leaves out (fixed values)
SKIPPED = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".idea")
RESERVED = ("index.md", "log.md", "REPORT.md")


def walk(spark: SparkSession, root: str, include: str | None = None, exclude: str | None = None, output: str | None = None) -> DataFrame:
    """relpath, size_bytes, sha256, content of the files under a folder; hidden ones, skipped folders and the output left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), "^[a-z]+:/*" + root.strip("/").replace(".", "\\.") + "/?", "")
    df = files.select(rel.alias("relpath"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content", F.col("modificationTime").alias("modified_at"))
    names = "|".join(x.replace(".", "\\.") for x in SKIPPED)
    df = df.where(~F.col("relpath").rlike(f"(^|/)(\\.[^/]*|{names})(/|$)"))
    base = F.regexp_extract("relpath", "([^/]+)$", 1)
    if include:
        df = df.where(base.rlike(glob_regex(include)))
    if exclude:
        df = df.where(~base.rlike(glob_regex(exclude)))
    if output:
        df = df.where(~F.col("relpath").startswith(output.strip("/") + "/"))
    return df


def bundle(spark: SparkSession, root: str) -> DataFrame:
    """concept_id, type, title, status, body of the Markdown files that have a frontmatter with a type."""
    df = walk(spark, root, "*.md").where(~F.regexp_extract("relpath", "([^/]+)$", 1).isin(*RESERVED))
    text = F.replace(F.decode("content", "UTF-8"), F.lit("\r\n"), F.lit("\n"))
    front = F.regexp_extract(text, "(?s)\\A---\\s*\\n(.*?)\\n---\\s*\\n", 1)
    field = lambda n: F.nullif(F.trim(F.regexp_extract(front, f"(?m)^{n}:[ ]*[\"']?(.*?)[\"']?[ ]*$", 1)), F.lit(""))
    out = df.withColumn("front", front).select(F.col("relpath").alias("concept_id"), field("type").alias("type"), field("title").alias("title"), field("status").alias("status"), field("stale_after").alias("stale_after"), F.regexp_replace(text, "(?s)\\A---\\s*\\n.*?\\n---\\s*\\n", "").alias("body"))
    return out.where("type is not null")


CHUNK = "id string, concept_id string, source_sha256 string, element_ids array<string>, ordinal int, heading_path array<string>, text string, citation struct<source_uri:string,source_sha256:string,page:int,start_char:int,end_char:int>, token_estimate int, _bad string"


def chunk_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Chunks from JSON lines; with ``strict``, a broken line ends the read."""
    r = spark.read.schema(StructType.fromDDL(CHUNK)).option("columnNameOfCorruptRecord", "_bad")
    return (r.option("mode", "FAILFAST") if strict else r.option("mode", "PERMISSIVE")).json(path)


def manifest_cache(spark: SparkSession, path: str) -> DataFrame:
    """relpath, sha256 of the files an earlier run converted."""
    return spark.read.json(path).select(F.explode("results").alias("r")).where("r.status = 'ok' and r.sha256 is not null").select("r.relpath", "r.sha256")
