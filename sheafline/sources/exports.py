"""Workspace exports: a zip of pages (Markdown), databases (CSV) and files, to pages, rows and attachments."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import slug

PAGE_SCHEMA = "archive string, path string, kind string, title string, properties map<string,string>, body string, n_rows int, size bigint"


def read_export(content: bytes) -> Iterator[tuple[str, str, str | None, dict[str, str], str | None, int, int]]:
    """(path, kind, title, properties, body, rows, size) of each member."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if info.is_dir() or ".." in info.filename.split("/") or info.filename.startswith("/"):
                continue
            name = info.filename
            if name.endswith(".md"):
                text = z.read(info).decode("utf-8", "replace").replace("\r\n", "\n")
                head = re.search(r"(?m)^# (.+)$", text)
                section = re.search(r"(?ms)^## Properties\s*\n(.*?)(?=^## |\Z)", text)
                properties = dict(re.findall(r"(?m)^[-* ]*\*\*(.+?):\*\* ?(.*)$", section.group(1))) if section else {}
                yield name, "page", head.group(1).strip() if head else name.rpartition("/")[2][:-3], properties, text, 0, info.file_size
            elif name.endswith(".csv"):
                rows = list(csv.reader(io.StringIO(z.read(info).decode("utf-8-sig", "replace"))))
                yield name, "database", name.rpartition("/")[2][:-4], {}, None, max(0, len(rows) - 1), info.file_size
            else:
                yield name, "file", None, {}, None, 0, info.file_size


def pages(files: DataFrame) -> DataFrame:
    """One row a member of each archive (relpath, content); broken archives give one row of kind ``broken``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["relpath"], batch["content"], strict=True):
                try:
                    rows += [(path, *m) for m in read_export(bytes(content or b""))]
                except zipfile.BadZipFile:
                    rows.append((path, "", "broken", None, {}, None, 0, 0))
            yield pd.DataFrame(rows, columns=["archive", "path", "kind", "title", "properties", "body", "n_rows", "size"])

    return files.select("relpath", "content").mapInPandas(run, PAGE_SCHEMA)


def target_names(members: DataFrame) -> DataFrame:
    """archive, path, target: slugs of the titles; the second of a name gets -1, and so on, in path order."""
    p = members.where("kind = 'page'").withColumn("slug", slug(F.lower("title")))
    n = F.row_number().over(Window.partitionBy("archive", "slug").orderBy("path")) - 1
    return p.withColumn("n", n).select("archive", "path", F.concat("slug", F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md")).alias("target"))


def summary(members: DataFrame) -> DataFrame:
    return members.groupBy("archive").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("page", "database", "file")])
