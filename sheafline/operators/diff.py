"""Differences of documents, element by element, and of tables, cell by cell."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: kinds of blocks and how they begin (fixed patterns)
_KINDS = (("heading", r"^#{1,6}\s"), ("table", r"^\|"), ("code", r"^```"), ("list", r"^(?:[-*+]\s|\d+\.\s)"), ("attachment_ref", r"^!?\[[^\]]*\]\([^)]+\)$"))


def typed_blocks(body: str) -> list[tuple[str, str]]:
    out = []
    for block in body.split("\n\n"):
        text = block.strip()
        if text:
            out.append((next((k for k, rx in _KINDS if re.match(rx, text)), "paragraph"), text))
    return out


def element_changes(left: str, right: str) -> list[tuple[str, str, str | None, str | None]]:
    """(status, kind, before, after): equal texts first, each with the first of its kind still free, the rest by likeness."""
    a, b = typed_blocks(left), typed_blocks(right)
    where: dict[tuple[str, str], deque[int]] = {}
    for j, block in enumerate(b):
        where.setdefault(block, deque()).append(j)
    free = dict.fromkeys(range(len(b)))  # in order
    out: list[tuple[str, str, str | None, str | None]] = []
    rest = []
    for i, (kind, text) in enumerate(a):
        places = where.get((kind, text))
        if places:
            j = places.popleft()
            del free[j]
            out.append(("unchanged" if j == i else "moved", kind, text, text))
        else:
            rest.append((kind, text))
    by_kind: dict[str, dict[int, None]] = {}
    for j in free:
        by_kind.setdefault(b[j][0], {})[j] = None
    for kind, text in rest:
        same = by_kind.get(kind)
        if same:
            j = max(same, key=lambda j: SequenceMatcher(None, text, b[j][1], autojunk=False).ratio())
            del same[j], free[j]
            out.append(("modified", kind, text, b[j][1]))
        else:
            out.append(("removed", kind, text, None))
    out += [("added", b[j][0], None, b[j][1]) for j in free]
    return sorted(out, key=lambda x: (x[0], x[1], x[2] or x[3] or ""))


def document_changes(pairs: DataFrame, key: str) -> DataFrame:
    """key, status, kind, before, after for (key, left, right)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, *c) for k, x, y in zip(batch[key], batch["left"], batch["right"], strict=True) for c in element_changes(x or "", y or "")], columns=["key", "status", "kind", "before", "after"])

    return pairs.select(F.col(key).cast("string").alias(key), "left", "right").mapInPandas(run, "key string, status string, kind string, before string, after string")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "removed", "modified", "moved", "unchanged")])


def cells(tables: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, col, value of Markdown tables; alignment rows take no number."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x).startswith("|") & ~F.trim(x).rlike("^\\|(?:\\s*:?-{3,}:?\\s*\\|)+$"))
    r = tables.select(key, F.posexplode(rows).alias("row", "line"))
    inner = F.split(F.regexp_replace(F.trim(F.col("line")), "^\\||\\|$", ""), "(?<!\\\\)\\|")
    return r.select(key, "row", F.posexplode(inner).alias("col", "raw")).select(key, "row", "col", F.trim("raw").alias("value"))


def cell_changes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    a, b = left.withColumnRenamed("value", "before"), right.withColumnRenamed("value", "after")
    return a.join(b, [key, "row", "col"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def frontmatter_changes(pairs: DataFrame, key: str, left: str = "left", right: str = "right") -> DataFrame:
    """key, field, before, after of every field that differs between two maps of fields; a missing field is null."""
    names = F.array_sort(F.array_distinct(F.concat(F.map_keys(left), F.map_keys(right))))
    rows = F.transform(names, lambda k: F.struct(k.alias("field"), F.try_element_at(F.col(left), k).alias("before"), F.try_element_at(F.col(right), k).alias("after")))
    return pairs.select(key, F.explode(F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"]))).alias("r")).select(key, "r.field", "r.before", "r.after")


def report(changes: DataFrame, key: str) -> DataFrame:
    """key, report: the counts by status and a table of the changes (kind, status, before, after) as Markdown."""
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    statuses = ("added", "removed", "modified", "moved", "unchanged")
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != "unchanged", F.struct("status", "kind", "before", "after")))), lambda r: F.concat(F.lit("| "), r["kind"], F.lit(" | "), r["status"], F.lit(" | "), cell(r["before"]), F.lit(" | "), cell(r["after"]), F.lit(" |")))
    g = changes.groupBy(key).agg(lines.alias("lines"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])  # the changes of one document
    counts = F.concat_ws("\n", *[F.concat(F.lit(f"| {s} | "), F.col(s).cast("string"), F.lit(" |")) for s in statuses])
    return g.select(key, F.concat(F.lit("| Status | Count |\n|---|---:|\n"), counts, F.lit("\n\n| Kind | Status | Left | Right |\n|---|---|---|---|\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("report"))
