"""A small SELECT language over the catalogue, parsed on the driver into one DataFrame plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SELECT = re.compile(r"^\s*SELECT\s+(?P<cols>.+?)\s+FROM\s+(?P<table>concepts|links)(?:\s+WHERE\s+(?P<where>.+?))?\s*;?\s*$", re.I | re.S)
_WHERE = re.compile(r"^(?P<field>\w+)\s*(?P<op>!=|=|LIKE\b|IN\b)\s*(?P<value>.+)$", re.I | re.S)


class MiniSqlError(ValueError):
    """The statement has another form."""


def run(sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One predicate at most: =, !=, LIKE (a regular expression, case-insensitive), IN. What isn't understood after WHERE is
    ignored; unknown columns are null."""
    m = _SELECT.match(sql)
    if not m:
        raise MiniSqlError("expected: SELECT columns FROM concepts|links [WHERE field op value]")
    df = tables[m.group("table").lower()]
    cond = _WHERE.match(m.group("where").strip()) if m.group("where") else None
    if cond:
        name = cond.group("field").lower()
        field = F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")
        op, value = cond.group("op").upper(), cond.group("value").strip()
        plain = value.strip("'\"")
        if op == "=":
            df = df.where(field == plain)
        elif op == "!=":
            df = df.where(field != plain)
        elif op == "LIKE":
            df = df.where(field.rlike("(?i)" + plain))
        else:
            df = df.where(field.isin(*[x.strip().strip("'\"") for x in value.strip("()").split(",")]))
    cols = df.columns if m.group("cols").strip() == "*" else [c.strip() for c in m.group("cols").split(",")]
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols])
