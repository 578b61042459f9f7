"""Snippets: the window of 16 tokens with the most distinct matches, matches in brackets."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW = 16


def _fold(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def snippet(text: str, wanted: frozenset[str], size: int = WINDOW) -> str:
    tokens = list(re.finditer(r"[^\W_]+", text))
    hits = [_fold(m.group()) if _fold(m.group()) in wanted else None for m in tokens]
    if not tokens:
        return ""
    best = max(range(max(1, len(tokens) - size + 1)), key=lambda i: (len({h for h in hits[i : i + size] if h}), sum(h is not None for h in hits[i : i + size]), -i))
    part = tokens[best : best + size]
    out, at = "", part[0].start()
    for m, h in zip(part, hits[best : best + size], strict=True):
        out += text[at : m.start()] + (f"[{m.group()}]" if h else m.group())
        at = m.end()
    return ("…" if best else "") + " ".join(out.split()) + ("…" if best + size < len(tokens) else "")


def snippets(text: Column, words: list[str], size: int = WINDOW) -> Column:
    wanted = frozenset(map(_fold, words))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, wanted, size), na_action="ignore")

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())(text)
