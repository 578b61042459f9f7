"""Text cleanup in stages. Each stage is a column expression, or an Arrow UDF where the JVM has no counterpart."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sheafline.functions.text import LIGATURES, QUOTES, replace_all

#: lines that keep their breaks (fixed pattern)
_STRUCTURE = re.compile(r"^\s*(?:#{1,6}\s|>\s|[-*+]\s|\d+\.\s|\||```)")


def compose(text: str) -> str:
    return unicodedata.normalize("NFC", text)


def unescape(text: str) -> str:
    """Entities decoded until nothing changes, at most five times."""
    for _ in range(5):
        plain = html.unescape(text)
        if plain == text:
            break
        text = plain
    return text


def rejoin(text: str) -> str:
    """Hard-wrapped paragraph lines joined; structural and blank lines end a paragraph."""
    out: list[str] = []
    wrapped: list[str] = []
    for line in [*text.split("\n"), None]:
        if line is None or not line.strip() or _STRUCTURE.match(line):
            if wrapped:
                out.append(" ".join(wrapped))
                wrapped = []
            if line is not None:
                out.append(line)
        else:
            wrapped.append(line.strip() if wrapped else line.rstrip())
    return "\n".join(out)


def drop_opening_contents(text: str) -> str:
    """The opening lines go where their plain ones reappear one after the other further down."""
    lines = text.split("\n")
    at = [n for n, x in enumerate(lines) if x.strip()][:4]
    plain = [lines[n].strip() for n in at if not lines[n].lstrip().startswith("#")]
    if len(plain) < 2 or len(at) < 2:
        return text
    later = [x.strip() for x in lines[at[-1] + 1 :] if x.strip()]
    k = len(plain)
    if any(later[i : i + k] == plain for i in range(len(later) - k + 1)):
        gone = set(at)
        return "\n".join(x for n, x in enumerate(lines) if n not in gone)
    return text


def level_headings(text: str) -> str:
    """The first heading becomes level 1, no level is skipped after it."""
    out, last, fenced = [], 0, False
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"^(#{1,6})(\s+.*)$", line)
        if m:
            last = 1 if last == 0 else min(len(m.group(1)), last + 1)
            line = "#" * last + m.group(2)
        out.append(line)
    return "\n".join(out)


def _by_row(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """An Arrow UDF over f, made when it is used (workers import this module without a session)."""

    def series(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    series.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return lambda c: F.pandas_udf(series, StringType())(c)


def blank_repeats(text: str) -> str:
    """Lines of 8 to 120 characters that occur at least twice become blank."""
    lines = text.split("\n")
    counts = Counter(x for x in lines if 8 <= len(x) <= 120)
    again = {x for x, n in counts.items() if n >= 2}
    return "\n".join("" if x.strip(" ") in again else x for x in lines) if again else text


STAGES: dict[str, Callable[[Column], Column]] = {
    "compose": lambda c: F.replace(F.replace(_by_row(compose)(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")),
    "soft_hyphens": lambda c: F.replace(c, F.lit("­"), F.lit("")),
    "ligatures": lambda c: replace_all(c, LIGATURES),
    "quotes": lambda c: replace_all(c, QUOTES),
    "entities": _by_row(unescape),
    "spaces": lambda c: F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n"),
    "hyphens": lambda c: F.regexp_replace(c, "([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])", "$1$2"),
    "wraps": _by_row(rejoin),
    "orphans": lambda c: F.regexp_replace(c, "(?dm)^[ \\t]*[|>+\\-=*#~]{1,3}[ \\t]*$", ""),
    "bylines": _by_row(blank_repeats),
    "contents": _by_row(drop_opening_contents),
    "headings": _by_row(level_headings),
}


def clean(c: Column, stages: Sequence[str] | None = None) -> Column:
    """The stages in their order, or those named; an unknown name is a KeyError."""
    for name in STAGES if stages is None else stages:
        c = STAGES[name](c)
    return c
