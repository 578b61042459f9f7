"""Column expressions for text: all stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: white space as Unicode and Python see it (fixed value)
SPACE = "[\\s\\x0B\\x1C-\\x1F\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
#: small letters with marks and their plain forms, by Unicode decomposition
MARKED = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.islower() and unicodedata.normalize("NFD", c) != c and unicodedata.normalize("NFD", c)[0].isascii())
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in MARKED)
# character replacements (fixed values)
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "\u00a0": " ", "\u2009": " ", "\u200a": " "}
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "--", "…": "..."}
LINK = "\\[[^\\]]+\\]\\(([^)]+)\\)"
ENTITY = "\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b"
SHA256 = "^[0-9a-f]{64}$"


def squeeze(c: Column) -> Column:
    """White-space runs to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, SPACE + "+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((word_count(c) + 3) / 4).cast("int"))


def joined_id(*parts: Column) -> Column:
    """SHA-256 over the parts with NUL between them."""
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def replace_all(c: Column, table: dict[str, str]) -> Column:
    for a, b in table.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def terms(c: Column) -> Column:
    """Search terms: lower case, marks off, split at whatever is no letter or digit."""
    return F.filter(F.split(F.translate(F.lower(c), MARKED, PLAIN), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def entities(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?U)" + ENTITY), F.lit(0)))


def links(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(LINK), F.lit(1))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "(\\.[^./]+)$", 1))


def concept_path(relpath: Column) -> Column:
    """The concept file of a source path: its suffix replaced."""
    return F.regexp_replace(relpath, "\\.[^./]+$", ".md")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def path_tags(relpath: Column) -> Column:
    """Parent directories and format in lower case; ``document`` where there is none."""
    dirs = F.filter(F.split(F.lower(directory(relpath)), "/"), lambda x: x != "")
    tags = F.array_distinct(F.concat(dirs, F.filter(F.array(F.regexp_replace(suffix(relpath), "^\\.", "")), lambda x: x != "")))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("document")))


def slug(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_"), "^[_.-]+|[_.-]+$", ""), 1, 80)


def percent(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit("0%")).otherwise(F.format_string("%.1f%%", 100.0 * n / d))


def description(body: Column) -> Column:
    """The first line that is no heading, fence or quotation, clipped to 120 characters."""
    first = F.element_at(F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^(#|```|>)")), 1)
    return F.when(F.length(first) > 120, F.concat(F.substring(first, 1, 117), F.lit("..."))).otherwise(first)


def table_cell(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\\r?\\n", " "))


def table_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda x: table_cell(x)), " | "), F.lit(" |"))


def glob_regex(pattern: str) -> str:
    """A file-name pattern as a Java regular expression over the whole name."""
    import re

    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif ch == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner.startswith("!") else inner) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def normal_path(path: Column) -> Column:
    """Resolves ``.`` and ``..`` segments."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def link_target(source: Column, target: Column) -> Column:
    """The bundle path a Markdown link points to, fragment dropped; null for outside links and empty targets."""
    plain = F.trim(F.substring_index(target, "#", 1))
    return F.when((plain == "") | plain.contains("://"), F.lit(None)).otherwise(normal_path(F.concat(F.when(plain.startswith("/"), F.lit("")).otherwise(F.concat(directory(source), F.lit("/"))), plain)))
