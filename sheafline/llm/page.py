"""Main text of web pages: subtrees that recur over a host's pages are its template.

A page's Markdown is a tree: the part ahead of the title, sections under headings, the part below a closing rule; in them blocks
between blank lines, labels with the block under them, lines (list items, link rows). Each line and each subtree gets a hash of
its normal form, a link row also one with the link's text taken out, a larger subtree one of its label and its children's
kinds. Spark counts in how many pages of a host (and of all hosts, for hosts of few pages) each hash occurs; what recurs is
template, and without a template hash nothing of a page goes. Template subtrees go with all they hold: a label goes with the
list under it, a link row with its block, a cookie sentence with its buttons. Headings of the article, its sentences,
sentence lists, tables, date line and the links under a section heading stay, even where pages share them.

Counting is a two-step aggregation (page, then host), so a host with a third of all pages is pre-aggregated before the
shuffle; hits are joined back on salted keys.

Edge cases: null bodies, other formats and pages of unknown host (counted under the empty host) are handled; a null
source_format is read from the path's suffix; an empty page has no lines; rows given twice yield their lines once; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.session import cut, spread

#: a subtree is template from so many pages of its host, or of all hosts
MIN_PAGES = 3
MIN_PAGES_ALL = 6
SALTS = 16

_LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")
_LINK_ROW = re.compile(r"^(?:[-*+] )?\[[^\]]*\]\([^)]*\)(?: \([^)]*\))?$")
_HEAD = re.compile(r"^#{1,2} ")
_LABEL_MARK = re.compile(r"^#{3,6} |^\*\*|\*\*$")
_END = (".", "!", "?", "…", "。", ":", ";", '."', ".”", "?”", ".)", ".»", ".“")
_DIGIT = re.compile(r"\d")
_RULE = re.compile(r"[-*_]{3,}")
_NO_PLAIN = re.compile("[^a-z0-9\x01]+")


def source_format(fmt: str = "source_format", relpath: str = "source_relpath") -> Column:
    """The format, or the path's suffix where it is null."""
    return F.coalesce(F.lower(F.col(fmt)), F.nullif(F.lower(F.regexp_extract(F.col(relpath), r"(\.[A-Za-z0-9]+)$", 1)), F.lit("")))


def host_of(uri: str = "source_uri") -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(uri)), r"^[a-z]+://([^/]+)/", 1), F.lit(""))


def is_sentence(line: str) -> bool:
    body = line.lstrip("-*+> ").strip()
    if not body.endswith(_END):
        return False
    return len(body.split()) >= 4 or len(body) > 24 or any(ord(c) > 0x3000 for c in body)


def keys(line: str, title: str) -> list[str]:
    """Normal forms of a line: the exact one, and that of a link row without its text."""
    text = " ".join(_LABEL_MARK.sub("", line.strip()).split()).lower()
    if title and len(title) > 5 and title in text and text != title:
        text = text.replace(title, "\x01")
    plain = _NO_PLAIN.sub(" ", text).strip()  # the same for any wrong decoding of what is beyond ASCII
    out = [plain if len(plain) >= 4 else text]
    if _LINK_ROW.match(line.strip()):
        target = _DIGIT.sub("0", _LINK.search(line).group(2))
        out.append("\x02" + re.sub("0+", "0", target))
    return out


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key) - (1 << 63)


def blocks_of(lines: list[str]) -> list[list[int]]:
    """Line numbers of the blocks between blank lines; a heading is a block of its own."""
    out: list[list[int]] = [[]]
    for n, x in enumerate(lines):
        if not x:
            out.append([])
        elif _HEAD.match(x) or n and _HEAD.match(lines[n - 1]):
            out.append([n])
        else:
            out[-1].append(n)
    return [b for b in out if b]


def subtrees(lines: list[str], title: str) -> tuple[list[list[int]], list[list[int]]]:
    """Per line the hashes of the line itself (exact, and as a link row), and of the subtrees it is in: its block, the label
    with the block under it, and the whole part ahead of the title or below a rule.

    A block's hash is made of its lines' normal forms; that of a larger subtree of its blocks' shapes (link rows and labels as
    they stand, other lines by kind), so that a list of changing links under a known label is one subtree on every page.
    """
    own = [[digest(k) for k in keys(x, title)] if x else [] for x in lines]
    held: list[list[int]] = [[] for _ in lines]
    blocks = blocks_of(lines)

    def kind(n: int) -> str:
        x = lines[n]
        return "link" if _LINK_ROW.match(x) else "#" if _HEAD.match(x) else "text" if is_sentence(x) else "-" if x[0] in "-*+" else "|" if x.startswith("|") else "line"

    def add(key: str, ns: list[int]) -> None:
        h = digest(key)
        for n in ns:
            held[n].append(h)

    for k, block in enumerate(blocks):
        if len(block) > 1:
            add("\x03" + "\n".join(keys(lines[n], title)[0] for n in block), block)
        first = keys(lines[block[0]], title)[0]
        under = block[1:] if len(block) > 1 else blocks[k + 1] if k + 1 < len(blocks) else []
        if under and not is_sentence(lines[block[0]]) and not _HEAD.match(lines[block[0]]) and not _LINK_ROW.match(lines[block[0]]):
            add("\x04" + first + "\n" + ",".join(sorted({kind(n) for n in under})), [block[0], *under])
    head = next((n for n, x in enumerate(lines) if x.startswith("# ")), 0)
    top = [n for n in range(head) if lines[n]]
    if top:
        add("\x05" + ",".join(sorted({kind(n) for n in top})), top)
    rule = next((n for n in range(len(lines) - 1, head, -1) if _RULE.fullmatch(lines[n])), None)
    if rule is not None and not any(_HEAD.match(lines[n]) for n in range(rule, len(lines))):
        tail = [n for n in range(rule, len(lines)) if lines[n]]
        add("\x06" + ",".join(sorted({kind(n) for n in tail})), tail)
    return own, held


def page_hashes(body: str, title: str | None) -> set[int]:
    """The hashes of a page's lines and subtrees."""
    own, held = subtrees([x.strip() for x in body.split("\n")], " ".join((title or "").split()).lower())
    return {h for hs in (*own, *held) for h in hs}


def furniture(body: str, title: str | None, template: set[int]) -> list[int]:
    """The lines to delete, given the hashes that are template: a page without template subtrees is left as it is."""
    if not template:
        return []
    lines = [x.strip() for x in body.split("\n")]
    own, held = subtrees(lines, " ".join((title or "").split()).lower())
    recurs = [bool(hs) and hs[0] in template for hs in own]
    link_recurs = [len(hs) > 1 and hs[1] in template for hs in own]
    within = [any(h in template for h in hs) for hs in held]
    head = next((n for n, x in enumerate(lines) if x.startswith("# ")), -1)
    out: list[int] = []
    before = ""  # what the block before was: title, section, text, label, template
    tail = False
    for block in blocks_of(lines):
        first = lines[block[0]]
        if _HEAD.match(first):
            before, tail = ("title" if first.startswith("# ") else "section"), False
            continue
        known = [recurs[n] or link_recurs[n] or within[n] for n in block]
        if block[0] < head:  # ahead of the title: header, menu, breadcrumb
            if any(known):
                out.extend(n for n in block if not (is_sentence(lines[n]) and not recurs[n] and len(block) == 1 and len(lines[n]) > 60))
            continue
        if all(lines[n].startswith("|") and lines[n].endswith("|") for n in block) or first.startswith("```"):
            before = "text"
            continue
        if before == "title" and len(block) == 1 and _DIGIT.search(first) and len(first.split()) <= 7 and "](" not in first and "|" not in first and "©" not in first:
            before = "date"
            continue
        sentences = [is_sentence(lines[n]) for n in block]
        if all(sentences) and not tail:
            before = "text"
            continue
        links = [bool(_LINK_ROW.match(lines[n])) for n in block]
        if all(links) and before in ("section", "text") and all(lines[n][0] in "-*+" for n in block) and not any(lines[n].endswith("(#)") for n in block):
            before = "text"
            continue
        marks = [n for k, n in enumerate(block) if known[k] and not sentences[k]]
        rule = any(_RULE.fullmatch(lines[n]) for n in block) and bool(marks)
        under_label = before == "label" and not any(sentences)  # goes with its label
        if marks or under_label or tail:
            out.extend(n for k, n in enumerate(block) if not sentences[k] or recurs[n] or under_label)
            before = "label" if len(block) == 1 and not tail and not rule else "template"
            tail = tail or rule
        else:
            before = "text"
    return sorted(set(out))


PAGE_COLUMNS = ["canon_id", "host", "title", "body_md"]


def pages(docs: DataFrame) -> DataFrame:
    return spread(docs).where(source_format().isin(".html", ".htm") & F.col("body_md").isNotNull() & F.col("canon_id").isNotNull()).select(F.col("canon_id").cast("bigint").alias("canon_id"), host_of().alias("host"), "title", "body_md")


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(c, h, x) for c, h, t, b in zip(*(batch[k] for k in PAGE_COLUMNS), strict=True) for x in page_hashes(b, t)]
        yield pd.DataFrame(rows, columns=["canon_id", "host", "hash"])


def template_hits(found_pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """canon_id, hashes: per page the hashes that are template on its host or everywhere."""
    # bodies are parsed once for all counts
    elements = cut(found_pages.mapInPandas(_emit, "canon_id bigint, host string, hash bigint").distinct())
    counts = elements.groupBy("host", "hash").agg(F.count("*").alias("n"))
    everywhere = counts.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES_ALL).select("hash")
    # one row a (host, hash), so that no page meets a hash twice; replicated over the salts of its pages
    template = counts.where(F.col("n") >= min_pages).select("host", "hash").unionByName(counts.select("host", "hash").join(everywhere, "hash", "left_semi")).distinct()
    salted = template.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = elements.withColumn("salt", F.pmod(F.hash("canon_id"), F.lit(SALTS))).join(salted, ["host", "hash", "salt"])
    return hits.groupBy("canon_id").agg(F.collect_set("hash").alias("hashes"))  # at most the elements of one page


def _decided(docs: DataFrame) -> DataFrame:
    found_pages = pages(docs)
    return found_pages.dropDuplicates(["canon_id"]).join(template_hits(found_pages), "canon_id", "left")


def furniture_lines(docs: DataFrame) -> DataFrame:
    """canon_id, line_no of each non-blank line that is no main text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, n) for c, t, b, hs in zip(batch["canon_id"], batch["title"], batch["body_md"], batch["hashes"], strict=True) for n in furniture(b, t, set() if hs is None else set(map(int, hs)))]
            yield pd.DataFrame(rows, columns=["canon_id", "line_no"])

    return _decided(docs).select("canon_id", "title", "body_md", "hashes").mapInPandas(run, "canon_id bigint, line_no int")


def main_text(docs: DataFrame) -> DataFrame:
    """canon_id, main_md, n_removed: the body without its furniture, blank runs closed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c, t, b, hs in zip(batch["canon_id"], batch["title"], batch["body_md"], batch["hashes"], strict=True):
                gone = set(furniture(b, t, set() if hs is None else set(map(int, hs))))
                kept = "\n".join(x for n, x in enumerate(b.split("\n")) if n not in gone)
                rows.append((c, re.sub(r"\n(?:[ \t\r]*\n){2,}", "\n\n", kept).strip(), len(gone)))
            yield pd.DataFrame(rows, columns=["canon_id", "main_md", "n_removed"])

    return _decided(docs).select("canon_id", "title", "body_md", "hashes").mapInPandas(run, "canon_id bigint, main_md string, n_removed int")


def host_report(docs: DataFrame) -> DataFrame:
    """Per host: pages, removed lines, share of characters kept."""
    kept = main_text(docs)
    own = pages(docs).dropDuplicates(["canon_id"]).select("canon_id", "host", F.length("body_md").alias("chars"))
    joined = own.join(kept.select("canon_id", F.length("main_md").alias("kept"), "n_removed"), "canon_id")
    return joined.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("n_removed").cast("bigint").alias("n_removed"), F.round(F.sum("kept") / F.sum("chars"), 6).alias("kept_share"))
