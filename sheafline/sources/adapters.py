"""Format adapters: bytes of one file to records of title, Markdown body, metadata and attachments.

An adapter is a function of (content, stem) that yields ``Record``s; mailboxes yield one per message. ``extract`` runs the first
adapter whose suffixes match over a binary-file DataFrame with mapInPandas; an adapter's failure is a row of status ``failed``.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import cut


class AdapterError(Exception):
    """The file can't be converted by this adapter."""


@dataclass
class Record:
    title: str | None
    body_md: str
    metadata: dict[str, str] = field(default_factory=dict)
    attachments: list[tuple[str, int]] = field(default_factory=list)


def decode(content: bytes) -> str:
    """UTF-8 (with or without mark), UTF-16 by mark, else Windows-1252."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return content.decode("utf-16", "replace")
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", "replace")


def txt(content: bytes, stem: str) -> Iterator[Record]:
    yield Record(stem, f"```text\n{decode(content).rstrip()}\n```\n")


_FRONT = re.compile(r"\A---\s*\n.*?\n---\s*\n", re.S)


def md(content: bytes, stem: str) -> Iterator[Record]:
    body = _FRONT.sub("", decode(content).replace("\r\n", "\n"), count=1)
    head = re.search(r"(?m)^#\s+(.+?)\s*$", body)
    yield Record(head.group(1) if head else stem, body)


class _Markdown(HTMLParser):
    """HTML to Markdown: ATX headings, dash lists, pipe tables, links, emphasis; page furniture elements are skipped."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "form"}
    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col", "area", "base", "embed", "track"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.pre = 0
        self.lists: list[list] = []
        self.hrefs: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.titles: dict[str, str] = {}
        self.path: list[str] = []
        self.catch: list[str] | None = None

    def _put(self, text: str) -> None:
        (self.cell if self.cell is not None else self.out).append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            self.path.append(tag)
        if tag in ("h1", "title") and self.catch is None:
            self.catch = []
        if tag in self.SKIP:
            self.skip += 1
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "main", "blockquote"):
            self._put("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "br":
            self._put("\n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self._put("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "pre":
            self.pre += 1
            self._put("\n\n```\n")
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href") or "")
            self._put("[")
        elif tag == "img":
            self._put(f"![{dict(attrs).get('alt') or ''}]({dict(attrs).get('src') or ''})")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("h1", "title") and self.catch is not None:
            where = "title" if tag == "title" else next((p for p in ("main", "article") if p in self.path), "h1")
            self.titles.setdefault(where, " ".join("".join(self.catch).split()))
            self.catch = None
        if tag in self.path:
            while self.path and self.path.pop() != tag:
                pass
        if tag in self.SKIP and self.skip:
            self.skip -= 1
            return
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag) or tag in ("p", "div", "blockquote"):
            self._put("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self._put("\n" if self.lists else "\n\n")
        elif tag in ("b", "strong"):
            self._put("**")
        elif tag in ("i", "em"):
            self._put("*")
        elif tag == "code" and not self.pre:
            self._put("`")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self._put("\n```\n\n")
        elif tag == "a":
            self._put(f"]({self.hrefs.pop() if self.hrefs else ''})")
        elif tag in ("td", "th") and self.cell is not None and self.rows:
            text, self.cell = " ".join("".join(self.cell).split()), None
            self.rows[-1].append(text)
        elif tag == "table" and self.rows is not None:
            rows, self.rows, self.cell = [r for r in self.rows if r], None, None
            if rows:
                self._put("\n\n" + pipe_table(rows[0], rows[1:]) + "\n\n")

    def handle_data(self, data: str) -> None:
        if self.catch is not None:
            self.catch.append(data)
        if self.skip or "head" in self.path and "body" not in self.path:
            return
        self._put(data if self.pre else re.sub(r"\s+", " ", data))


def pipe_table(header: list[str], rows: list[list[str]]) -> str:
    clean = lambda c: str(c).replace("|", "\\|").replace("\r\n", " ").replace("\n", " ").strip()
    fit = lambda r: (list(r) + [""] * len(header))[: len(header)]
    line = lambda r: "| " + " | ".join(map(clean, r)) + " |"
    return "\n".join([line(header), line(["---"] * len(header)), *[line(fit(r)) for r in rows]])


def html_to_markdown(text: str) -> tuple[str | None, str]:
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    body = "".join(parser.out)
    body = "\n".join(x.rstrip() if "```" in x else x.strip(" ") if not re.match(r" +(?:-|\d+\.) ", x) else x.rstrip() for x in body.split("\n"))
    body = re.sub(r"\n{3,}", "\n\n", body).strip()
    title = next((parser.titles[k] for k in ("main", "article", "h1", "title") if parser.titles.get(k)), None)
    return title, body + "\n" if body else ""


def html(content: bytes, stem: str) -> Iterator[Record]:
    title, body = html_to_markdown(decode(content))
    yield Record(title or stem, body)


def csv_table(content: bytes, stem: str) -> Iterator[Record]:
    text = decode(content)
    try:
        delimiter = csv.Sniffer().sniff(text[:65536], delimiters=",;\t|").delimiter
    except csv.Error:
        delimiter = ","
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    while rows and not any(c.strip() for c in rows[-1]):
        rows.pop()
    if not rows:
        yield Record(stem, "")
        return
    yield Record(stem, f"{pipe_table(rows[0], rows[1:])}\n\n_{len(rows) - 1} rows × {len(rows[0])} columns_\n", {"delimiter": delimiter})


def json_file(content: bytes, stem: str) -> Iterator[Record]:
    if len(content) > 50 * 2**20:
        raise AdapterError("JSON over 50 MiB")
    try:
        value = json.loads(decode(content))
    except ValueError as e:
        raise AdapterError(f"no JSON: {e}") from e
    title = stem
    head = ""
    if isinstance(value, dict):
        title = next((value[k] for k in ("title", "name", "label", "id") if isinstance(value.get(k), str)), stem)
        if value and all(not isinstance(v, (dict, list)) for v in value.values()):
            head = "\n".join(f"- **{k}**: {v}" for k, v in value.items()) + "\n\n"
    yield Record(title, f"{head}```json\n{json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)}\n```\n")


#: headers shown of a mail (fixed values)
_HEADERS = ("From", "To", "Cc", "Subject", "Date", "Message-ID", "Reply-To")


def _message(msg) -> Record:
    body = msg.get_body(preferencelist=("plain", "html"))
    text = ""
    if body is not None:
        try:
            text = body.get_content()
        except (LookupError, UnicodeDecodeError):
            text = (body.get_payload(decode=True) or b"").decode("utf-8", "replace")
        text = html_to_markdown(text)[1] if body.get_content_type() == "text/html" else f"```text\n{text.rstrip()}\n```"
    files = [(p.get_filename() or "attachment", len(p.get_payload(decode=True) or b""), p.get_content_type()) for p in msg.iter_attachments()]
    parts = ["## Headers\n", "\n".join(f"- **{h}**: {msg[h]}" for h in _HEADERS if msg[h]), "\n## Body\n", text.strip()]
    if files:
        parts += ["\n## Attachments\n", "\n".join(f"- `{n}` ({t}, {s:,} bytes)" for n, s, t in files)]
    return Record(str(msg["Subject"]) if msg["Subject"] else None, "\n".join(parts) + "\n", {"message_id": str(msg["Message-ID"] or "")}, [(n, s) for n, s, _ in files])


def eml(content: bytes, stem: str) -> Iterator[Record]:
    r = _message(email.message_from_bytes(content, policy=email.policy.default))
    r.title = r.title or stem
    yield r


def mbox(content: bytes, stem: str) -> Iterator[Record]:
    """The messages between "From " lines that follow a blank line (or stand first), read from memory."""
    starts = [m.start(1) for m in re.finditer(rb"(?:\A|\r?\n\r?\n|\A\r?\n)(From [^\r\n]*\r?\n)", content)]
    for n, (at, end) in enumerate(zip(starts, [*starts[1:], len(content)], strict=True), 1):
        raw = content[at:end].split(b"\n", 1)[1]
        r = _message(email.message_from_bytes(re.sub(rb"(?m)^>(>*From )", rb"\1", raw), policy=email.policy.default))
        r.title = f"{stem} — {r.title or '(no subject)'}"
        r.metadata["message_index"] = str(n)
        yield r


def rtf(content: bytes, stem: str) -> Iterator[Record]:
    """Control words out; escaped bytes and Unicode escapes decoded."""
    text = content.decode("latin-1")
    text = re.sub(r"\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|pict|generator)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m.group(1)) % 65536), text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m.group(1), 16)]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\(?:par|line|sect|page)d?\b ?", "\n", text)
    text = re.sub(r"\\[a-zA-Z]+-?\d* ?|\\[{}\\*~_-]|[{}]", lambda m: {"\\{": "{", "\\}": "}", "\\\\": "\\", "\\~": " "}.get(m.group(), ""), text)
    yield Record(stem, re.sub(r"\n{3,}", "\n\n", text).strip() + "\n")


def _zip(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise AdapterError(f"no archive: {e}") from e


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    try:
        raw = z.read(name)
    except KeyError as e:
        raise AdapterError(f"{name} is missing") from e
    if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw[:4096]:
        raise AdapterError(f"{name} declares entities")
    return ElementTree.fromstring(raw)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def epub(content: bytes, stem: str) -> Iterator[Record]:
    z = _zip(content)
    opf = next((n for n in z.namelist() if n.endswith(".opf")), None)
    if opf is None:
        raise AdapterError("no package file")
    root = _xml(z, opf)
    title = next((e.text for e in root.iter() if _local(e) == "title"), None)
    creator = next((e.text for e in root.iter() if _local(e) == "creator"), "")
    items = {e.get("id"): e.get("href") for e in root.iter() if _local(e) == "item"}
    order = [items.get(e.get("idref")) for e in root.iter() if _local(e) == "itemref"]
    base = opf.rpartition("/")[0]
    chapters = [html_to_markdown(decode(z.read(f"{base}/{h}".lstrip("/"))))[1].strip() for h in order if h and f"{base}/{h}".lstrip("/") in z.namelist()]
    yield Record(title or stem, "\n\n---\n\n".join(c for c in chapters if c) + "\n", {"creator": creator or ""})


def odf(content: bytes, stem: str) -> Iterator[Record]:
    root = _xml(_zip(content), "content.xml")
    parts: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        name = _local(e)
        if name == "table":
            rows = [[" ".join("".join(c.itertext()).split()) for c in r if _local(c) == "table-cell"] for r in e.iter() if _local(r) == "table-row"]
            rows = [r for r in rows if any(r)]
            if rows:
                parts.append(pipe_table(rows[0], rows[1:]))
        elif name == "h":
            level = next((int(v) for k, v in e.attrib.items() if k.endswith("outline-level")), 1)
            parts.append("#" * min(6, level) + " " + "".join(e.itertext()).strip())
        elif name == "p":
            text = "".join(e.itertext()).strip()
            if text:
                parts.append(text)
        else:
            for c in e:
                walk(c)

    walk(root)
    yield Record(stem, "\n\n".join(parts) + "\n")


def office(content: bytes, stem: str) -> Iterator[Record]:
    """Paragraphs, sheets or slides of the three XML office formats."""
    z = _zip(content)
    names = z.namelist()
    parts: list[str] = []
    if "word/document.xml" in names:
        for e in _xml(z, "word/document.xml").iter():
            if _local(e) == "tbl":
                rows = [[" ".join("".join(c.itertext()).split()) for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
                if rows:
                    parts.append(pipe_table(rows[0], rows[1:]))
            elif _local(e) == "p":
                text = "".join(t.text or "" for t in e.iter() if _local(t) == "t").strip()
                style = next((v for s in e.iter() if _local(s) == "pStyle" for k, v in s.attrib.items() if k.endswith("val")), "")
                level = re.fullmatch(r"Heading(\d)", style)
                if text:
                    parts.append("#" * int(level.group(1)) + " " + text if level else text)
    elif any(n.startswith("xl/worksheets/") for n in names):
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in names else []
        for n in sorted(x for x in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", x)):
            rows = []
            for r in (e for e in _xml(z, n).iter() if _local(e) == "row"):
                cells = []
                for c in r:
                    v = next((x.text or "" for x in c.iter() if _local(x) in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v.isdigit() and int(v) < len(shared) else v)
                rows.append(cells)
            if rows:
                parts.append(f"## {n.rpartition('/')[2][:-4]}\n\n" + pipe_table(rows[0], rows[1:]))
    elif any(n.startswith("ppt/slides/") for n in names):
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        for k, n in enumerate(slides, 1):
            texts = [t for p in _xml(z, n).iter() if _local(p) == "p" and (t := "".join(x.text or "" for x in p.iter() if _local(x) == "t").strip())]
            parts.append(f"## Slide {k}\n\n" + "\n\n".join(texts))
    else:
        raise AdapterError("no office document")
    yield Record(stem, "\n\n".join(parts) + "\n")


def pdf(content: bytes, stem: str) -> Iterator[Record]:
    """The text of each page under its heading; pages without a text layer are named in a note."""
    from sheafline.sources.pdf import PdfError, page_texts

    try:
        texts = page_texts(content)
    except PdfError as e:
        raise AdapterError(str(e)) from e
    parts = [f"## Page {n}\n\n{t}" for n, t in enumerate(texts, 1) if t]
    bare = [n for n, t in enumerate(texts, 1) if not t]
    if bare:
        named = ", ".join(map(str, bare[:5])) + ("…" if len(bare) > 5 else "")
        parts.append(f"> **Note:** {len(bare)} page(s) ({named}) have no extractable text layer.")
    yield Record(stem, "\n\n".join(parts) + "\n", {"image_only_pages": ",".join(map(str, bare))})


#: suffixes of the fallback engine that no engine of its own takes (fixed values)
FALLBACK = (".ipynb", ".latex", ".tex", ".rst", ".asciidoc", ".adoc", ".textile", ".mediawiki", ".wiki", ".org", ".dokuwiki", ".bbcode", ".fb2", ".mhtml", ".mht", ".web", ".openapi", ".yaml", ".yml", ".toml", ".ini", ".enex", ".xml", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".go", ".rs")


def fallback(content: bytes, stem: str) -> Iterator[Record]:
    """Notebooks by cell, MIME pages by their parts, XML by its text, everything else as it stands."""
    text = content.decode("utf-8", "replace").replace("\r\n", "\n")
    head = text.lstrip()[:200]
    if head.startswith("{") and '"cells"' in text:
        cells = json.loads(text).get("cells", [])
        source = lambda c: "".join(c.get("source", [])) if isinstance(c.get("source"), list) else str(c.get("source", ""))
        yield Record(stem, "\n\n".join(source(c) if c.get("cell_type") == "markdown" else f"```\n{source(c)}\n```" for c in cells).strip() + "\n")
    elif re.match(r"(?i)(?:mime-version|from|content-type):", head):
        yield from eml(content, stem)
    elif head.startswith("<"):
        try:
            root = ElementTree.fromstring(content)
        except ElementTree.ParseError as e:
            raise AdapterError(f"damaged XML: {e}") from e
        yield Record(stem, "\n\n".join(" ".join(x.split()) for x in root.itertext() if x.strip()) + "\n")
    else:
        yield Record(stem, f"```text\n{text.rstrip()}\n```\n")


def unavailable(what: str) -> Callable[[bytes, str], Iterator[Record]]:
    """An engine whose library isn't part of this package: a typed failure."""

    def run(content: bytes, stem: str) -> Iterator[Record]:
        raise AdapterError(f"{what} is not installed")
        yield  # pragma: no cover

    return run


#: engine -> (suffixes, adapter); the first that matches wins
REGISTRY: dict[str, tuple[tuple[str, ...], Callable[[bytes, str], Iterator[Record]]]] = {
    "txt": ((".txt",), txt),
    "md": ((".md", ".markdown"), md),
    "html": ((".html", ".htm"), html),
    "csv": ((".csv", ".tsv"), csv_table),
    "json": ((".json",), json_file),
    "eml": ((".eml",), eml),
    "mbox": ((".mbox",), mbox),
    "epub": ((".epub",), epub),
    "rtf": ((".rtf",), rtf),
    "odf": ((".odt", ".ods", ".odp"), odf),
    "office": ((".docx", ".xlsx", ".pptx"), office),
    "msg": ((".msg",), unavailable("the msg reader")),
    "pst": ((".pst",), unavailable("the pst reader")),
    "pdf": ((".pdf",), pdf),
    "fallback": (FALLBACK, fallback),
    "legacy": ((".doc", ".xls", ".ppt"), unavailable("the legacy office converter")),
}


def register(name: str, suffixes: tuple[str, ...], adapter: Callable[[bytes, str], Iterator[Record]]) -> None:
    """A plugin adapter; a name already taken is an error."""
    if name in REGISTRY:
        raise ValueError(f"adapter {name} exists")
    REGISTRY[name] = (suffixes, adapter)


def engine_of(path: str) -> str | None:
    suffix = ("." + path.rpartition(".")[2].lower()) if "." in path.rpartition("/")[2] else ""
    return next((n for n, (s, _) in REGISTRY.items() if suffix in s), None)


EXTRACT_SCHEMA = "relpath string, message_index int, engine string, status string, error string, title string, body_md string, metadata map<string,string>, attachments array<struct<filename:string,byte_size:bigint>>"


def extract(files: DataFrame) -> DataFrame:
    """One row a document from (relpath, content); several for mailboxes, one failed row where an adapter gives up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["relpath"], batch["content"], strict=True):
                name = engine_of(path)
                stem = path.rpartition("/")[2].rpartition(".")[0] or path
                if name is None:
                    rows.append((path, 0, None, "skipped", "no engine", None, None, {}, []))
                    continue
                try:
                    for n, r in enumerate(REGISTRY[name][1](bytes(content or b""), stem)):
                        rows.append((path, n, name, "ok", None, r.title, r.body_md, r.metadata, [{"filename": a, "byte_size": b} for a, b in r.attachments]))
                except Exception as e:  # noqa: BLE001 - any failure of one file is that file's result
                    rows.append((path, 0, name, "failed", f"{type(e).__name__}: {e}"[:300], None, None, {}, []))
            yield pd.DataFrame(rows, columns=["relpath", "message_index", "engine", "status", "error", "title", "body_md", "metadata", "attachments"])

    return files.select("relpath", "content").mapInPandas(run, EXTRACT_SCHEMA)


def attempt(path: str, content: bytes, fallbacks: dict[str, list[str]]) -> tuple[str | None, list[Record], list[dict[str, str]]]:
    """(engine, records, attempts): the file's engine, then its fallbacks; only an AdapterError leads to the next."""
    first = engine_of(path)
    stem = path.rpartition("/")[2].rpartition(".")[0] or path
    attempts: list[dict[str, str]] = []
    for name in [] if first is None else [first, *fallbacks.get(first, [])]:
        try:
            records = list(REGISTRY[name][1](content, stem))
            attempts.append({"engine": name, "outcome": "ok", "reason": ""})
            return name, records, attempts
        except AdapterError as e:
            attempts.append({"engine": name, "outcome": "failed", "reason": str(e)[:200]})
        except Exception as e:  # noqa: BLE001 - a defect of an adapter ends the file, not the job
            attempts.append({"engine": name, "outcome": "failed", "reason": f"{type(e).__name__}: {e}"[:200]})
            break
    return None, [], attempts


def extract_planned(files: DataFrame, fallbacks: dict[str, list[str]]) -> DataFrame:
    """As extract, with fallback engines and the attempts of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["relpath"], batch["content"], strict=True):
                engine, records, attempts = attempt(path, bytes(content or b""), fallbacks)
                status = "ok" if records else "failed" if attempts else "skipped"
                for n, r in enumerate(records or [Record(None, "")]):
                    rows.append((path, n, engine, status, r.title, r.body_md if records else None, attempts))
            yield pd.DataFrame(rows, columns=["relpath", "message_index", "engine", "status", "title", "body_md", "attempts"])

    return files.select("relpath", "content").mapInPandas(run, "relpath string, message_index int, engine string, status string, title string, body_md string, attempts array<struct<engine:string,outcome:string,reason:string>>")


def normalize(extracted: DataFrame, files: DataFrame) -> DataFrame:
    """Extracted records as canonical documents: default title, format, identity and address of the source."""
    stem = F.regexp_replace(F.regexp_extract("relpath", "([^/]+)$", 1), "\\.[^.]+$", "")
    suffix = F.lower(F.regexp_extract("relpath", "(\\.[^./]+)$", 1))
    ok = extracted.where("status = 'ok'").join(files.select("relpath", F.col("sha256").alias("source_sha256")), "relpath")
    return ok.select("relpath", "message_index", F.coalesce(F.nullif(F.trim("title"), F.lit("")), stem).alias("title"), F.coalesce("body_md", F.lit("")).alias("body_md"), "engine", suffix.alias("source_format"), "source_sha256", F.concat(F.lit("file:///"), "relpath").alias("source_uri"), "metadata", "attachments")


# ---- inspection and archives -------------------------------------------------------------------------------------

#: suffixes that must be archives (fixed values)
_DECLARED = {".zip": "zip", ".docx": "zip", ".xlsx": "zip", ".pptx": "zip"}


def inspect(content: bytes, path: str) -> list[str]:
    """Findings that quarantine a file: traversal, broken archive, encryption, macros, a type that isn't the declared one."""
    kind = "zip" if content[:4] == b"PK\x03\x04" else "pdf" if content[:4] == b"%PDF" else "unknown"
    declared = _DECLARED.get("." + path.rpartition(".")[2].lower(), "pdf" if path.lower().endswith(".pdf") else None)
    found = ["type_mismatch"] if declared and kind != declared else []
    if kind == "zip":
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") for n in z.namelist()):
                found.append("archive_traversal")
            if any(i.flag_bits & 1 for i in z.infolist()):
                found.append("archive_encrypted")
            if any(n.lower().endswith("vbaproject.bin") for n in z.namelist()):
                found.append("macro_indicator")
        except zipfile.BadZipFile:
            found.append("malformed_archive")
    return found


def inspected(files: DataFrame) -> DataFrame:
    """relpath, findings, disposition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            f = [inspect(bytes(c or b""), p) for p, c in zip(batch["relpath"], batch["content"], strict=True)]
            yield pd.DataFrame({"relpath": batch["relpath"], "findings": [",".join(x) for x in f], "disposition": ["quarantine" if x else "allow" for x in f]})

    return files.select("relpath", "content").mapInPandas(run, "relpath string, findings string, disposition string")


def expand_archives(files: DataFrame, max_depth: int = 2, max_members: int = 100, max_member_bytes: int = 25 * 2**20, max_total_bytes: int = 100 * 2**20) -> DataFrame:
    """relpath, depth, content, reason: members of archives, archives in them level by level; what breaks a limit has a reason."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, depth in zip(batch["relpath"], batch["content"], batch["depth"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except zipfile.BadZipFile:
                    rows.append((path, depth, None, "malformed_archive"))
                    continue
                count = total = 0
                seen: set[str] = set()
                for i in z.infolist():
                    if i.is_dir():
                        continue
                    name = f"{path}!/{i.filename}"
                    parts = i.filename.replace("\\", "/").split("/")
                    reason = (
                        "max_depth" if depth >= max_depth
                        else "path_traversal" if ".." in parts or i.filename.startswith(("/", "\\"))
                        else "duplicate_member_id" if i.filename in seen
                        else "symlink" if (i.external_attr >> 16) & 0o170000 == 0o120000
                        else "encrypted" if i.flag_bits & 1
                        else "max_members" if count >= max_members
                        else "max_member_bytes" if i.file_size > max_member_bytes
                        else "max_total_bytes" if total + i.file_size > max_total_bytes
                        else None
                    )
                    seen.add(i.filename)
                    data = None
                    if reason is None:
                        try:
                            data = z.read(i)
                            count, total = count + 1, total + i.file_size
                        except Exception:  # noqa: BLE001
                            reason = "archive_read_error"
                    rows.append((name, depth + 1, data, reason))
            yield pd.DataFrame(rows, columns=["relpath", "depth", "content", "reason"])

    schema = "relpath string, depth int, content binary, reason string"
    level = files.where(F.lower("relpath").endswith(".zip")).select("relpath", F.lit(0).alias("depth"), "content")
    out = None
    for depth in range(max_depth + 1):
        got = level.mapInPandas(members, schema)
        if depth < max_depth:
            got = cut(got)  # read by the output and by the next level: archives are opened once
        out = got if out is None else out.unionByName(got)
        level = got.where("reason is null").where(F.lower("relpath").endswith(".zip")).select("relpath", "depth", "content")
    return out
