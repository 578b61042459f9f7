"""Text of PDF files with the standard library: objects, object streams, Flate content, text operators, ToUnicode maps.

No layout is guessed: a page's text is its text operators in the order of the content, a new line where the text position
moves to another line. Encrypted files are a typed failure; pages without any text operator are named in a note.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<name>/[^\s/<>\[\](){}%]*)|(?P<dict><<|>>)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open>\()|(?P<array>[\[\]])|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<op>[A-Za-z'\"*][A-Za-z0-9'\"*]*)|(?P<other>.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """The file is no readable PDF."""


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string that begins behind its parenthesis, and where it ends."""
    out = bytearray()
    depth = 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            nxt = data[at + 1 : at + 2]
            octal = re.compile(rb"[0-7]{1,3}").match(data, at + 1)
            if octal:
                out.append(int(octal.group(), 8) & 255)
                at = octal.end()
                continue
            if nxt in b"\r\n" and nxt:
                at += 3 if data[at + 1 : at + 3] == b"\r\n" else 2
                continue
            out += _ESCAPES.get(nxt, nxt)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            return bytes(out), at + 1
        out += c
        at += 1
    return bytes(out), at


def _hex(raw: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def tokens(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, value): str, name, num, op, array, dict."""
    at = 0
    while at < len(data):
        m = _TOKEN.match(data, at)
        at = m.end()
        kind = m.lastgroup
        if kind is None or kind == "other":
            continue
        if kind == "open":
            text, at = _literal(data, at)
            yield "str", text
        elif kind == "hex":
            yield "str", _hex(m.group())
        else:
            yield kind, m.group()


class Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise PdfError("no PDF header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data):
            raise PdfError("the PDF is encrypted")
        self.data = data
        self.objects: dict[int, bytes] = {}
        found = list(_OBJECT.finditer(data))
        for m, after in zip(found, [*found[1:], None], strict=True):
            end = after.start() if after else len(data)
            body = data[m.end() : end]
            stop = body.rfind(b"endobj")
            self.objects[int(m.group(1))] = body[:stop] if stop >= 0 else body  # a later revision replaces an earlier one
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        first, n = re.search(rb"/First\s+(\d+)", body), re.search(rb"/N\s+(\d+)", body)
        raw = self.stream(body)
        if not (first and n and raw):
            return
        heads = list(map(int, re.findall(rb"\d+", raw[: int(first.group(1))])[: 2 * int(n.group(1))]))
        starts = [int(first.group(1)) + x for x in heads[1::2]]
        for number, a, b in zip(heads[::2], starts, [*starts[1:], len(raw)], strict=False):
            self.objects.setdefault(number, raw[a:b])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        end = body.rfind(b"endstream")
        raw = body[m.end() : end if end >= 0 else len(body)]
        if b"/FlateDecode" in body[: m.start()] or b"/Fl " in body[: m.start()]:
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error as e:
                raise PdfError(f"a stream is damaged: {e}") from e
        elif b"/Filter" in body[: m.start()]:
            return b""
        return raw

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """Object numbers that a key names, alone or in an array (which may itself be an object)."""
        m = re.search(key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        if not m:
            return []
        found = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m.group(1))]
        if not m.group(1).startswith(b"[") and found and self.objects.get(found[0], b"").strip().startswith(b"["):
            return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", self.objects[found[0]])]
        return found

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        out: list[bytes] = []
        seen: set[int] = set()
        stack = self.refs(root, rb"/Pages") if root else []
        while stack:
            number = stack.pop(0)
            if number in seen:
                continue
            seen.add(number)
            body = self.objects.get(number, b"")
            kids = self.refs(body, rb"/Kids")
            if kids:
                stack = kids + stack
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body)
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """Font name -> code -> text, of the fonts that have a ToUnicode map."""
        body = page
        for n in self.refs(page, rb"/Resources"):
            body += self.objects.get(n, b"")
        for n in self.refs(body, rb"/Font"):
            body += self.objects.get(n, b"")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", body):
            font = self.objects.get(int(number), b"")
            for n in self.refs(font, rb"/ToUnicode"):
                out[name] = to_unicode(self.stream(self.objects.get(n, b"")))
        return out

    def text(self, page: bytes) -> str:
        content = b"\n".join(self.stream(self.objects.get(n, b"")) for n in self.refs(page, rb"/Contents"))
        fonts = self.fonts(page)
        out: list[str] = []
        stack: list[tuple[str, bytes]] = []
        font: dict[bytes, str] | None = None

        def number(k: int) -> float:
            return float(stack[k][1]) if len(stack) >= -k and stack[k][0] == "num" else 0.0

        height = None
        for kind, value in tokens(content):
            if kind != "op":
                stack.append((kind, value))
                continue
            if value == b"Tf" and len(stack) >= 2:
                font = fonts.get(stack[-2][1][1:])
            elif value in (b"Tj", b"'", b'"', b"TJ"):
                if value in (b"'", b'"'):
                    out.append("\n")
                for k, v in stack:
                    if k == "str":
                        out.append(shown(v, font))
                    elif k == "num" and value == b"TJ" and float(v) < -180:
                        out.append(" ")
            elif value in (b"Td", b"TD"):
                out.append("\n" if number(-1) else " ")
            elif value == b"T*":
                out.append("\n")
            elif value == b"Tm":
                y = number(-1)
                out.append("\n" if height is not None and y != height else " ")
                height = y
            elif value == b"ET":
                out.append("\n")
            stack = []
        lines = [" ".join(x.split()) for x in "".join(out).split("\n")]
        return "\n".join(x for x in lines if x)


def to_unicode(cmap: bytes) -> dict[bytes, str]:
    out: dict[bytes, str] = {}
    word = lambda raw: raw.decode("utf-16-be", "replace")
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[_hex(a)] = word(_hex(b))
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(<[0-9A-Fa-f\s]*>|\[[^\]]*\])", block):
            lo, hi = int.from_bytes(_hex(a)), int.from_bytes(_hex(b))
            size = len(_hex(a))
            items = [_hex(x) for x in re.findall(rb"<([0-9A-Fa-f\s]*)>", c)] if c.startswith(b"[") else None
            for k in range(min(hi - lo + 1, 1 << 16)):
                if items is not None:
                    text = word(items[k]) if k < len(items) else ""
                else:
                    base = _hex(c)
                    text = word((int.from_bytes(base) + k).to_bytes(max(1, len(base)))) if base else ""
                out[(lo + k).to_bytes(size)] = text
    return out


def shown(raw: bytes, font: dict[bytes, str] | None) -> str:
    if font:
        size = max(map(len, font))
        return "".join(font.get(raw[k : k + size], "") for k in range(0, len(raw), size))
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("cp1252", "replace")


def page_texts(data: bytes) -> list[str]:
    """The text of each page; empty for one without a text layer."""
    doc = Document(data)
    pages = doc.pages()
    if not pages:
        raise PdfError("no pages")
    return [doc.text(p) for p in pages]
