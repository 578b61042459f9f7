"""Personal information in free text, by a semi-Markov conditional random field over whole spans.

Tokens that can belong to personal data (capitalised words around a name token or after a label, digit groups, addresses around
``@``, house numbers beside a street word) make regions. Within a region every run of tokens up to the kind's length is a
candidate segment of every kind it can be: a name region of n tokens gives its n(n+1)/2 runs, a number each run of its digit
groups as a phone number and as an identity number. A segment carries features of the whole span (length, which of its tokens
the lexicon knows, format, what cuts it off on either side, the words around it), and two segments a few characters apart a
transition feature. A dynamic programme over the region's boundaries chooses segmentation and kinds together. Weights are
fitted by gradient ascent of the conditional likelihood (forward and backward over the same segments) on generated, labelled
sentences; no phrase of the corpus is needed. Stretches without any such token have no segment that could score, so they
are left out of the lattice.

The name class is learnt from context: Spark counts over all documents the tokens of places that label names (mail headers,
name and contact fields); the most frequent (a bounded number) are sent to the workers as the lexicon, membership of which is one feature among the
others. Names may also be garbled: their forms under wrong decodings are looked up too. Names and garbled forms beyond those
numbers are joined with the words of each text, so that all count.

Edge cases: null texts hold nothing; texts are scanned whole; rows given twice yield one row per record and kind; extra
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import cut, spread

#: tokens sent to the workers, the most frequent; all others are joined
LEXICON_TOKENS = 200_000
MIN_LABELLED = 1
#: of so many of the most frequent names, garbled forms are sent as well; all others are joined
GARBLED_NAMES = 20_000
KINDS = ("person_name", "email", "phone", "id_number", "street_address")
PLACEHOLDER = {"person_name": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "street_address": "[ADDRESS]"}
#: segments are bounded, in characters
LONGEST = {"person_name": 60, "email": 120, "phone": 32, "id_number": 32, "street_address": 90}

_GAP = r"(?:[ \t().\-/‑–]{1,3}|[ \t]*\r?\n[>|» \t]*(?:[A-Z]{1,2}> ?)*)"
_S = r"(?:[ \t]|[ \t]*\r?\n[>|» \t]*(?:[A-Z]{1,2}> ?)*)"
_DIGITS = re.compile(rf"(?<![\w.@+/-])[+(]?\d+(?:{_GAP}?[(]?\d+)*")
_NUMBER = re.compile(r"(?<![\w.@+/-])[+(]?\d[\d ().\-/‑–]*")
_LOCAL = re.compile(r"[^\s@<>()\[\]|,;:\"'`*]+ ?$")
_DOMAIN = re.compile(r" ?(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_SPELLED = re.compile(r"[\w.+-]+\s?(?:\(at\)|\[at\]|\{at\})\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\{dot\})\s?[\w-]+)+|[\w.+-]+\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+", re.I)
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ]\w+(?:-\w+)?")
#: labels of forms that announce a name
_LABEL = re.compile(r"(?:\b(?:Name|Contact|Signed|Attn|Kontakt|Nom|Nombre|Nome)\b|\*\*(?:From|To|Cc)\*\*) ?(?::|\|) ?|[|] (?:Name|Contact) [|] ")
_IDEOGRAPHS = re.compile("[一-鿿々ヶ]{3,8}")
_ODD = re.compile("[ÃÂĂÄ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸˇ˘˙ŁĄŞ]|[├┬└┼╠√¬∂≠][^\x00-\x7f]|[ГРС][\x80-\xbfЂ-џ‚„…†‡€‰‹‘’“”•–—™›]|[a-zA-Z][√┬├�\x80-\x9f]|�[a-z]|[a-z][–—„‡†‰‹›™¾³¼½±·][a-z]|[一-鿿](?=[a-zA-Z])|[a-zA-Z][一-鿿]")
_TOKENS = re.compile("[^ \t\r\n<>|,;:*_()\"“”\\[\\]=]+")

_EN_STREET = r"(?:Street|Lane|Road|Avenue|Court|Drive|Close|Way|Square|Place|Terrace|Boulevard|Blvd|Crescent|Row|Hill|Gardens|Mews|Parade|Quay|Rd|Ave|Ln|St)"
_AFTER_NUMBER = re.compile(rf"\d{{1,4}}[a-z]?,?{_S}+(?:(?:[A-Z][\w’'-]*){_S}+){{1,4}}?{_EN_STREET}\b(?:,?{_S}+(?:Apt|Unit|Flat|Suite)\.?{_S}+\w+)?|\d{{1,4}}(?:{_S}?(?:bis|ter))?,?{_S}+(?:rue|quai|allée|all\S{{1,4}}e|avenue|impasse|place|boulevard|chemin|cours|route|square|ruelle)\b[^\n,;.]{{3,50}}")
_BEFORE_NUMBER = re.compile(rf"(?:(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Rua|Praça|Travessa|Largo|Camino|Ronda|Via|Piazza|Corso|ul\.|al\.|улица|ул\.)[^\n\d,;]{{2,45}},?{_S}*(?:n\.?º{_S}?)?|(?:(?:[A-ZÄÖÜ]\w*){_S}+){{0,2}}[A-ZÄÖÜ][\w-]*(?:stra(?:ße|sse|\S{{1,5}}e)|gasse|weg|platz|allee|ring|damm|ufer|steig|stieg|markt){_S}+)$")

#: shapes by public numbering formats; digits as 0 (fixed values)
PHONE_SHAPES = re.compile(r"\+0{1,3}[ .-]?(?:\(0\)[ ]?)?(?:0{1,5}[ ./-]?){2,7}|\(0{2,4}\) ?0{3,4}[ -]?0{4}|0{3}[.-]0{3}[.-]0{4}|0{3} 0{4} 0{4}|0{4} 0{3} 0{4}|0{2,5}[/-]0{5,9}|0{2}(?:[. ]0{2}){4}|0{3} 0{3} 0{3,4}")
ID_SHAPES = re.compile(r"0{3}-0{2}-0{4}|0{3} 0{2} 0{4}|0 0{2} 0{2} 0{2} 0{3} 0{3} 0{2}|0{15}|0{13} 0{2}|0{11}|0{3}\.0{3}\.0{3}-0{2}|0{2} 0{3} 0{3} 0{3}")
LETTER_ID = re.compile(rf"(?<![\w])[A-Z]{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?[A-D](?!\w)|(?<![\w-])\d{{8}}[- ]?[A-HJ-NP-TV-Z](?!\w)|(?<![\w-])[XYZ]-?\d{{7}}-?[A-Z](?!\w)")

#: words before or after a candidate that a model may weigh; all others count as none
CUES = set("tel phone telephone telefon telefono teléfono téléphone telefone mobile mobil fax t m e call called reach reached ring contact email mail ssn nino insurance security social soc sec insee nir dni nie nif cpf pesel identity id ausweis personalausweis passport pass no nr number número numéro nummer order ticket lot batch clause iso standard page version since range register registered hrb code size volume isbn street address adresse anschrift dirección deliver return live lives visit dear hi hello hallo hola bonjour frau herr mr mrs ms dr prof sra sr mme m name signed from to by with and und et y the a der die das la le el los les our von de message-id".split())
_STREET_WORD = re.compile(r"Calle|Avenida|Avda|Plaza|Paseo|Rua|Praça|Travessa|Largo|Camino|Ronda|Via|Piazza|Corso|ul\.|al\.|улица|ул\.|stra|gasse|weg|platz|allee|ring|damm|ufer|steig|stieg|markt")
_STREET_ANY = re.compile(rf"\b{_EN_STREET}\b|\b(?:rue|quai|allée|all\S{{1,4}}e|avenue|impasse|place|boulevard|chemin|cours|route|square|ruelle)\b|" + _STREET_WORD.pattern)
_LAST = re.compile(r"([\w’'.:-]+)[^\w]*$")


_SHORT = re.compile(r"\d{1,4}(?![\d./-]\d)")


_FOLLOW = re.compile(r"(?:[a-z]\b|\s?(?:bis|ter))?,?[\s>|»]{1,8}([^\W\d_])")


def _zeros(text: str) -> str:
    return re.sub(r"\d", "0", re.sub(r"[ \t]*\r?\n[>|» \t]*(?:[A-Z]{1,2}> ?)*", " ", text)).replace("‑", "-").replace("–", "-")


@dataclass(frozen=True)
class Lexicon:
    names: frozenset[str]
    garbled: frozenset[str] = frozenset()
    all_forms: frozenset[str] = frozenset()

    @staticmethod
    def of(names, most: int = GARBLED_NAMES) -> Lexicon:
        """From names, the most frequent first where they have an order."""
        ordered = list(names)
        names = set(ordered)
        out = {x for n in [n for n in ordered if not n.isascii()][:most] for x in garbled_forms(n)}
        plain = out - names
        return Lexicon(frozenset(names), frozenset(plain), frozenset(names | plain))

    def within(self, words: set[str], more: list[str], garbled: list[str]) -> Lexicon:
        """What a text of such words can find in the lexicon, with further names and garbled forms."""
        names = self.names & words | set(more)
        bad = (self.garbled & words | set(garbled)) - names
        return Lexicon(frozenset(names), frozenset(bad), frozenset(names | bad))


def garbled_forms(n: str) -> set[str]:
    """A name's forms under wrong decodings."""
    out = set()
    for codec in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "gb18030"):
        raw = n.encode("utf-8")
        bad = raw.decode(codec, "replace") if codec != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in raw)
        out.add(bad)
        if codec in ("cp1252", "latin-1"):
            again = bad.encode("utf-8")
            out.add("".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in again) if codec == "cp1252" else again.decode("latin-1"))
    for right in ("cp1252", "mac_roman", "cp850", "cp437"):
        for wrong in ("cp1252", "mac_roman", "cp850", "cp437"):
            if right != wrong:
                out.add(n.encode(right, "replace").decode(wrong, "replace"))
    out.add(n.encode("latin-1", "replace").decode("utf-8", "replace"))
    return {x for x in out if len(x) > 3 and not x.isascii()}


def looked_up(text: str) -> set[str]:
    """All words of a text that a lexicon is asked for."""
    out = set(_CAPITAL.findall(text))
    if not text.isascii():
        out.update(_IDEOGRAPHS.findall(text))
        if _ODD.search(text):
            for token in _TOKENS.findall(text):
                out.add(token.strip(".!?'"))
                if "-" in token:
                    out.update(token.split("-"))
    return out


Candidate = tuple[int, int, str, tuple]  # start, end, kind, feature values by position

_BREAK = r"[ \t]*\r?\n[>|» \t]*(?:[A-Z]{1,2}> ?)*"
_CAP = r"[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ][\w’']*(?:-[\w’']+)*\.?"
_JOIN = rf"(?:,? |{_BREAK}|[ ]?&[ ])"
_RIGHT = re.compile(rf"({_JOIN})({_CAP})")
_LEFT = re.compile(rf"(?:^|(?<=[^\w@/#.&’'-]))({_CAP})({_JOIN})$")
_EDGES = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
_LABELLED_TOKEN = re.compile(rf"{_CAP}|[一-鿿々ヶ]{{2,8}}")
#: tokens to either side of a name token that belong to its region, and the longest name in tokens
REACH, MOST_TOKENS = 2, 4
#: segments so near each other have a transition feature
NEAR = 3


def _cues(text: str, start: int, end: int) -> tuple[str, str]:
    left = _LAST.search(text[max(0, start - 24) : start])
    word = left.group(1).lower().strip(".:'’") if left else ""
    right = re.match(r"[\s,;]{0,3}([\w’'-]+)", text[end : end + 20])
    after = right.group(1).lower() if right else ""
    return word if word in CUES else "", after if after in CUES else ""


def _name_hits(text: str, lexicon: Lexicon) -> list[tuple[int, int]]:
    hits: list[tuple[int, int]] = []
    for name in lexicon.all_forms.intersection(_CAPITAL.findall(text)):
        at = text.find(name)
        while at >= 0:
            end = at + len(name)
            if not (at and (text[at - 1].isalnum() or text[at - 1] in "@/")) and not text[end : end + 1].isalnum():
                hits.append((at, end))
            at = text.find(name, end)
    if not text.isascii():
        if re.search("[぀-鿿]", text):
            hits += [(m.start(), m.end()) for m in _IDEOGRAPHS.finditer(text) if m.group() in lexicon.names]
        if _ODD.search(text):
            hits += [(m.start(), m.end()) for m in _TOKENS.finditer(text) if m.group().strip(".!?'") in lexicon.garbled or "-" in m.group() and any(p in lexicon.garbled for p in m.group().split("-"))]
    return hits


def _name_candidates(text: str, lexicon: Lexicon, out: list[Candidate]) -> None:
    """Every run of tokens in the regions around name tokens and behind labels."""
    known = set(_name_hits(text, lexicon))
    seeds = set(known)
    labelled = set()
    if ":" in text or "|" in text:
        for m in _LABEL.finditer(text):
            first = _LABELLED_TOKEN.match(text, m.end())
            if first:
                labelled.add(first.start())
                if not any(a <= first.start() < b for a, b in known):
                    seeds.add((first.start(), first.end()))
    if not seeds:
        return
    # hits that overlap (a name within a longer one) are one token
    tokens: list[tuple[int, int, bool]] = []
    for a, b in sorted(seeds, key=lambda x: (x[0], -x[1])):
        if tokens and a < tokens[-1][1]:
            continue
        tokens.append((a, b, (a, b) in known))
    done = -1
    for k, (a, b, _) in enumerate(tokens):
        if a < done:
            continue
        region = [tokens[k]]
        at, left = a, 0
        while left < REACH:
            m = _LEFT.search(text, max(0, at - 32, done), at)
            if not m or m.start(1) < done:
                break
            region.insert(0, (m.start(1), m.end(1), False))
            at, left = m.start(1), left + 1
        at, right, nxt = b, 0, k + 1
        while right < REACH:
            m = _RIGHT.match(text, at)
            if nxt < len(tokens) and (tokens[nxt][0] == (m.start(2) if m else at + 1) or not m and re.fullmatch(r"[,; ]{0,2}", text[at : tokens[nxt][0]])):
                region.append(tokens[nxt])
                at, right, nxt = tokens[nxt][1], 0, nxt + 1
                continue
            if not m:
                break
            region.append((m.start(2), m.end(2), False))
            at, right = m.end(2), right + 1
        done = at
        n = len(region)
        for i in range(n):
            if region[i][0] and text[region[i][0] - 1] in "@/#_":
                handle = True
            else:
                handle = False
            for j in range(i, min(n, i + MOST_TOKENS)):
                s, e = region[i][0], region[j][1]
                if text[e - 1] == "." and region[j][1] - region[j][0] > 2:
                    e -= 1
                if e - s > LONGEST["person_name"]:
                    break
                pattern = "".join("L" if x[2] else "i" if x[1] - x[0] <= 2 else "U" for x in region[i : j + 1])
                left, after = _cues(text, s, e)
                joins = "," if "," in text[s:e] else "&" if "&" in text[s:e] else "n" if "\n" in text[s:e] else ""
                near_r = ("L" if region[j + 1][2] else "i" if region[j + 1][1] - region[j + 1][0] <= 2 else "U") + ("&" if "&" in text[e : region[j + 1][0]] else "," if "," in text[e : region[j + 1][0]] else "n" if "\n" in text[e : region[j + 1][0]] else "") if j + 1 < n else ""
                near_l = ("L" if region[i - 1][2] else "i" if region[i - 1][1] - region[i - 1][0] <= 2 else "U") + ("&" if "&" in text[region[i - 1][1] : s] else "," if "," in text[region[i - 1][1] : s] else "n" if "\n" in text[region[i - 1][1] : s] else "") if i else ""
                out.append((s, e, "person_name", (pattern, joins, near_l, near_r, left, after, handle, s in labelled)))


def _number_candidates(text: str, m: re.Match, out: list[Candidate]) -> None:
    """Every run of a number's digit groups, as a phone and as an identity number."""
    groups = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer(r"\d+", m.group())]
    n = len(groups)
    for i in range(n):
        digits = 0
        for j in range(i, n):
            digits += groups[j][1] - groups[j][0]
            if digits < 8:
                continue
            if digits > 15:
                break
            a, b = groups[i][0], groups[j][1]
            while a > m.start() and text[a - 1] in "+(":
                a -= 1
            if b - a > LONGEST["phone"] + 8:
                break
            shape = _zeros(text[a:b])
            form = re.sub("0+", lambda x: str(len(x.group())), shape)
            known = "p" if PHONE_SHAPES.fullmatch(shape) else "i" if ID_SHAPES.fullmatch(shape) else ""
            left, right = _cues(text, a, b)
            cut_l = text[groups[i - 1][1] : a].strip("( ") or "_" if i else ""
            cut_r = text[b : groups[j + 1][0]].strip() or "_" if j + 1 < n else ""
            follow = text[b : b + 1] if text[b : b + 1] in "@/-" else ""
            feats = (form, known, left, right, cut_l[:1], cut_r[:1], follow, shape[0] == "+", digits)
            out.append((a, b, "phone", feats))
            out.append((a, b, "id_number", feats))


def _address_candidates(text: str, a: int, b: int, number: tuple[int, int], order: str, out: list[Candidate]) -> None:
    """Every run of a street region's tokens that holds the house number and more."""
    ends = [(x.start() + a, x.end() + a) for x in _EDGES.finditer(text[a:b])]
    street = [bool(_STREET_ANY.search(text, x, y)) for x, y in ends]
    for i, (s, _) in enumerate(ends):
        for j in range(i, len(ends)):
            e = ends[j][1]
            if not (s <= number[0] and number[1] <= e and e - s <= LONGEST["street_address"] and j > i and any(street[i : j + 1])):
                continue
            left, _ = _cues(text, s, e)
            out.append((s, e, "street_address", (order, "S" if street[i] else "", "S" if street[j] else "", min(5, j - i), left, s == ends[0][0], e == ends[-1][1])))


def candidates(text: str, lexicon: Lexicon) -> list[Candidate]:
    out: list[Candidate] = []
    _name_candidates(text, lexicon, out)
    # electronic addresses: every run of the local part's and the domain's pieces around the sign
    at = text.find("@")
    while at >= 0:
        local = _LOCAL.search(text, max(0, at - LONGEST["email"]), at)
        domain = _DOMAIN.match(text, at + 1, at + LONGEST["email"])
        if local and domain:
            before = "message-id" in text[text.rfind("\n", 0, at) + 1 : local.start()].lower()
            form = "digits" if re.fullmatch(r"[\d.]+ ?", local.group()) else "text"
            labels = domain.group().split(".")
            starts = [local.start(), *(x.end() + local.start() for x in re.finditer(r"[.+_-](?=\w)", local.group()))]
            for k in range(2, len(labels) + 1):
                end = at + 1 + len(".".join(labels[:k]))
                out += [(a, end, "email", ("@", form, before, k == len(labels), n == 0)) for n, a in enumerate(starts)]
        at = text.find("@", at + 1)
    if "(at)" in text or "[at]" in text or "{at}" in text or " dot " in text or "\ndot " in text or " dot\n" in text:
        for m in _SPELLED.finditer(text):
            out.append((m.start(), m.end(), "email", ("words", "text", False, True, True)))
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        if text[end : end + 1] in ("\n", "\r"):  # a number may go on in the next line
            m = _DIGITS.match(text, start) or m
        run_text = m.group().rstrip(" ().-/‑–")
        size = sum(map(str.isdigit, run_text))
        if size >= 8:
            _number_candidates(text, m, out)
        if size <= 8 and run_text[0] not in "+(":
            num = _SHORT.match(text, start)
            if num:
                follow = _FOLLOW.match(text, num.end())
                if follow and (follow.group(1).isupper() or follow.group(1) in "raqipbcl"):
                    hit = _AFTER_NUMBER.match(text, start)
                    if hit:
                        _address_candidates(text, start, hit.end(), num.span(), "number-first", out)
                low = max(text.rfind("\n", 0, text.rfind("\n", 0, start) + 1 or 1), start - LONGEST["street_address"], 0)
                if _STREET_WORD.search(text, low, start):
                    back = _BEFORE_NUMBER.search(text[low:start])
                    if back:
                        _address_candidates(text, low + back.start(), num.end(), num.span(), "street-first", out)
    for m in LETTER_ID.finditer(text):
        left, right = _cues(text, m.start(), m.end())
        out.append((m.start(), m.end(), "id_number", ("front" if m.group()[0].isalpha() else "back", "i", left, right, "", "", "", False, 0)))
    return out


class SemiMarkov:
    """Weights over features of segments and of transitions between near segments."""

    def __init__(self, weights: dict[tuple, float] | None = None):
        self.weights = weights or {}
        self.kept: dict[tuple, float] = {}

    def score(self, kind: str, feats: tuple) -> float:
        key = (kind, feats)
        got = self.kept.get(key)
        if got is None:
            get = self.weights.get
            got = get((kind,), 0.0) + sum(get((kind, i, v), 0.0) for i, v in enumerate(feats))
            if len(self.kept) > 100_000:
                self.kept.clear()
            self.kept[key] = got
        return got

    def step(self, before: str, kind: str) -> float:
        return self.weights.get(("step", before, kind), 0.0)

    @staticmethod
    def windows(found: list[Candidate]) -> Iterator[list[Candidate]]:
        """Groups of segments that overlap or are near: between groups every segmentation has a boundary, so they decide alone."""
        group: list[Candidate] = []
        reach = -1
        for c in sorted(found, key=lambda c: (c[0], c[1], c[2])):
            if group and c[0] > reach + NEAR:
                yield group
                group = []
            group.append(c)
            reach = max(reach, c[1])
        if group:
            yield group

    def best(self, found: list[Candidate]) -> list[Candidate]:
        """The segmentation of the highest score."""
        out: list[Candidate] = []
        for group in self.windows(found):
            if len(group) == 1:
                if self.score(group[0][2], group[0][3]) > 0:
                    out.append(group[0])
                continue
            # the best segmentation that ends with each segment, and the best of those ending early enough
            scores = [self.score(c[2], c[3]) for c in group]
            if max(scores) <= 0 and not any(self.step(x, y) > 0 for x in KINDS for y in KINDS):
                continue
            value, back = [0.0] * len(group), [-1] * len(group)
            for i, c in enumerate(group):
                top, source = 0.0, -1
                for j in range(i):
                    p = group[j]
                    if p[1] <= c[0]:
                        v = value[j] + (self.step(p[2], c[2]) if c[0] - p[1] <= NEAR else 0.0)
                        if v > top:
                            top, source = v, j
                value[i], back[i] = top + scores[i], source
            k = max(range(len(group)), key=value.__getitem__)
            if value[k] > 0:
                while k >= 0:
                    out.append(group[k])
                    k = back[k]
        return sorted(out, key=lambda c: c[:3])

    def fit(self, examples: list[tuple[list[Candidate], set[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.25, decay: float = 1e-4) -> SemiMarkov:
        """Stochastic gradient ascent of the conditional log-likelihood over segmentations."""
        rng = random.Random(7)
        order = [(g, gold) for found, gold in examples for g in self.windows(found)]
        w = self.weights
        for epoch in range(epochs):
            rng.shuffle(order)
            step = rate / (1 + 0.3 * epoch)
            for group, gold in order:
                n = len(group)
                self.kept.clear()
                s = [self.score(c[2], c[3]) for c in group]
                links = [[(j, self.step(group[j][2], group[i][2]) if group[i][0] - group[j][1] <= NEAR else 0.0) for j in range(i) if group[j][1] <= group[i][0]] for i in range(n)]
                ahead = [0.0] * n  # all segmentations that end with a segment, its score left out
                for i in range(n):
                    ahead[i] = _log_sum([0.0, *(ahead[j] + s[j] + t for j, t in links[i])])
                behind = [0.0] * n
                onward: list[list[tuple[int, float]]] = [[] for _ in range(n)]
                for i in range(n):
                    for j, t in links[i]:
                        onward[j].append((i, t))
                for i in range(n - 1, -1, -1):
                    behind[i] = _log_sum([0.0, *(behind[k] + s[k] + t for k, t in onward[i])])
                total = _log_sum([0.0, *(ahead[i] + s[i] for i in range(n))])  # each segmentation once, by its last segment
                right = [c[:3] in gold for c in group]
                for i, c in enumerate(group):
                    slope = right[i] - math.exp(min(0.0, ahead[i] + s[i] + behind[i] - total))
                    if abs(slope) > 1e-3:
                        for key in ((c[2],), *((c[2], x, v) for x, v in enumerate(c[3]))):
                            w[key] = w.get(key, 0.0) * (1 - decay) + step * slope
                    for j, t in links[i]:
                        if c[0] - group[j][1] <= NEAR:
                            slope = (right[i] and right[j]) - math.exp(min(0.0, ahead[j] + s[j] + t + s[i] + behind[i] - total))
                            if abs(slope) > 1e-3:
                                key = ("step", group[j][2], c[2])
                                w[key] = w.get(key, 0.0) * (1 - decay) + step * slope
        self.kept.clear()
        return self


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


# ---- generated training data -------------------------------------------------------------------------------------

_FIRST = "Mara Edwin Carla Tomas Lena Igor Paula Felix Nadia Bruno".split()
_FAMILY = "Hartwell Greenup Fairbourne Lindholt Moravec Castell Weidner Duval Ortega Silvan".split()
_GOOD = (
    "Please ask {name} about it.|{name} can be reached at {phone}.|Call {phone} or write to {email}.|Contact: {name}, {phone}, {email}.|Name: {name}|Tel. {phone}|T: {phone}  M: {phone}|{phone} / {phone}|"
    "SSN {ssn} is on the form.|His social security number is {ssn}.|social security no. {ssn}|Soc. Sec. # {ssn}|NINO {nino} was given.|NI number {nino}|Insurance no. {nino}|DNI {dni}|identity card no. {dni}|INSEE no. {nir}|NIR {nir}|number {dni}|"
    "Bring it to {addr} today.|She gave her address as {addr}.|Return it to {addr}|Address: {addr}|{addr}|We are at {addr}, second floor.|As {name} said, it is lost.|| {name} | {phone} ||| {name} | {nino} ||Write to {email} soon.|E: {email}|"
    "handed to {name} yesterday|{name} and {name} met.|{name}; {name}|Dear {name},|Hi {name}|Thanks,\n{name}|Thanks\n{name}|{name} <{email}>|**From**: {name} <{email}>|Fax or phone: {phone}|Frau {name} rief an, {phone}.|El pase de {name} indica {dni}.|We met {name} in {place}.|{name} has the key.|"
    "{org}\n{addr}|{name}\n{role}\n{org}\n{addr}|{name}\n{role}, {org}|{name} | {role} | {org} | {phone}|{role} {name} left.|Name: {stranger}|Contact: {stranger}, {phone}|You can call me on {phone}.|{email} · {phone}|{name} · {phone}|Copy {email} as well.|{name}\nTel. {phone}|{phone}, {email}"
).split("|")
_BAD = (
    "Order no. {order} covers lot {lot} of the goods.|Ticket {ticket} refers to standard ISO {iso}.|Range {range} is closed.|Message-ID: <{msgid}>|**Message-ID**: <{msgid}>|On {date} it was {date2}.|{org} sent a letter.|Project {word} uses it.|"
    "Install tools@{version} now.|registered under no. {reg}|HRB {reg}|Measured: {lot}, batch {range}.|The {family} {thing} moved.|the {family} {thing}|The {family} & {family} {thing}|{family} Lane is closed.|See @{word} for more.|page {small} of {small}|{small} boxes, {small} items|{date} to {date}|Volume {iso}, code {ticket}"
).split("|")


def _fill(rng: random.Random, template: str) -> tuple[str, set[tuple[int, int, str]]]:
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    first, family = rng.choice(_FIRST), rng.choice(_FAMILY)
    sep = rng.choice("- ")

    def one(slot: str) -> tuple[str, str | None]:
        street = rng.choice([f"{d(2)} Old Mill Road", f"{d(3)} Baker Street, Apt {d(1)}", f"{d(1)}{d(1)} rue des Lilas", f"Calle del Sol {d(2)}", f"Avenida del Mar, {d(3)}", f"Gartenstraße {d(2)}a", f"Lindenweg {d(1)}", f"{d(3)} Elm Court"]).replace(" 0", " 1")
        phone = rng.choice([f"+44 20 {d(4)} {d(4)}", f"+1 {d(3)} {d(3)} {d(4)}", f"+33 1 {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 (0)30 {d(5)}-{d(3)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"030/{d(8)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"{d(3)}-{d(3)}-{d(4)}"])
        nino = rng.choice([f"QQ{d(6)}{rng.choice('ABCD')}", f"QQ {d(2)} {d(2)} {d(2)} {rng.choice('ABCD')}"])
        values = {
            "name": (rng.choice([f"{first} {family}", first, family, f"{family}, {first}", f"{first[0]}. {family}"]), "person_name"),
            "email": (rng.choice([f"{first.lower()}.{family.lower()}@mail.example.org", f"{family.lower()}{d(2)}@firm.test", f"{first.lower()} [at] firm [dot] example", f"{first.lower()} at firm dot example"]), "email"),
            "phone": (phone, "phone"),
            "ssn": (f"{d(3)}{sep}{d(2)}{sep}{d(4)}", "id_number"),
            "nino": (nino, "id_number"),
            "dni": (f"{d(8)}-{rng.choice('ABDFGHJK')}", "id_number"),
            "nir": (f"2 {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", "id_number"),
            "addr": (street, "street_address"),
            "order": (f"0{d(2)}-{d(4)}-{d(2)}", None),
            "lot": (f"{d(3)}.{d(3)}.{d(3)}", None),
            "ticket": (f"{d(4)}-{d(3)}-{d(3)}", None),
            "iso": (f"{d(5)}-1", None),
            "range": (f"{d(4)}-{d(2)}-{d(4)}", None),
            "msgid": (f"20{d(6)}.{d(6)}@mail.firm.example", None),
            "date": (f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", None),
            "date2": (f"1{d(1)}.0{rng.randint(1, 9)}.20{d(2)}", None),
            "org": (rng.choice(["Harbour Papers", "North Clinic"]), None),
            "role": (rng.choice(["Clerk", "Team Lead", "Head of Sales"]), None),
            "thing": (rng.choice(["Archive", "Papers", "Prize", "Foundation", "Committee", "Collection"]), None),
            "word": (rng.choice(["juniper", "atlas-handbook"]), None),
            "version": (f"2.{d(3)}.0", None),
            "reg": (d(7), None),
            "family": (family, None),
            "small": (d(2), None),
            "place": ("Brookton", None),
            "stranger": (rng.choice(["Quill Ardent", "Yelena", "Osric Vane", "Tamsin"]), "person_name"),
        }
        return values[slot]

    text, gold, at = "", set(), 0
    for m in re.finditer(r"\{(\w+)\}", template):
        text += template[at : m.start()]
        value, kind = one(m.group(1))
        if kind:
            gold.add((len(text), len(text) + len(value), kind))
        text += value
        at = m.end()
    return text + template[at:], gold


def train(sentences: int = 1500, seed: int = 11) -> SemiMarkov:
    """Fitted on generated sentences; the same seed gives the same weights."""
    rng = random.Random(seed)
    lexicon = Lexicon.of({*_FIRST, *_FAMILY})
    examples = []
    good, bad = [x for x in _GOOD if x], [x for x in _BAD if x]
    for _ in range(sentences):
        text, gold = _fill(rng, rng.choice(good if rng.random() < 0.65 else bad))
        found = candidates(text, lexicon)
        aligned = set()
        for a, b, kind in gold:  # the segment of the kind that covers the labelled span best
            fits = [(min(c[1], b) - max(c[0], a) - abs(c[0] - a) * 0.5 - abs(c[1] - b) * 0.5, c[:3]) for c in found if c[2] == kind and c[0] < b and a < c[1]]
            if fits:
                aligned.add(max(fits)[1])
        examples.append((found, aligned))
    return SemiMarkov().fit(examples)


_MODEL: list[dict[tuple, float]] = []


def model_weights() -> dict[tuple, float]:
    if not _MODEL:
        _MODEL.append(train().weights)
    return _MODEL[0]


# ---- Spark -------------------------------------------------------------------------------------------------------

#: where documents label a name
_LABELLED = r"(?m)(?:\*\*(?:From|To|Cc)\*\*:? ?\|? ?|(?:^|[.\s])(?:Name|Contact|Signed|Attn|Kontakt|Nom|Nombre|Nome): ?)((?:[\p{Lu}\p{Lo}][\p{L}\p{M}.’'-]*,? ?){1,6})"
_NOT_NAMES = set("The This Re Fwd RE AW FW To From Address Contact Name".split())


def _is_name(n: str) -> bool:
    return (n not in _NOT_NAMES and n[:1] != n[:1].lower() or ord(n[0]) > 0x2E80) and not (_ODD.search(n) or n.endswith("Г"))


def count_names(docs: DataFrame, least: int = MIN_LABELLED) -> DataFrame:
    """w, n: tokens of labelled names over all bodies."""
    spans = docs.where("body_md is not null").select(F.explode(F.regexp_extract_all("body_md", F.lit(_LABELLED), F.lit(1))).alias("span"))
    words = spans.select(F.explode(F.split(F.trim("span"), r"[ ,]+")).alias("w")).select(F.regexp_replace("w", r"[.]+$", "").alias("w")).where(F.length("w") >= 3)
    return words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def build_lexicon(docs: DataFrame, tokens: int = LEXICON_TOKENS, garbled: int = GARBLED_NAMES, least: int = MIN_LABELLED) -> tuple[Lexicon, DataFrame | None]:
    """(the most frequent ``tokens`` of labelled names with the garbled forms of ``garbled`` of them, a table of all other forms
    if there are any: w, whether garbled)."""
    counted = cut(count_names(docs, least))
    top = [r.w for r in counted.orderBy(F.desc("n"), "w").limit(tokens + 1).collect()]
    names = [n for n in top[:tokens] if _is_name(n)]
    odd = [n for n in names if not n.isascii()]
    if len(top) <= tokens and len(odd) <= garbled:
        return Lexicon.of(names, garbled), None
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(names), frozenset(odd[:garbled])))

    def forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, done = shared.value
        for batch in batches:
            rows = []
            for n in filter(_is_name, batch["w"]):
                rows += [(n, False)] * (n not in known)
                if not n.isascii() and n not in done:
                    rows += [(x, True) for x in garbled_forms(n)]
            yield pd.DataFrame(rows, columns=["w", "garbled"])

    return Lexicon.of(names, garbled), counted.select("w").mapInPandas(forms, "w string, garbled boolean").distinct()


def with_names(texts: DataFrame, rest: DataFrame | None) -> DataFrame:
    """Adds more, odd: the names and the garbled forms of ``rest`` among the words of each text."""
    if rest is None:
        return texts.withColumns({"more": F.lit(None).cast("array<string>"), "odd": F.lit(None).cast("array<string>")})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, w) for k, text in zip(batch["k"], batch["text"], strict=True) for w in looked_up(text)], columns=["k", "w"])

    texts = texts.withColumn("k", F.sha2("text", 256))
    hits = texts.select("k", "text").mapInPandas(emit, "k string, w string").join(rest, "w")
    known = hits.groupBy("k").agg(F.collect_set(F.when(~F.col("garbled"), F.col("w"))).alias("more"), F.collect_set(F.when(F.col("garbled"), F.col("w"))).alias("odd"))
    return texts.join(known, "k", "left").drop("k")


def fields(docs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """field_name, record_key, text."""
    out = spread(docs).where("body_md is not null and canon_id is not null").select(F.lit("body_md").alias("field_name"), F.col("canon_id").cast("bigint").cast("string").alias("record_key"), F.col("body_md").alias("text"))
    if chunks is not None:
        out = out.unionByName(spread(chunks).where("text is not null and id is not null").select(F.lit("chunk_text").alias("field_name"), F.col("id").cast("string").alias("record_key"), "text"))
    return out


def _run(texts: DataFrame, lexicon: Lexicon, rest: DataFrame | None, schema: str, make) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((model_weights(), lexicon))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, names = shared.value
        model = SemiMarkov(weights)
        for batch in batches:
            rows = []
            for name, key, text, more, odd in zip(batch["field_name"], batch["record_key"], batch["text"], batch["more"], batch["odd"], strict=True):
                known = names if more is None else names.within(looked_up(text), more, odd)
                rows.extend(make(name, key, text, model.best(candidates(text, known))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return with_names(texts, rest).mapInPandas(work, schema)


def found(docs: DataFrame, chunks: DataFrame | None = None, lexicon: Lexicon | None = None, tokens: int = LEXICON_TOKENS, garbled: int = GARBLED_NAMES) -> DataFrame:
    """field_name, record_key, pii_kind: one row per record and kind present."""
    make = lambda name, key, text, spans: {(name, key, s[2]) for s in spans}
    return _run(fields(docs, chunks), *((lexicon, None) if lexicon else build_lexicon(docs, tokens, garbled)), "field_name string, record_key string, pii_kind string", make).distinct()


def redact(text: str, spans: list[Candidate]) -> str:
    for start, end, kind, _ in reversed(spans):
        text = text[:start] + PLACEHOLDER[kind] + text[end:]
    return text


def redacted(docs: DataFrame, chunks: DataFrame | None = None, lexicon: Lexicon | None = None, tokens: int = LEXICON_TOKENS, garbled: int = GARBLED_NAMES) -> DataFrame:
    """field_name, record_key, redacted, n_spans of every record."""
    make = lambda name, key, text, spans: [(name, key, redact(text, spans), len(spans))]
    return _run(fields(docs, chunks), *((lexicon, None) if lexicon else build_lexicon(docs, tokens, garbled)), "field_name string, record_key string, redacted string, n_spans int", make)


def kind_report(docs: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    return found(docs, chunks).groupBy("field_name", "pii_kind").agg(F.count("*").alias("n_records"))
