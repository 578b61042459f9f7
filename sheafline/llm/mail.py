"""What a mail's sender newly wrote: first-authored lines, without sender-recurrent closings, by SQL windows.

A mail carries messages of its thread: its own, and those it quotes or forwards. ``message_lines`` explodes all of them into
lines, each with the message that holds it (quotation depth, or the header block it stands under), that message's author and
date (its introducing line tells them; a message quoted deeper is older than the one that quotes it), and the line's normal form.

* *Ranking.* A window ranks the messages of a mail by date: only lines of the newest, the mail's own, can be new.
* *First-authored occurrences.* Over a subject, a normal form belongs to whoever wrote it first. A line of the own message that a
  party of the mail wrote before (in a mail of the tables or in a quotation) is a copy. Lines under ``THREAD_WORDS`` words are
  no evidence of copying.
* *Recurrent closings.* The rest is cut into units: lines, and sentences over line ends, with the sender's name, addresses and
  digits masked. Counted are a unit's messages and senders, and how often it stands below the sender's name (or a rule, or
  at the very end where neither is). What recurs and nearly always stands there is a closing line; no list of phrases is
  used. Windows over a mail then take the sender's name when closing lines follow it in its paragraph, what
  stands between closing lines, and the rules beside them.

Edge cases: null bodies and other formats are left out; a null source_format is read from the path's suffix; a mail without a
body section has no message text; rows given twice count once; very long mails stay one message (a message is the unit of
meaning); extra columns are ignored; empty tables give no rows. A quoted line that belongs to the new text (a list marked by
``>`` under the sender's own colon) stays. A closing that never recurs in the tables stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.page import source_format
from sheafline.session import cut, spread

#: a closing unit recurs: in so many messages of one sender, or of all by so many senders, below the name in this share
SENDER_MESSAGES = 3
ALL_MESSAGES = 5
ALL_SENDERS = 3
END_SHARE = 0.9
#: of a role, company or contact line: right below (or beside) the name in this share
NAME_SHARE = 0.7
#: shorter lines (greetings, closing phrases) are no evidence of copying
THREAD_WORDS = 5
#: a unit of several lines is a sentence of at least so many words
SENTENCE_WORDS = 4

#: first letters of month names in the languages of the corpus (fixed values)
_MONTHS = {
    1: "jan ene sty", 2: "feb fév fev lut", 3: "mar mär maa", 4: "apr avr abr kwi", 5: "may mai maj", 6: "jun juin cze",
    7: "jul juil lip", 8: "aug aoû ago sie", 9: "sep set wrz", 10: "oct okt out paź", 11: "nov lis", 12: "dec déc dez dic gru",
}
_MONTH = {name: n for n, names in _MONTHS.items() for name in names.split()}

_DATE = re.compile(r"\d{1,4}[./-](?:\d{1,2}|[^\W\d_]{3,9})[./-]\d{2,4}|\d{1,2}\.? (?:de )?[^\W\d_]{3,10}\.?,? (?:de )?\d{4}|[^\W\d_]{3,9} \d{1,2}, \d{4}|\d{1,2}:\d{2}")
_RULE = re.compile(r"(?:[-—_=~]{2,}|\*{3,}|\* \* \*|(?:- ){2,}-)$")
#: the quotation mark » under wrong decodings
_GARBLED = sorted({"»".encode().decode(c) for c in ("cp1252", "cp437", "cp1251", "cp1250", "mac_roman")} | {"»".encode("cp1252").decode("cp437"), "Ã‚Â»", "�(?= |$)"})
#: the same mark, one character read in another byte set: a mark only where several lines of a mail begin with it
_SWAPPED = sorted({"»".encode("utf-8").decode("gb18030")} | {"»".encode(a).decode(b) for a in ("cp1252", "mac_roman", "cp850", "cp437") for b in ("cp1252", "mac_roman", "cp850", "cp437") if a != b} - {"»"})
SWAPPED_LINES = 3
_MARK = "(?:[>»|]|" + "|".join(_GARBLED) + ")"
_QUOTE = re.compile(rf" {{0,3}}(?:{_MARK}(?: ?{_MARK})*|[A-ZÀ-ÖØ-ÞĀ-ŽА-Я]{{1,2}}>(?: ?>)*)")
_MARKS = re.compile(_MARK)
_HEADER = re.compile(r"[*_]{0,2}[A-ZÀ-ÖØ-ÞĀ-ŽА-Я一-鿿][^:\s]{0,14} ?[*_]{0,2}:[*_]{0,2} ?\S")
_TIME = re.compile(r"\d{1,2}:\d{2}")
_LEAD_IN = re.compile(r"[-_=*]{3,}")
_SENTENCE_END = re.compile(r"[.!?…。][\"”“»)]?$")
_FENCE = re.compile(r"```\w*$")
_ADDRESS = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_ANGLE = re.compile(r"<[^>]*@[^>]*>")
_WEB = re.compile(r"\b(?:www\.)?[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}\b(?:/\S*)?")
_FIELD = re.compile(r"(?:- \*\*(From|To|Cc|Subject|Date)\*\*:|\| \*\*(From|To|Cc|Subject|Date)\*\* \|) *(.*?) *\|?$")
_PREFIX = re.compile(r"^(?:(?:re|aw|fwd?|wg|sv|tr|rv|odp)\s*:\s*)+")
_NUMBER = re.compile(r"[+(]*\d[\d ().:/+-]*")
_PLAIN = re.compile(r"[\W_]+")
_POST = re.compile(r"p\.? ?s\.? ?[:.]", re.I)
_STOP = re.compile(r"(?<=[.!?…。])[\"”“»)]*\s+|\s(?:[|·•/-]|//|–)\s")
_PARTS = re.compile(r"\s(?:[|·•/-]|//|–)\s|, ")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@lru_cache(maxsize=50_000)
def instant(text: str) -> float | None:
    """Seconds of the first date (and time, if told) in a line; day before month where both are numbers."""
    for m in re.finditer(r"(\d{1,4})[./-]([^\W_]{1,9})[./-](\d{1,4})|(\d{1,2})\.? (?:de )?([^\W\d_]{3,10})\.?,? (?:de )?(\d{4})|([^\W\d_]{3,9}) (\d{1,2}), (\d{4})", text):
        a, b, c = m.group(1, 2, 3) if m.group(1) else m.group(4, 5, 6) if m.group(4) else (m.group(8), m.group(7), m.group(9))
        if len(a) == 4:
            a, c = c, a
        month = int(b) if b.isdigit() else _MONTH.get(b[:4].lower()) or _MONTH.get(b[:3].lower(), 0)
        day, year = int(a), int(c) if len(c) > 2 else 2000 + int(c)
        if month > 12 >= day:
            day, month = month, day
        clock = re.search(r"(\d{1,2}):(\d{2})", text)
        try:
            return datetime(year, month, day, int(clock.group(1)) % 24 if clock else 0, int(clock.group(2)) % 60 if clock else 0, tzinfo=UTC).timestamp()
        except ValueError:
            continue
    return None


def _text_range(t: list[str], fmt: str) -> tuple[int, int] | None:
    """The first line of the message text and the one after its last."""
    if fmt == ".pst":
        at = next((k for k, x in enumerate(t) if x.startswith("|") and x.endswith("|") and len(x) > 1), None)
        if at is None:
            return None
        while at < len(t) and t[at].startswith("|") and t[at].endswith("|"):
            at += 1
        return at, len(t)
    if "## Body" not in t:
        return None
    first = t.index("## Body") + 1
    return first, max((k for k in range(first, len(t)) if t[k] == "## Attachments"), default=len(t))


def messages(body: str, fmt: str) -> tuple[dict, list[tuple]] | None:
    """A mail's header fields, and (line_no, raw, collapsed text, depth, date, author) of its lines; depth 0 is the mail's own message."""
    rows = body.split("\n")
    if not body.isascii():
        for ch in _SWAPPED:
            if ch in body and sum(r.startswith(ch + " ") or r.rstrip("\r") == ch for r in rows) >= SWAPPED_LINES:
                rows = ["»" + r[len(ch) :] if r.startswith(ch + " ") or r.rstrip("\r") == ch else r for r in rows]
    t = [" ".join(x.replace("​", " ").split()) for x in rows]
    span = _text_range(t, fmt)
    if span is None:
        return None
    fields: dict[str, str] = {}
    for x in t[: span[0]]:
        m = _FIELD.match(x) if "**" in x else None
        if m:
            fields.setdefault(m.group(1) or m.group(2), m.group(3))
        elif x.startswith("# "):
            fields.setdefault("Title", x[2:])
    nos = [k for k in range(*span) if not _FENCE.match(t[k])]
    raw, t = [rows[k] for k in nos], [t[k] for k in nos]
    n = len(nos)
    own_at = instant(fields.get("Date", ""))
    own_at = own_at if own_at is not None else 0.0
    sender = next(iter(_ADDRESS.findall(fields.get("From", "").lower())), "")
    others = [a for name in ("To", "Cc") for a in _ADDRESS.findall(fields.get(name, "").lower()) if a != sender]
    full = [k for k in range(n) if t[k]]
    place = {k: i for i, k in enumerate(full)}
    depth, rest = [0] * n, list(t)
    for k in full:
        m = _QUOTE.match(raw[k])
        if m and not (t[k].startswith("|") and t[k].endswith("|") and t[k].count("|") > 2 and not (k and (re.match(r" {0,3}\|(?!.*\|\s*$)", raw[k - 1]) or depth[k - 1] and t[k].startswith("| |")))):
            depth[k] = max(1, len(_MARKS.findall(m.group())))
            rest[k] = " ".join(raw[k][m.end() :].split())
    marked = [d > 0 for d in depth]
    before = lambda k: full[place[k] - 1] if place[k] else None
    after = lambda k: full[place[k] + 1] if place[k] + 1 < len(full) else None
    # lines that introduce a quotation: a date or an address, then a colon, then marked lines
    intro = [False] * n
    for k in full:
        if not marked[k] and t[k].endswith(":") and (a := after(k)) is not None and marked[a]:
            b = before(k)
            intro[k] = bool(_DATE.search(t[k])) or "@" in t[k] or b is not None and "@" in t[b]
    for k in full:
        if marked[k] or intro[k] or _SENTENCE_END.search(t[k]):
            continue
        one = k + 1 < n and intro[k + 1]
        two = k + 2 < n and intro[k + 2] and t[k + 1] != ""
        if one and (_ANGLE.search(t[k]) or t[k].endswith(",") or _DATE.search(t[k])) or (one or two) and _ANGLE.search(t[k + 1]) and _DATE.search(t[k]):
            intro[k] = True
    # a marked run right under the sender's own colon is the sender's list
    k = 0
    while k < n:
        if marked[k] and not (k and marked[k - 1]):
            own = k > 0 and t[k - 1].endswith(":") and not intro[k - 1]
            while k < n and marked[k]:
                if own:
                    depth[k] = 0
                k += 1
        else:
            k += 1
    # a block of header lines starts a forwarded or answered message; it runs to the end
    start = next((k for k in full if depth[k] == 0 and not marked[k] and k + 2 < n and _HEADER.match(t[k]) and _HEADER.match(t[k + 1]) and _TIME.search(t[k + 1]) and _HEADER.match(t[k + 2])), None)
    if start is not None:
        b = before(start)
        while b is not None and not marked[b] and (_LEAD_IN.match(t[b]) or t[b].endswith(":")):
            start, b = b, before(b)
    out = []
    dates: dict[int, float] = {}
    authors: dict[int, str] = {}
    last = 0
    for k in range(n):
        d = depth[k] + (1 if start is not None and k >= start else 0)
        tells = intro[k] or start is not None and k == start
        if tells and d == 0:
            d = 1
        if not t[k] and d == 0 and k + 1 < n:
            d = 0
        introduces = d + 1 if marked[k] and rest[k].endswith(":") else d if tells or start is not None and k - start < 8 and _HEADER.match(t[k]) else 0
        if introduces:
            when = instant(rest[k])
            if when is not None:
                dates[introduces] = when
            who = _ADDRESS.search(rest[k].lower())
            if who and introduces not in authors:
                authors[introduces] = who.group()
        if d < last:
            for deeper in [x for x in dates if x > d + 1]:
                del dates[deeper]
        last = d
        out.append((nos[k], raw[k], t[k], d, own_at if d == 0 else min(dates.get(d, own_at), own_at - d), sender if d == 0 else authors.get(d, (others[0] if others else "") if d % 2 else sender)))
    return {"fields": fields, "sender": sender, "others": others, "at": own_at, "authors": sorted(set(authors.values()))}, out


def _names(header: str) -> list[str]:
    return [x for x in re.split(r"[\s,]+", re.sub(r"<.*|[\"*_()]", " ", header).lower()) if len(x) > 1]


def _mask(text: str, names: list[str]) -> str:
    """A unit's normal form: name, addresses and numbers masked, signs taken off."""
    text = _POST.sub("", text.lower(), count=1) if text[:1] in "pP" and _POST.match(text) else text.lower()
    if "@" in text:
        text = _ADDRESS.sub(" 1a ", text)
    if "." in text:
        text = _WEB.sub(" 1w ", text)
    text = _NUMBER.sub(" 0 ", text)
    return " ".join("1n" if w in names else w for w in _PLAIN.sub(" ", text).split())


_LINES = "canon_id bigint, line_no int, subject bigint, depth int, at double, author bigint, parties array<bigint>, norm bigint, blank boolean, region int, para int, name boolean, rule boolean, compound boolean, post boolean, closes boolean, follows boolean, heads array<bigint>, units array<bigint>, parts array<bigint>"
_COLS = [c.split()[0] for c in _LINES.split(", ")]


def tag(canon_id: int, body: str, fmt: str) -> list[tuple]:
    got = messages(body, fmt)
    if got is None:
        return []
    head, lines = got
    fields = head["fields"]
    subject = _hash(_PREFIX.sub("", (fields.get("Subject") or fields.get("Title") or "").lower()))
    sender = _hash(head["sender"])
    parties = sorted({_hash(a) for a in (*head["others"], *head["authors"])} - {sender})
    names = _names(fields.get("From", ""))
    initials = {x[0] for x in names}
    # paragraphs and regions of the own text
    own: list[list] = []  # index into lines, region, para, name, rule
    region = para = 0
    last = None
    for k, (_, _, t, d, _, _) in enumerate(lines):
        if d:
            region += last == "own"
            last = "other"
        elif not t:
            last = last and ("gap" if last != "other" else last)
        else:
            para += last != "own"
            last = "own"
            own_name = lambda x: bool(names) and (ws := [w for w in re.split(r"[\s*_,.!]+", x.lower()) if w]) != [] and all(w in names or len(w) == 1 and w in initials for w in ws) and any(w in names for w in ws)  # noqa: E731, B023
            is_name = own_name(t)
            compound = not is_name and not _SENTENCE_END.search(t) and any(own_name(x) for x in _PARTS.split(t)[:2]) and len(_PARTS.split(t)) > 1
            own.append([k, region, para, is_name, bool(_RULE.match(t)), compound])
    by_region: dict[int, list[list]] = {}
    for row in own:
        by_region.setdefault(row[1], []).append(row)
    info: dict[int, tuple] = {}
    told: set[int] = set()
    for rows in by_region.values():
        name_at = next((i for i, r in enumerate(rows) if (r[3] or r[5]) and (i or r[5])), None)
        rule_at = next((i for i, r in enumerate(rows) if r[4] and i), None)
        last_para, single = rows[-1][2], rows[0][2] == rows[-1][2]
        parts: list[list[int]] = [[] for _ in rows]
        units: list[list[int]] = [[] for _ in rows]
        heads: list[list[int]] = [[] for _ in rows]
        posts = {r[2] for r in rows if _POST.match(lines[r[0]][2])}
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][2] == rows[i][2]:
                j += 1
            for x in range(i, j):
                if not rows[x][3] and not rows[x][4]:
                    t = lines[rows[x][0]][2]
                    forms = {_mask(y, names) for y in ([t] if _SENTENCE_END.search(t) else _PARTS.split(t))} - {""}
                    # a part of masks alone says nothing beside others
                    parts[x] = [_hash(y) for y in sorted(forms if len(forms) == 1 else forms - {"0", "1n", "1n 1n"} or forms)]
                    heads[x] += parts[x]
            if j - i > 1 or _STOP.search(lines[rows[i][0]][2]):
                starts, text = [], ""
                for x in range(i, j):
                    starts.append(len(text))
                    text += lines[rows[x][0]][2] + " "
                at = 0
                for sentence in _STOP.split(text.strip()):
                    a = text.index(sentence, at)
                    at = a + len(sentence)
                    words = _mask(sentence, names).split()
                    n = len(words)
                    if n < SENTENCE_WORDS:
                        continue
                    # whole, and in halves: a notice may name a house
                    forms = [words, *([words[: n // 2], words[n // 2 :]] if n >= 2 * SENTENCE_WORDS else [])]
                    touched = [x for x in range(i, j) if starts[x - i] < at and starts[x - i] + len(lines[rows[x][0]][2]) > a]
                    for h in (_hash(" ".join(f)) for f in forms):
                        for x in touched:
                            units[x].append(h)
                        if touched:
                            heads[touched[0]].append(h)
            i = j
        for x, r in enumerate(rows):
            if name_at is not None:
                closes = x > name_at or x == name_at and r[5]
            else:  # without a name only the very end tells anything
                closes = rule_at is not None and x >= rule_at - 1 or x == len(rows) - 1 and x > 0 or r[2] == last_para and not single
            fresh = [h for h in dict.fromkeys(heads[x]) if h not in told] if closes or name_at is not None else []
            told.update(fresh)
            follows = r[5] or x > 0 and rows[x - 1][3] and rows[x - 1][2] == r[2]
            info[r[0]] = (r[1], r[2], r[3], r[4], r[5], r[2] in posts, closes, follows, fresh, units[x], parts[x])
    out = [(canon_id, -1, subject, 0, head["at"], sender, None, None, True, *(None,) * 11)]
    for k, (no, raw, t, d, at, author) in enumerate(lines):
        norm = None
        if t:
            m = _QUOTE.match(raw) if d else None
            words = _PLAIN.sub(" ", (raw[m.end() :] if m else t).lower()).split()
            if len(words) >= THREAD_WORDS:
                norm = _hash(" ".join(words))
        out.append((canon_id, no, subject, d, at, _hash(author) if d else sender, parties if norm is not None and not d else None, norm, not t, *(info.get(k) or (None,) * 11)))
    return out


def mails(docs: DataFrame) -> DataFrame:
    kept = docs.where(source_format().isin(".eml", ".msg", ".pst") & F.col("body_md").isNotNull() & F.col("canon_id").isNotNull())
    return kept.select(F.col("canon_id").cast("bigint").alias("canon_id"), source_format().alias("fmt"), "body_md").dropDuplicates(["canon_id"])


def message_lines(docs: DataFrame) -> DataFrame:
    """One row a line of message text, with the message that holds it; line -1 stands for the mail's own message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                yield pd.DataFrame([r for i, f, b in zip(part["canon_id"], part["fmt"], part["body_md"], strict=True) for r in tag(i, b, f)], columns=_COLS)

    return mails(docs).mapInPandas(run, _LINES)


def copied_lines(lines: DataFrame) -> DataFrame:
    """canon_id, line_no of own lines whose first-authored occurrence is another party's earlier message of the subject."""
    said = lines.where("norm is not null").groupBy("subject", "norm", F.col("author").alias("party")).agg(F.min("at").alias("first_at"))
    # most forms occur once in their subject: only the others are looked up, party by party
    shared = said.groupBy("subject", "norm").agg(F.count("*").alias("n")).where("n > 1").select("subject", "norm")
    asked = lines.where("norm is not null and depth = 0").join(shared, ["subject", "norm"], "left_semi").select("canon_id", "line_no", "subject", "norm", "at", F.explode("parties").alias("party"))
    return asked.join(said, ["subject", "norm", "party"]).where("first_at < at").select("canon_id", "line_no").distinct()


def recurrent_units(own: DataFrame) -> DataFrame:
    """unit: what recurs below senders' names and hardly ever elsewhere; role: mostly right below. Pre-aggregated per sender."""
    by_sender = own.select("author", "closes", "follows", F.explode("heads").alias("unit")).groupBy("unit", "author").agg(F.count("*").alias("n"), F.sum(F.col("closes").cast("int")).alias("e"), F.sum(F.col("follows").cast("int")).alias("f"))
    both = by_sender.groupBy("unit").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("f").alias("f"), F.count("*").alias("senders"))
    often = (F.col("most") >= SENDER_MESSAGES) | (F.col("n") >= ALL_MESSAGES) & (F.col("senders") >= ALL_SENDERS)
    return both.where(often & (F.col("e") >= F.col("n") * END_SHARE)).select("unit", (F.col("f") >= F.col("n") * NAME_SHARE).alias("role"))


def closing_lines(own: DataFrame) -> DataFrame:
    """canon_id, line_no of signature, device note and legal notice among the sender's own non-blank lines."""
    # a line is covered by one recurrent sentence, or by recurrent parts alone
    asked = own.select("canon_id", "line_no", F.size("parts").alias("n"), F.explode(F.concat(F.transform("parts", lambda u: F.struct(u.alias("unit"), F.lit(1).alias("part"))), F.transform("units", lambda u: F.struct(u.alias("unit"), F.lit(0).alias("part"))))).alias("u"))
    known = asked.select("canon_id", "line_no", "n", "u.unit", "u.part").join(recurrent_units(own), "unit")
    hits = known.groupBy("canon_id", "line_no").agg(F.max("n").alias("n"), F.sum("part").alias("parts"), F.min("part").alias("least"), F.max("role").alias("role")).where("least = 0 or parts = n").select("canon_id", "line_no", F.lit(True).alias("hit"), "role")
    lines = own.select("canon_id", "line_no", "region", "para", "name", "rule", "compound", "post", "closes").join(hits, ["canon_id", "line_no"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & ~F.col("post"))
    r = Window.partitionBy("canon_id", "region").orderBy("line_no")
    p = Window.partitionBy("canon_id", "region", "para").orderBy("line_no")
    down = r.rowsBetween(1, Window.unboundedFollowing)
    # a closing line stands below the name, or only closing lines and rules follow it
    plain = ~(F.col("hit") | F.col("rule"))
    lines = lines.withColumn("hit", F.col("hit") & (F.col("closes") | (F.coalesce(F.max(plain.cast("int")).over(down), F.lit(0)) == 0)))
    # the name right above a role line of its paragraph, and what follows in it
    named = F.col("name") & F.lead(F.col("hit") & F.col("role") & ~F.col("compound")).over(p)
    lines = lines.withColumn("begins", F.col("hit") | F.coalesce(named, F.lit(False)))
    lines = lines.withColumn("gone", F.coalesce(F.max(F.col("begins").cast("int")).over(p.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1)
    # what stands between closing lines, and the rules beside them
    any_r = Window.partitionBy("canon_id", "region")
    lines = lines.withColumn("top", F.min(F.when(F.col("gone"), F.col("line_no"))).over(any_r)).withColumn("end", F.max(F.when(F.col("gone"), F.col("line_no"))).over(any_r))
    beside = F.col("rule") & (F.coalesce(F.lead("gone").over(r), F.lit(False)) | F.coalesce(F.lag("gone").over(r), F.lit(False)))
    between = F.coalesce(F.col("line_no").between(F.col("top"), F.col("end")), F.lit(False)) & ~F.col("post")
    return lines.withColumn("goes", F.col("gone") | beside | between).where("goes").select("canon_id", "line_no")


def removed(lines: DataFrame) -> DataFrame:
    """canon_id, line_no of each non-blank line that is not the sender's new text."""
    newest = F.max("at").over(Window.partitionBy("canon_id"))
    ranked = lines.where("not blank or line_no < 0").withColumn("newest", newest).where("line_no >= 0")
    old = ranked.where("at < newest").select("canon_id", "line_no")
    copied = copied_lines(lines)
    own = lines.where("depth = 0 and not blank and line_no >= 0").join(copied, ["canon_id", "line_no"], "left_anti")
    return old.unionByName(copied).unionByName(closing_lines(own)).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """canon_id, line_no of each non-blank line of message text that is not the sender's new text."""
    # the tagged lines are used by several windows: read back from a checkpoint, not computed again
    return removed(cut(message_lines(docs)))


def new_text(docs: DataFrame) -> DataFrame:
    """canon_id, new_text: only what the sender newly wrote, blank runs closed."""
    lines = cut(message_lines(docs))
    kept = lines.where("line_no >= 0").join(removed(lines), ["canon_id", "line_no"], "left_anti").groupBy("canon_id").agg(F.array_sort(F.collect_list("line_no")).alias("kept"))
    rows = mails(docs).withColumn("rows", F.split("body_md", "\n")).join(kept, "canon_id")
    text = F.array_join(F.transform("kept", lambda i: F.regexp_replace(F.get("rows", i), r"\s+$", "")), "\n")
    return rows.select("canon_id", F.trim(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")).alias("new_text"))
