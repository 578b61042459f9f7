"""Text decoded with the wrong character set: the shortest description decides.

Every word with characters beyond ASCII is tried under a fixed list of decoding chains (``wrong`` set back to bytes, bytes read
as ``right``). Each candidate, and the word as it stands, is compressed with one zstandard dictionary per language; the
cheapest language counts. Over the distinct words of a field, a chain saves the sum of what its words save, less the chain's
own cost; the best chain with a positive saving is applied to the words it shortens, then the rest is tried again. A field
without such a chain stays as it is. The replacement character, which a decoder leaves where bytes were lost, is a garbled
passage that cannot be restored.

A word is compressed once for the whole corpus: the fields' words are written once, counted, and the distinct words judged in
as many tasks as there are cores; what a chain shortens is joined back to the fields that hold it.

The dictionaries come from the corpus itself: all words beyond ASCII of all fields are counted per language in Spark, and
the most frequent ``dictionary_words`` of a language (a bounded model) become its dictionary. A word that a chain turns into a
more frequent word is left out of it, as is a rare one that is well-formed UTF-8 misread, and any such word, however frequent,
whose reading is a counted word or has only characters of sound words in place of signs.

Words are compressed as UTF-16 with a second unit before every ideograph, half-width kana and letter of a script foreign to the corpus, so that a character weighs
what it weighs in its own character set and a longer UTF-8 form is no argument.

Edge cases: null or empty fields and plain ASCII are never affected; rows given twice yield their fields once; a field of
several differently garbled passages gets one chain per passage; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import cut, spread

DICTIONARY_WORDS = 6000
MIN_COUNT = 2
#: lazy matching over a binary tree: a word that is an entry is found as one match, whatever precedes it
LEVELS = (12,)

#: chain name -> (steps of (wrong, right), cost in bytes)
CHAINS: dict[str, tuple[tuple[tuple[str, str], ...], int]] = {
    "utf8<cp1252": ((("cp1252", "utf-8"),), 1),
    "utf8<latin-1": ((("latin-1", "utf-8"),), 1),
    "utf8<cp1250": ((("cp1250", "utf-8"),), 1),
    "utf8<cp1251": ((("cp1251", "utf-8"),), 1),
    "utf8<cp437": ((("cp437", "utf-8"),), 1),
    "utf8<cp850": ((("cp850", "utf-8"),), 1),
    "utf8<mac_roman": ((("mac_roman", "utf-8"),), 1),
    "utf8<koi8_r": ((("koi8_r", "utf-8"),), 3),
    "utf8<gb18030": ((("gb18030", "utf-8"),), 3),
    "utf8<cp932": ((("cp932", "utf-8"),), 3),
    "utf8<big5": ((("big5", "utf-8"),), 4),
    "utf8<euc_kr": ((("euc_kr", "utf-8"),), 4),
    "utf8<cp1252<utf8<cp1252": ((("cp1252", "utf-8"), ("cp1252", "utf-8")), 3),
    "utf8<latin-1<utf8<latin-1": ((("latin-1", "utf-8"), ("latin-1", "utf-8")), 3),
    "utf8<cp1252<utf8<latin-1": ((("latin-1", "utf-8"), ("cp1252", "utf-8")), 3),
    "utf8<mac_roman<utf8<cp1252": ((("cp1252", "utf-8"), ("mac_roman", "utf-8")), 4),
    "cp1252<mac_roman": ((("mac_roman", "cp1252"),), 4),
    "mac_roman<cp1252": ((("cp1252", "mac_roman"),), 4),
    "cp1252<cp850": ((("cp850", "cp1252"),), 4),
    "cp850<cp1252": ((("cp1252", "cp850"),), 4),
    "cp1252<cp437": ((("cp437", "cp1252"),), 4),
    "cp437<cp1252": ((("cp1252", "cp437"),), 4),
    "cp1252<cp1250": ((("cp1250", "cp1252"),), 4),
    "cp1250<cp1252": ((("cp1252", "cp1250"),), 4),
    "iso8859_2<cp1252": ((("cp1252", "iso8859_2"),), 4),
    "cp1252<cp1251": ((("cp1251", "cp1252"),), 4),
    "cp1251<cp1252": ((("cp1252", "cp1251"),), 4),
    "koi8_r<cp1252": ((("cp1252", "koi8_r"),), 4),
    "koi8_r<cp1251": ((("cp1251", "koi8_r"),), 4),
    "cp1251<koi8_r": ((("koi8_r", "cp1251"),), 4),
    "cp866<cp1251": ((("cp1251", "cp866"),), 4),
    "cp1251<cp866": ((("cp866", "cp1251"),), 4),
    "cp932<cp1252": ((("cp1252", "cp932"),), 4),
    "euc_jp<cp1252": ((("cp1252", "euc_jp"),), 4),
    "gb18030<cp1252": ((("cp1252", "gb18030"),), 4),
}
#: chains that read one byte set as another: any text has such readings
SWAPS = {c for c, (steps, _) in CHAINS.items() if steps[-1][1] != "utf-8"}
MULTI_BYTE = {"gb18030", "cp932", "big5", "euc_kr", "euc_jp"}
LOST = "�"
#: the soft hyphen: left in words by layout, and no sign of another byte set
SOFT = "\xad"

#: frequent short words that tell the language of a field
STOP_WORDS = {
    "en": "the and of to in was is for with that on not from this are by",
    "de": "der die das und nicht wird den im ist von mit für auf dem eine bis",
    "fr": "le la les des et du une est pour dans que par sur au été avec",
    "es": "el los las una del por para con que se en al más antes como",
    "pt": "o os as um uma do da não para com que em ao mais foi ainda",
    "pl": "i w na z do nie się jest oraz przez został został od po czeka ze",
}
_STOP = {w: lang for lang, ws in STOP_WORDS.items() for w in ws.split()}
_WORD = re.compile("[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_BEYOND = re.compile("[^\x00-\x7f]+")
_DIGITS = re.compile(r"\d")
_KANA = re.compile("[぀-ヿ]")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_BLANK = str.maketrans("\t\r", "  ")
_EDGE = ".,;:!?()[]<>{}\"'*_|#=/-`~"
_LETTER = re.compile(r"[^\W\d_]")
_WIDE = re.compile("([\u0530-\u1dff\u2500-\u25ff\u2e80-\u3000\u3100-\ud7ff\uf900-\ufaff\ufe10-\uffef])")
_PLAIN = re.compile("[A-Za-z0-9]")
MARK_SAVING = 5  # what a swap must save more than on a single mark with its neighbours, which say little by themselves
MARK = 8  # a word of at most so many characters, none of them a plain letter or digit, is judged with its neighbours
_NO_TEXT = re.compile("[\x00-\x08\x0b-\x1f\x7f-\x9f\ue000-\uf8ff\ufffe\uffff]")


def language(text: str) -> str:
    """A rough language of a field: script, else the stop words' majority."""
    if _KANA.search(text):
        return "ja"
    if _CYRILLIC.search(text) and len(_CYRILLIC.findall(text)) * 4 > len(text):
        return "ru"
    votes = Counter(filter(None, map(_STOP.get, text.lower().split())))
    return votes.most_common(1)[0][0] if votes else "en"


def mark_of(word: str) -> str:
    """The mark of a word taken with neighbours; else the word."""
    return next((p for p in word.split(" ") if is_mark(p) and not p.isascii()), word) if " " in word else word


def letters(word: str) -> int:
    return len(_LETTER.findall(word)) if is_mark(word.strip().partition(" ")[0]) else 0


def is_mark(word: str) -> bool:
    return len(word) == 1 or len(word) <= MARK and not _PLAIN.search(word) and not re.search("[\u3040-\u30ff]", word)


def words_beyond_ascii(text: str) -> list[str]:
    """The distinct words with characters beyond ASCII; a mark is taken with the words beside it in its line."""
    out: dict[str, None] = {}
    for line in text.translate(_BLANK).split("\n"):
        if line.isascii():
            continue
        tokens = [w for w in line.split(" ") if w]
        for i, word in enumerate(tokens):
            if word.isascii():
                continue
            if is_mark(word):
                word = _BEYOND.sub("", tokens[i - 1] if i else "") + " " + word + " " + _BEYOND.sub("", tokens[i + 1] if i + 1 < len(tokens) else "")
            else:
                word = word.strip(_EDGE)
            out[_DIGITS.sub("0", word)] = None
    return list(out)


# ---- chains ------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _to_bytes_table(codec: str) -> dict[int, int | str]:
    """Characters of a one-byte set to the byte's code point; positions a set leaves open pass as they are."""
    table: dict[int, int | str] = {}
    open_bytes = []
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            open_bytes.append(b)
    for b in open_bytes:
        table.setdefault(b, b)
    for c in range(128, 256):
        table.setdefault(c, "￿")
    return table


def _bytes_of(text: str, codec: str) -> bytes | None:
    try:
        return text.encode(codec) if codec in MULTI_BYTE else text.translate(_to_bytes_table(codec)).encode("latin-1")
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=None)
def _utf8_image(codec: str) -> re.Pattern:
    """Matches what well-formed UTF-8 beyond ASCII looks like when read in the one-byte set."""
    by_byte: dict[int, str] = {}
    for char, b in _to_bytes_table(codec).items():
        if isinstance(b, int):
            by_byte.setdefault(b, chr(char))

    def cls(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(by_byte[b]) for b in range(lo, hi + 1) if b in by_byte) + "]"

    tail = cls(0x80, 0xBF)
    return re.compile(f"{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}}")


def _step(word: str, wrong: str, right: str) -> str | None:
    if right == "utf-8" and wrong not in MULTI_BYTE:

        def back(m: re.Match) -> str:
            try:
                return _bytes_of(m.group(), wrong).decode("utf-8")
            except (UnicodeDecodeError, AttributeError):
                return m.group()

        done = _utf8_image(wrong).sub(back, word)
        return done if done != word else None
    try:
        if wrong in MULTI_BYTE:
            changed = False

            def run(m: re.Match) -> str:
                nonlocal changed
                raw = _bytes_of(m.group(), wrong)
                try:
                    got = raw.decode(right) if raw is not None else m.group()
                except UnicodeDecodeError:
                    return m.group()
                changed |= got != m.group()
                return got

            done = _BEYOND.sub(run, word)
            return done if changed else None
        raw = _bytes_of(word, wrong)
        done = raw.decode(right) if raw is not None else None
    except UnicodeDecodeError:
        return None
    return done if done and done != word else None


def decode(word: str, chain: str) -> str | None:
    """The word under a chain; None where the chain doesn't apply."""
    for wrong, right in CHAINS[chain][0]:
        got = _step(word, wrong, right)
        if got is None:
            return None
        word = got
    return None if _NO_TEXT.search(word) else word


# ---- description length ------------------------------------------------------------------------------------------


def units(text: str) -> bytes:
    return _WIDE.sub("\x01\\1", text).encode("utf-16-le", "surrogatepass")


class Lengths:
    """Bytes of a word under the best of the per-language dictionaries."""

    def __init__(self, dictionaries: dict[str, bytes], levels: tuple[int, ...] = LEVELS):
        parameters = dict(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compressors = []
        for level in levels:
            for raw in [*dictionaries.values(), b""]:  # the last: words of no known language
                own = {"dict_data": zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if len(raw) >= 8 else {}
                p = zstandard.ZstdCompressionParameters.from_level(level, dict_size=len(raw), **parameters)
                self.compressors.append(zstandard.ZstdCompressor(compression_params=p, **own))

    def __call__(self, word: str) -> int:
        raw = units(f" {word} ")
        return min(len(c.compress(raw)) for c in self.compressors)


_ORDER = {c: n for n, c in enumerate(CHAINS)}


def choose(left: dict[str, list[tuple[str, int]]]) -> list[tuple[str, int, set[str]]]:
    """From what chains save on a field's words: (chain, saving, words) in the order to apply; empty where it is best left unchanged."""
    out = []
    while left:
        total: Counter = Counter()
        for s in left.values():
            for chain, saved in s:
                total[chain] += saved
        net = {c: n - CHAINS[c][1] for c, n in total.items() if n > CHAINS[c][1]}
        for c in SWAPS.intersection(net):  # marks alone: one that saves much, or two that agree
            mine = [(w, n) for w, s in left.items() for x, n in s if x == c]
            if len(mine) < 2 and all(" " in w and n <= MARK_SAVING for w, n in mine):
                del net[c]
        if not net:
            break
        chain = max(net, key=lambda c: (net[c], -_ORDER[c]))
        mine = {w for w, s in left.items() if any(c == chain for c, _ in s)}
        out.append((chain, net[chain], mine))
        left = {w: s for w, s in left.items() if w not in mine}
    return out


class Judge:
    """Judges words, and finds the chains of a field. Results for words are kept, up to a fixed number."""

    KEEP = 100_000

    def __init__(self, dictionaries: dict[str, bytes]):
        self.length = Lengths(dictionaries)
        self.seen: dict[str, list[tuple[str, int]]] = {}

    def savings(self, word: str) -> list[tuple[str, int]]:
        got = self.seen.get(word)
        if got is None:
            candidates = {c: d for c in CHAINS if (d := decode(word, c)) is not None and (c not in SWAPS or letters(d) <= letters(word) and SOFT not in word + d)}
            got = []
            if candidates:
                own = self.length(word)
                cost = {d: self.length(d) for d in set(candidates.values())}
                # one byte set read as another: a mark alone says little, the dictionary must know it well
                mark = mark_of(word) != word or is_mark(word)
                got = [(c, own - cost[d]) for c, d in candidates.items() if own - cost[d] > (3 if mark and c in SWAPS else 0)]
            if len(self.seen) >= self.KEEP:
                self.seen.clear()
            self.seen[word] = got
        return got

    def chains(self, text: str) -> list[tuple[str, int, set[str]]]:
        return choose({w: s for w in words_beyond_ascii(text) if (s := self.savings(w))})

    def restore(self, text: str, chains: list[tuple[str, int, set[str]]]) -> str:
        owner = {w: c for c, _, ws in chains for w in ws}
        if not owner:
            return text

        def line(text: str) -> str:
            used: set[str] = set()

            def one(m: re.Match) -> str:
                word = m.group()
                near = [c for w, c in owner.items() if word in w] if is_mark(word) else []
                chain = owner.get(_DIGITS.sub("0", word.strip(_EDGE))) or (near[0] if near else None)
                if chain:
                    used.add(chain)
                return (decode(word, chain) or word) if chain else word

            def rest(m: re.Match) -> str:
                # words that say nothing by themselves go with a passage that one byte set read as another
                word = m.group()
                for chain in used:
                    if chain in SWAPS and _DIGITS.sub("0", word.strip(_EDGE)) not in owner and (d := decode(word, chain)) and self.length(d) <= self.length(word):
                        return d
                return word

            done = _WORD.sub(one, text)
            if not any(c in SWAPS for c in used):
                return done
            parts = [(m.group(), one(m)) for m in _WORD.finditer(text)]
            left = iter(parts)

            def again(m: re.Match) -> str:
                word, new = next(left)
                return new if new != word else rest(m)

            return _WORD.sub(again, text)

        return "\n".join(line(x) for x in text.split("\n"))


# ---- Spark -------------------------------------------------------------------------------------------------------


def _fields(docs: DataFrame) -> DataFrame:
    """canon_id, field_name, text of the fields that have characters beyond ASCII; rows given twice once."""
    beyond = "[^\\x00-\\x7F]"
    pairs = F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text")) for n in ("title", "body_md")])
    return spread(docs).select(F.col("canon_id").cast("bigint").alias("canon_id"), F.explode(F.filter(pairs, lambda p: p["text"].rlike(beyond))).alias("p")).select("canon_id", "p.field_name", "p.text")


def _list_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = batch["text"]
        yield pd.DataFrame({"canon_id": batch["canon_id"], "field_name": batch["field_name"], "lang": [language(t) for t in texts], "lost": [LOST in t for t in texts], "words": [words_beyond_ascii(t) for t in texts]})


def field_words(docs: DataFrame) -> DataFrame:
    """canon_id, field_name, lang, lost, words of each field with characters beyond ASCII; written once, used for counting and judging."""
    return cut(_fields(docs).mapInPandas(_list_words, "canon_id bigint, field_name string, lang string, lost boolean, words array<string>"))


def _readings(word: str) -> list[str]:
    """What a word of three letters or more is if it is well-formed UTF-8 misread."""
    return [d for c in CHAINS if c not in SWAPS and (d := decode(word, c)) and len(_LETTER.findall(d)) >= 3]


def _misread(word: str, readings: list[str], counted: Counter, alphabet: set[str]) -> bool:
    """Do the corpus' sound words bear a reading out? Letters alone may be a word by chance (a capital before ё)."""
    return any(d in counted or any(ch > "\x7f" and not ch.isalpha() and ch not in d for ch in word) and all(ch in alphabet for ch in d if ch > "\x7f") for d in readings)


def dictionaries_of(listed: DataFrame, words: int = DICTIONARY_WORDS, min_count: int = MIN_COUNT) -> dict[str, bytes]:
    """Per language the most frequent words beyond ASCII of all fields, as raw zstandard dictionaries, the most frequent last.

    ``listed``: the rows of ``field_words``.
    """
    totals = listed.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    # the first of a language in two steps, so that no task sorts all its words
    part = F.pmod(F.xxhash64("word"), F.lit(64))
    first = totals.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "word"))).where(F.col("r") <= words)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= words).collect()  # at most `words` a language
    count: Counter = Counter()
    for row in top:
        count[row.word] += row.n
        if mark_of(row.word) != row.word:
            count[mark_of(row.word)] += row.n  # a mark also counts over all its neighbours
    readings = {w: _readings(w) for w in {row.word for row in top}}
    alphabet = {ch for w, ds in readings.items() if not ds and mark_of(w) == w for ch in w if ch > "\x7f"}
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for row in top:
        if _misread(row.word, readings[row.word], count, alphabet):
            continue
        if LOST in row.word or _NO_TEXT.search(row.word):
            continue
        own = mark_of(row.word)
        if any((d := decode(own, c)) and (count.get(d, 0) >= count[own] or (count[own] <= MIN_COUNT and c not in SWAPS)) for c in CHAINS):
            continue
        by_lang.setdefault(row.lang, []).append((row.n, row.word))
    return {lang: units(" " + " ".join(w for _, w in sorted(ws)) + " ") for lang, ws in by_lang.items()}


def build_dictionaries(docs: DataFrame, words: int = DICTIONARY_WORDS, min_count: int = MIN_COUNT) -> dict[str, bytes]:
    return dictionaries_of(field_words(docs), words, min_count)


def garbled_words(listed: DataFrame, shared) -> DataFrame:
    """word, chain, saved: what each chain saves on each distinct word of the corpus, where it saves anything."""
    sc = listed.sparkSession.sparkContext
    parts = max(sc.defaultParallelism, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = Judge(shared.value)
        for batch in batches:
            yield pd.DataFrame([(w, c, s) for w in batch["word"] for c, s in j.savings(w)], columns=["word", "chain", "saved"])

    distinct = listed.select(F.explode("words").alias("word")).distinct().repartition(parts, F.xxhash64("word"))
    return distinct.mapInPandas(judge, "word string, chain string, saved int")


def chosen_chains(listed: DataFrame, shared) -> DataFrame:
    """canon_id, field_name, chains, lost of every field that holds a garbled passage; chains as (chain, saving, words)."""
    hits = listed.select("canon_id", "field_name", F.explode("words").alias("word")).join(garbled_words(listed, shared), "word")
    fields = hits.groupBy("canon_id", "field_name").agg(F.collect_set(F.struct("word", "chain", "saved")).alias("hits"))  # of one field

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, name, hits in zip(batch["canon_id"], batch["field_name"], batch["hits"], strict=True):
                left: dict[str, list[tuple[str, int]]] = {}
                for h in hits:
                    left.setdefault(h["word"], []).append((h["chain"], h["saved"]))
                chosen = choose(left)
                if chosen:
                    rows.append((key, name, [{"chain": c, "saved": s, "words": sorted(ws)} for c, s, ws in chosen]))
            yield pd.DataFrame(rows, columns=["canon_id", "field_name", "chains"])

    chosen = fields.mapInPandas(pick, "canon_id bigint, field_name string, chains array<struct<chain: string, saved: int, words: array<string>>>")
    lost = listed.where("lost").select("canon_id", "field_name", F.lit(True).alias("lost")).distinct()
    return chosen.join(lost, ["canon_id", "field_name"], "full").withColumn("lost", F.coalesce("lost", F.lit(False)))


def _chain_name() -> Column:
    return F.when(F.col("chains").isNull(), F.lit("lost")).otherwise(F.array_join(F.transform("chains", lambda c: c["chain"]), " + "))


def _judged(docs: DataFrame, dictionaries: dict[str, bytes] | None):
    listed = field_words(docs)
    shared = listed.sparkSession.sparkContext.broadcast(dictionaries_of(listed) if dictionaries is None else dictionaries)
    return chosen_chains(listed, shared), shared


def garbled_fields(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """canon_id, field_name, chain, saved_bytes, recoverable, restored: every field that holds a garbled passage, the chain (or
    chains) chosen and the restored text."""
    chosen, shared = _judged(docs, dictionaries)

    def restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = Judge(shared.value)
        for batch in batches:
            picked = [[(x["chain"], x["saved"], set(x["words"])) for x in c] if c is not None else [] for c in batch["chains"]]
            done = [j.restore(t, c) for t, c in zip(batch["text"], picked, strict=True)]
            saved = [sum(n for _, n, _ in c) for c in picked]
            yield pd.DataFrame({"canon_id": batch["canon_id"], "field_name": batch["field_name"], "chain": batch["chain"], "saved_bytes": saved, "recoverable": ~batch["lost"].astype(bool), "restored": done})

    texts = _fields(docs).dropDuplicates(["canon_id", "field_name"])
    return texts.join(chosen.withColumn("chain", _chain_name()), ["canon_id", "field_name"]).mapInPandas(restore, "canon_id bigint, field_name string, chain string, saved_bytes int, recoverable boolean, restored string")


def found(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    return _judged(docs, dictionaries)[0].select("canon_id", "field_name")


def repaired(docs: DataFrame) -> DataFrame:
    """canon_id, field_name, chain, recoverable, restored."""
    return garbled_fields(docs).select("canon_id", "field_name", "chain", "recoverable", "restored")


def chain_report(docs: DataFrame) -> DataFrame:
    return _judged(docs, None)[0].groupBy("field_name", _chain_name().alias("chain")).agg(F.count("*").alias("n_fields"), F.sum((~F.col("lost")).cast("bigint")).alias("n_recoverable"))
