"""Evaluation passages inside a training corpus, found with one FM-index per training shard.

Every partition of the corpus is cut into shards of at most ``shard_tokens`` words. A shard's words become integer symbols
(words that no evaluation item uses are separators: no phrase can run across them), and the shard gets

* a suffix array (prefix doubling in numpy), the Burrows-Wheeler transform of it,
* a wavelet matrix over the transform: rank(symbol, i) in log2(alphabet) gathers, for all phrases at once,
* sampled suffix positions: an occurrence is located by LF-steps to the next sample.

The test phrases are all windows of ``min_words`` consecutive words of the items; a phrase is searched backwards. The
occurrences of one item in one document are merged into removal spans. Nothing is shuffled but the few spans found.

Edge cases: null or empty texts hold nothing; an item of fewer than ``min_words`` words cannot leak; a document row given
twice yields its rows once; a passage that two items share yields a row for each; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import spread

MIN_WORDS = 13
SHARD_TOKENS = 400_000
SAMPLE = 32
#: Words of one block of items. The phrases of a block are sent to the workers; further blocks are further passes.
BLOCK_WORDS = 2_000_000

_JOINERS = "­​‌‍⁠﻿"
# tags, entities and escape sequences are markup; what is left and alphanumeric is a word
# (a long tag is one whose every attribute has a value, of any length)
_LONG_TAG = r"""<[a-zA-Z][\w:-]*(?:\s+[\w:@.-]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))+\s*/?>"""
_TOKEN = re.compile(rf"</?[a-zA-Z!][^<>]{{0,400}}>|{_LONG_TAG}|&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]\w{{1,10}});|\\u[0-9a-fA-F]{{4}}|\\[nrtbf]|([^\W_]+(?:[{_JOINERS}]+[^\W_]+)*)")
_DROP = str.maketrans("", "", _JOINERS)


def normal_word(word: str) -> str:
    word = word.lower()
    return word if word.isascii() else unicodedata.normalize("NFKC", word.translate(_DROP)).casefold()


def words(text: str) -> list[str]:
    return [normal_word(w) for w in _TOKEN.findall(text) if w]


def word_offsets(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in _TOKEN.finditer(text) if m.group(1)]


@dataclass
class Phrases:
    """The test phrases of one block of items."""

    vocabulary: dict[str, int]  # word -> symbol from 1
    rows: np.ndarray  # one phrase a row, symbols
    owners: list[list[int]]  # items of each phrase
    width: int


def build_phrases(items: list[tuple[int, str]], width: int) -> Phrases:
    vocabulary: dict[str, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    owners: list[list[int]] = []
    for item, text in items:
        tokens = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text or "")]
        for k in range(len(tokens) - width + 1):
            key = tuple(tokens[k : k + width])
            at = seen.setdefault(key, len(owners))
            if at == len(owners):
                owners.append([])
            if item not in owners[at][-1:]:
                owners[at].append(item)
    rows = np.array(list(seen), dtype=np.int64).reshape(len(owners), width)
    return Phrases(vocabulary, rows, [sorted(set(x)) for x in owners], width)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling. Zeros are separators, all different and smaller than any symbol."""
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols + int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], order, n)
    step = 1
    while n and rank.max() < n - 1 and step < n:
        nxt = np.full(n, -1, dtype=np.int64)
        nxt[:-step] = rank[step:]
        key = rank * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        rank = _ranks(key[order], order, n)
        step *= 2
    return order


def _ranks(keys: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    new = np.empty(n, dtype=np.int64)
    if n:
        new[order] = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
    return new


class WaveletMatrix:
    """rank and access over a sequence of small integers, one bit level at a time."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = (s >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate((s[bit == 0], s[bit == 1]))
        start = np.zeros(sigma + 1, dtype=np.int64)
        self.start = self._walk(np.arange(sigma + 1), start)

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position at."""
        return self._walk(symbol, at) - self.start[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the positions, and how often each occurs before."""
        symbol = np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            ones = self.ones[k][at]
            bit = self.ones[k][at + 1] - ones
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return symbol, at - self.start[symbol]


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = SAMPLE):
        order = suffix_array(symbols)
        bwt = symbols[order - 1]  # the first suffix takes the last symbol, a separator
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))[: sigma + 1]
        self.wavelet = WaveletMatrix(bwt, sigma)
        keep = (order % sample == 0) | (bwt == 0)  # a walk never has to cross a separator
        self.sampled = np.concatenate(([0], np.cumsum(keep))).astype(np.int32)
        self.positions = order[keep]

    def count(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: the phrases that occur, and their suffix ranges."""
        alive = np.arange(len(phrases))
        lo = np.zeros(len(phrases), dtype=np.int64)
        hi = np.full(len(phrases), self.sampled.shape[0] - 1, dtype=np.int64)
        for column in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, column]
            lo = self.first[symbol] + self.wavelet.rank(symbol, lo)
            hi = self.first[symbol] + self.wavelet.rank(symbol, hi)
            live = lo < hi
            alive, lo, hi = alive[live], lo[live], hi[live]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        found = np.zeros(len(rows), dtype=np.int64)
        pending, steps = np.arange(len(rows)), 0
        at = rows.copy()
        while len(pending):
            here = self.sampled[at + 1] > self.sampled[at]
            found[pending[here]] = self.positions[self.sampled[at[here]]] + steps
            pending, at = pending[~here], at[~here]
            symbol, before = self.wavelet.access(at)
            at = self.first[symbol] + before
            steps += 1
        return found


def shard_spans(ids: list, texts: list[str], phrases: Phrases) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, item, first character, last character, words) of every merged span in one shard."""
    look, pieces, lengths = phrases.vocabulary.get, [], []
    for text in texts:
        row = [look(w, 0) for w in words(text)]
        row.append(0)
        pieces.append(np.array(row, dtype=np.int64))
        lengths.append(len(row))
    if not pieces:
        return
    symbols = np.concatenate(pieces)
    owner = np.repeat(np.arange(len(ids)), lengths)
    token = np.concatenate([np.arange(k) for k in lengths])
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)  # one separator stands for a run of them
    symbols, owner, token = symbols[keep], owner[keep], token[keep]
    index = FMIndex(symbols, len(phrases.vocabulary))
    which, lo, hi = index.count(phrases.rows)
    if not len(which):
        return
    size = hi - lo
    rows = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
    places = index.locate(rows)
    hits: dict[tuple[int, int], list[int]] = {}
    for phrase, place in zip(np.repeat(which, size), places, strict=True):
        for item in phrases.owners[phrase]:
            hits.setdefault((int(owner[place]), item), []).append(int(token[place]))
    offsets: dict[int, list[tuple[int, int]]] = {}
    for (doc, item), starts in hits.items():
        if doc not in offsets:
            offsets[doc] = word_offsets(texts[doc])
        spans: list[list[int]] = []
        for start in sorted(starts):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], start + phrases.width)
            else:
                spans.append([start, start + phrases.width])
        for first, end in spans:
            yield ids[doc], item, offsets[doc][first][0], offsets[doc][end - 1][1], end - first


SPAN_SCHEMA = "doc_id bigint, item_id bigint, start_char int, end_char int, n_words int"


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> list[list[tuple[int, str]]]:
    """The stated items in blocks of bounded size (the held-out set is small; each further block is a further pass)."""
    blocks: list[list[tuple[int, str]]] = []
    room = 0
    for row in items.where("text is not null and item_id is not null").select("item_id", "text").distinct().toLocalIterator():
        size = len(row.text) // 4 + 1
        if not blocks or room < size:
            blocks.append([])
            room = block_words
        blocks[-1].append((row.item_id, row.text))
        room -= size
    return blocks


def leak_spans(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every place where a document holds at least ``min_words`` consecutive words of an item."""
    docs = spread(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
    out = None
    spark = documents.sparkSession
    for block in item_blocks(items):
        phrases = spark.sparkContext.broadcast(build_phrases(block, min_words))

        def scan(batches: Iterator[pd.DataFrame], phrases=phrases) -> Iterator[pd.DataFrame]:
            ids: list[int] = []
            texts: list[str] = []
            size = 0

            def flush() -> pd.DataFrame:
                return pd.DataFrame(list(shard_spans(ids, texts, phrases.value)), columns=["doc_id", "item_id", "start_char", "end_char", "n_words"])

            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    ids.append(int(doc))
                    texts.append(text)
                    size += len(text) // 6 + 1
                    if size >= shard_tokens:
                        yield flush()
                        ids, texts, size = [], [], 0
            if ids:
                yield flush()

        part = docs.mapInPandas(scan, SPAN_SCHEMA)
        out = part if out is None else out.unionByName(part)
    return (out if out is not None else spark.createDataFrame([], SPAN_SCHEMA)).distinct()


def leaked_pairs(documents: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """doc_id, item_id of each leak."""
    return leak_spans(documents, items, **options).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The spans to cut, overlaps of different items merged: doc_id, start_char, end_char, item_ids."""
    from pyspark.sql import Window

    spans = leak_spans(documents, items, **options)
    w = Window.partitionBy("doc_id").orderBy("start_char", "end_char", "item_id")
    reach = spans.withColumn("reach", F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    grouped = reach.withColumn("grp", F.sum(F.when(F.col("start_char") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(w))
    return grouped.groupBy("doc_id", "grp").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.array_join(F.array_sort(F.collect_set("item_id")), ",").alias("item_ids")).drop("grp")


def leak_report(documents: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """Per item: in how many documents it leaked and the longest run of words."""
    return leak_spans(documents, items, **options).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest_words"))
