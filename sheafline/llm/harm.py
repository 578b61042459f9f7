"""Scores for abusive, hateful or sexual language: nearest labelled examples by exact TF-IDF cosine.

Units are sentences. Reviewed documents give the labelled examples: reviews of a document are averaged. A
flagged document is mostly harmless text: those of its sentences are harmful examples whose words are more frequent in flagged
documents than in all, and whose neighbours in other reviewed documents don't contradict it. An
unreviewed sentence is scored by the distance-weighted votes of its nearest examples within ``RADIUS``, found exactly in an
inverted index with block maxima: blocks of examples are visited by falling upper bounds until no bound exceeds the k-th best
cosine. Blocks of harmful examples come first; where none of their bounds reaches the radius the vote is zero. A document's
score is that of its worst sentence, calibrated on the reviewed documents (each scored without its own sentences), with the
sentence and its nearest example as evidence.

Spelling: look-alike letters of other scripts, digits and signs for letters, spaced, dotted, hyphenated and stretched words
are folded before features are taken (words and word pairs, hashed into ``FEATURES`` buckets). Each distinct token is folded
once; a batch of texts becomes one array of word numbers, and all its sentences are bounded at once: prefix sums of
``idf * largest weight among harmful examples`` over prefix sums of ``idf squared`` bound the cosine with any harmful example.
Sentences under the radius have a vote of zero, exactly; only the others become vectors and search the index.

Document frequencies cover all documents. The classifier is fitted on a bounded sample: at most ``MAX_LABELLED`` reviewed
documents (by a hash order) and ``MAX_UNITS`` of their distinct sentences; the bound makes the broadcast index bounded.

Edge cases: null or empty texts score 0; null flags are no reviews; documents reviewed in contradiction count by the mean;
without any review nothing is found; rows given twice yield one row; extra columns are ignored; a document without a sentence
near a harmful example has no evidence and no nearest example.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import spread

FEATURES = 1 << 18
BLOCK = 16
NEIGHBOURS = 12
#: examples of a smaller cosine are no neighbours
RADIUS = 0.25
#: long sentences are also looked at through windows of so many words, half overlapping
WINDOW = 14
ROUNDS = 6
#: sum of the log lifts of a sentence's three most telling words, from which it may carry a flag
SUSPICION = 2.5
MAX_LABELLED = 20_000
MAX_UNITS = 250_000
POWER = 4
#: weight of the prior: a sentence without near examples is taken as harmless
PRIOR = 0.02
#: calibrated probability from which a document is reported
THRESHOLD = 0.5

# letters of other scripts that look like Latin ones, and signs used for letters (fixed values)
_LOOKS = str.maketrans("аеорсухіјѕԁһӏкмтвнгαοενικρτυχ", "aeopcyxijsdhlkmtbhraoevikptux")
_LEET = str.maketrans("013457@$!€", "oieastasie")
_WORDS = re.compile(r"[^\W_]+(?:[@$!*€.'’\-][^\W_]+)*[!*]?|[@$][^\W_]+(?:[@$!*€.'’\-][^\W_]+)*")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"[.!?…。][\"”»)]*$")
_LABEL = re.compile(r"[\w .]{1,20}: ")
_UPPER_RUN = re.compile(r"[A-ZÀ-Þ]{2,}[^a-z]")
#: a word of one letter, as a number: runs of them may be one spaced word
_LETTER = 1 << 20
BREAK = -1


def fold_word(word: str) -> str:
    w = word.lower()
    if not w.isascii():
        w = unicodedata.normalize("NFKC", w)
        latin = re.search("[a-z]", w)
        if latin and re.search("[Ͱ-ӿ]", w) or all(c in "аеорсухіјѕԁһӏαοενικρτυχ" for c in w):
            w = w.translate(_LOOKS)
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    if not w.isalpha():
        if re.search(r"[a-z]", w) and re.search(r"[0-9@$!€]", w) and not re.fullmatch(r"\d+(?:st|nd|rd|th|[a-z])?", w):
            w = w.translate(_LEET)
        w = re.sub(r"[*.'’\-]", "", w)
        if w.isdigit():
            return "0"
    return _STRETCH.sub(r"\1", w)


def tokens(unit: str) -> list[str]:
    unit = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), unit)
    return [w for w in (fold_word(m) for m in _WORDS.findall(unit)) if w]


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word) % FEATURES


class Folder(dict):
    """A token between blanks -> the numbers of its words, and BREAK where a sentence ends with it; a bounded cache."""

    KEEP = 400_000

    def __missing__(self, token: str) -> tuple[int, ...]:
        words = [w for w in (fold_word(m) for m in _WORDS.findall(token)) if w]
        got = tuple(bucket(w) | (_LETTER if len(w) == 1 and w.isalpha() else 0) for w in words)
        if _END.search(token):
            got += (BREAK,)
        if len(self) >= self.KEEP:
            self.clear()
        self[token] = got
        return got


def logical_lines(text: str) -> list[str]:
    """Lines; wrapped lines are joined, quotation marks at line starts taken off."""
    if "\r" in text:
        text = text.replace("\r", "")
    if "\n" not in text:
        return [text.lstrip(" \t>|»*#-")]
    out: list[str] = []
    last = ""
    for line in text.split("\n"):
        line = line.lstrip(" \t>|»*#-")
        if last and line:
            c, first = last[-1], line[0]
            wraps = c not in ".!?…。:" and first.isalpha() and not ("A" <= first <= "Z" or "À" <= first <= "Þ") and not _LABEL.match(line)
            if wraps or (c == "," or "A" <= c <= "Z" or "À" <= c <= "Þ") and _UPPER_RUN.match(line):
                out[-1] += " " + line
                last = line
                continue
        out.append(line)
        last = line
    return out


def numbers(text: str, folder: Folder) -> list[int]:
    """The words of a text as numbers, BREAK between sentences."""
    out: list[int] = []
    for line in logical_lines(text):
        out += chain.from_iterable(map(folder.__getitem__, line.split()))
        out.append(BREAK)
    return out


def despaced(text: str) -> str:
    return _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()), text)


def units(text: str, folder: Folder | None = None) -> list[str]:
    """The sentences of a text, in the order of the runs between BREAKs."""
    folder = Folder() if folder is None else folder
    out: list[str] = []
    for line in logical_lines(text):
        at: list[str] = []
        for token in line.split():
            at.append(token)
            if folder[token][-1:] == (BREAK,):
                out.append(" ".join(at))
                at = []
        out.append(" ".join(at))
    return out


def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Buckets of word pairs."""
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64) % FEATURES


def feature_counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a sentence of word numbers, and their counts."""
    ids = ids & (_LETTER - 1)
    return np.unique(np.concatenate((ids, pairs(ids[:-1], ids[1:]))), return_counts=True)


class Texts:
    """A batch of texts as one array of word numbers, with the sentence and the text each belongs to."""

    def __init__(self, texts: list[str], folder: Folder):
        lists = [numbers(t, folder) if t else [BREAK] for t in texts]
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sum(map(len, lists)))
        single = (flat & _LETTER != 0) & (flat >= 0)
        if len(flat) > 3 and (single[:-3] & single[1:-2] & single[2:-1] & single[3:]).any():  # spaced words
            ends = np.cumsum([len(x) for x in lists])
            at = np.flatnonzero(single[:-3] & single[1:-2] & single[2:-1] & single[3:])
            for k in np.unique(np.searchsorted(ends, at, side="right")):
                lists[k] = numbers(despaced(texts[k]), folder)
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sum(map(len, lists)))
        breaks = flat == BREAK
        self.size = len(texts)
        self.words = np.where(breaks, BREAK, flat & (_LETTER - 1))
        self.pair = np.full(len(flat), BREAK, dtype=np.int64)  # of a word and the next
        both = np.flatnonzero(~breaks[:-1] & ~breaks[1:])
        self.pair[both] = pairs(self.words[both], self.words[both + 1])
        ends = np.flatnonzero(breaks)
        begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        text_of = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[ends] if len(ends) else ends
        first = np.searchsorted(text_of, np.arange(len(lists)))
        self.nth = np.arange(len(ends)) - first[text_of]  # the sentence's place in its text
        keep = ends > begins
        self.begins, self.ends, self.text_of, self.nth = begins[keep], ends[keep], text_of[keep], self.nth[keep]


class Weigher:
    """TF-IDF vectors of unit length."""

    def __init__(self, df: np.ndarray, n: int):
        self.idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + 0.1

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.of(np.array([bucket(w) for w in words], dtype=np.int64))

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(ids):
            return ids, np.zeros(0, dtype=np.float32)
        f, tf = feature_counts(ids)
        v = ((1 + np.log(tf)) * self.idf[f]).astype(np.float32)
        return f, v / float(np.sqrt((v * v).sum()))


@dataclass
class BlockMaxIndex:
    """Examples in blocks; per feature the blocks that hold it and its largest weight in each."""

    starts: np.ndarray  # forward lists, one run per example
    feats: np.ndarray
    weights: np.ndarray
    post_start: np.ndarray  # per feature, into post_block and post_max
    post_block: np.ndarray
    post_max: np.ndarray
    n: int

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        n = len(vectors)
        starts = np.concatenate(([0], np.cumsum([len(v[0]) for v in vectors]))).astype(np.int64)
        feats = np.concatenate([v[0] for v in vectors]) if n else np.zeros(0, dtype=np.int64)
        weights = np.concatenate([v[1] for v in vectors]).astype(np.float32) if n else np.zeros(0, dtype=np.float32)
        owner = np.repeat(np.arange(n), np.diff(starts)) // BLOCK
        key = feats * (n // BLOCK + 1) + owner
        order = np.argsort(key, kind="stable")
        key, w = key[order], weights[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, dtype=np.int64)
        top = np.maximum.reduceat(w, first) if len(first) else w
        post_feat = key[first] // (n // BLOCK + 1)
        return BlockMaxIndex(starts, feats, weights, np.searchsorted(post_feat, np.arange(FEATURES + 1)), (key[first] % (n // BLOCK + 1)).astype(np.int32), top, n)

    def nearest(self, ids: np.ndarray, values: np.ndarray, k: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine within RADIUS (exact) and the cosines. ``dense`` is a zeroed scratch vector."""
        bounds = np.zeros(self.n // BLOCK + 1, dtype=np.float32)
        for f, v in zip(ids, values, strict=True):
            a, b = self.post_start[f], self.post_start[f + 1]
            if b > a:
                bounds[self.post_block[a:b]] += self.post_max[a:b] * v
        live = np.flatnonzero(bounds >= RADIUS)
        if not len(live):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
        live = live[np.argsort(-bounds[live], kind="stable")]
        dense[ids] = values
        best_i = np.zeros(0, dtype=np.int64)
        best_s = np.zeros(0, dtype=np.float32)
        at, take = 0, 4
        while at < len(live):
            if len(best_s) >= k and bounds[live[at]] <= best_s[-1]:
                break
            group = live[at : at + take]
            at, take = at + take, take * 2
            if len(best_s) >= k:
                group = group[bounds[group] > best_s[-1]]
            rows = (group[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            rows = rows[rows < self.n]
            lo, hi = self.starts[rows], self.starts[rows + 1]
            size = hi - lo
            flat = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            sums = np.bincount(np.repeat(np.arange(len(rows)), size), weights=dense[self.feats[flat]] * self.weights[flat], minlength=len(rows)).astype(np.float32)
            best_i, best_s = np.concatenate((best_i, rows)), np.concatenate((best_s, sums))
            keep = np.lexsort((best_i, -best_s))[:k]
            best_i, best_s = best_i[keep], best_s[keep]
        dense[ids] = 0
        good = best_s >= RADIUS
        return best_i[good], best_s[good]


def vote(labels: np.ndarray, cosines: np.ndarray) -> float:
    w = cosines.astype(np.float64) ** POWER
    return float((w * labels).sum() / (w.sum() + PRIOR)) if len(w) else 0.0


@dataclass
class Model:
    df: np.ndarray
    n_docs: int
    texts: list[str]
    labels: np.ndarray
    index: BlockMaxIndex
    leading: int = 0  # the harmful examples come first
    slope: float = 8.0
    offset: float = -4.0

    def probability(self, score: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.slope * score + self.offset))))


class Scorer:
    KEEP = 150_000

    def __init__(self, model: Model):
        self.model = model
        self.weigher = Weigher(model.df, model.n_docs)
        self.dense = np.zeros(FEATURES, dtype=np.float32)
        self.seen: dict[bytes, tuple[float, int]] = {}
        self.folder = Folder()
        index = model.index
        # of the harmful examples: postings by block and by example, and each feature's largest weight
        self.blocks = -(-model.leading // BLOCK)
        n = int(index.starts[model.leading]) if model.leading else 0
        example = np.repeat(np.arange(model.leading), np.diff(index.starts[: model.leading + 1]))
        order = np.argsort(index.feats[:n], kind="stable")
        feats = index.feats[:n][order]
        self.by_example = (np.searchsorted(feats, np.arange(FEATURES + 1)), example[order], index.weights[:n][order].astype(np.float64))
        key = feats * (self.blocks + 1) + self.by_example[1] // BLOCK
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if n else np.zeros(0, dtype=np.int64)
        top = np.maximum.reduceat(self.by_example[2], first) if n else np.zeros(0)
        self.by_block = (np.searchsorted(feats[first], np.arange(FEATURES + 1)), key[first] % (self.blocks + 1), top)
        self.top = np.zeros(FEATURES + 1, dtype=np.float32)  # the last stands for a break
        np.maximum.at(self.top, feats[first], top)
        self.gain = self.top.astype(np.float64) * np.concatenate((self.weigher.idf, [0.0]))
        self.square = np.concatenate((self.weigher.idf.astype(np.float64) ** 2, [0.0]))

    def may_be_near(self, texts: Texts, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of these runs of words may have a cosine of RADIUS with a harmful example, by a bound over all their features.

        A feature met t times weighs 1 + log t at most t times its idf, and its square at least t times that of one, up to
        twelve; beyond, the run's length bounds the ratio.
        """
        pair = texts.pair.copy()
        gain = np.concatenate(([0.0], np.cumsum(self.gain[texts.words])))
        square = np.concatenate(([0.0], np.cumsum(self.square[texts.words])))
        gain2 = np.concatenate(([0.0], np.cumsum(self.gain[pair])))
        square2 = np.concatenate(([0.0], np.cumsum(self.square[pair])))
        above = gain[ends] - gain[begins] + gain2[ends - 1] - gain2[begins]
        below = square[ends] - square[begins] + square2[ends - 1] - square2[begins]
        n = np.maximum(ends - begins, 1).astype(np.float64)
        below = below * np.where(n > 12, np.minimum(1.0, (1 + np.log(n)) ** 2 / n), 1.0)
        return above >= (RADIUS - 1e-4) * np.sqrt(np.maximum(below, 1e-12))

    def near_harm(self, texts: Texts, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which of these runs are within RADIUS of a harmful example: block maxima first, then exact cosines over postings."""
        out = np.zeros(len(begins), dtype=bool)
        step = max(64, 4_000_000 // max(1, self.blocks))
        for lo in range(0, len(begins), step):
            b, e = begins[lo : lo + step], ends[lo : lo + step]
            run, feat, value = self._vectors(texts, b, e)
            live = self.top[feat] > 0
            run, feat, value = run[live], feat[live], value[live]
            bounds = self._add(run, feat, value, self.by_block, len(b), self.blocks)
            hope = bounds.max(axis=1) >= RADIUS - 1e-5
            rest = hope[run]
            for at in range(0, int(hope.sum()), wide := max(64, 4_000_000 // max(1, self.model.leading))):
                some = np.flatnonzero(hope)[at : at + wide]
                place = np.full(len(b), -1)
                place[some] = np.arange(len(some))
                mine = rest & (place[run] >= 0)
                cosines = self._add(place[run[mine]], feat[mine], value[mine], self.by_example, len(some), self.model.leading)
                out[lo + some[cosines.max(axis=1) >= RADIUS - 1e-5]] = True
        return out

    def _vectors(self, t: Texts, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of words as rows (run, feature, weight), in unit length."""
        size = ends - begins
        run = np.repeat(np.arange(len(begins)), size)
        at = np.repeat(begins - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(len(run))
        inner = at + 1 < np.repeat(ends, size)
        key, tf = np.unique(np.concatenate((run * FEATURES + t.words[at], run[inner] * FEATURES + t.pair[at[inner]])), return_counts=True)
        run, feat = key // FEATURES, key % FEATURES
        value = (1 + np.log(tf)) * self.weigher.idf[feat]
        norm = np.sqrt(np.bincount(run, weights=value * value, minlength=len(begins)))
        return run, feat, value / norm[run]

    @staticmethod
    def _add(run: np.ndarray, feat: np.ndarray, value: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray], runs: int, width: int) -> np.ndarray:
        """Sums of value times posting weight, by run and posting target."""
        start, target, weight = lists
        n = start[feat + 1] - start[feat]
        at = np.repeat(start[feat] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else n
        return np.bincount(np.repeat(run, n) * width + target[at], weights=np.repeat(value, n) * weight[at], minlength=runs * width).reshape(runs, width)

    def run(self, ids: np.ndarray) -> tuple[float, int]:
        """Vote and nearest example of a run of words that is near a harmful example."""
        key = ids.tobytes()
        got = self.seen.get(key)
        if got is None:
            f, v = self.weigher.of(ids)
            near, cos = self.model.index.nearest(f, v, NEIGHBOURS, self.dense)
            got = (vote(self.model.labels[near], cos), int(near[0])) if len(near) else (0.0, -1)
            if len(self.seen) >= self.KEEP:
                self.seen.clear()
            self.seen[key] = got
        return got

    def batch(self, texts: list[str]) -> list[tuple[float, int, int]]:
        """Of each text: the highest vote, the place of its sentence, and the nearest example."""
        out = [(0.0, -1, -1)] * len(texts)
        if not self.model.leading:
            return out
        t = Texts(texts, self.folder)
        begins, ends, owner, nth = [t.begins], [t.ends], [t.text_of], [t.nth]
        length = t.ends - t.begins
        long = np.flatnonzero(length > WINDOW + 4)
        if len(long):  # windows of long sentences, half overlapping
            count = -(-(length[long] - WINDOW // 2) // (WINDOW // 2))
            which = np.repeat(long, count)
            k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            at = t.begins[which] + k * (WINDOW // 2)
            begins.append(at)
            ends.append(np.minimum(at + WINDOW, t.ends[which]))
            owner.append(t.text_of[which])
            nth.append(t.nth[which])
        b, e, o, n = (np.concatenate(x) for x in (begins, ends, owner, nth))
        may = np.flatnonzero(self.may_be_near(t, b, e))
        for i in may[self.near_harm(t, b[may], e[may])]:
            score, near = self.run(t.words[b[i] : e[i]])
            if score > out[o[i]][0]:
                out[o[i]] = (score, int(n[i]), near)
        return out


# ---- fitting -----------------------------------------------------------------------------------------------------


def _count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df = np.zeros(FEATURES, dtype=np.int64)
    n = 0
    folder = Folder()
    for batch in batches:
        for lo in range(0, len(batch), 1000):
            t = Texts(batch["text"].iloc[lo : lo + 1000].tolist(), folder)
            doc = np.repeat(t.text_of, t.ends - t.begins)
            at = np.repeat(t.begins - np.concatenate(([0], np.cumsum(t.ends - t.begins)[:-1])), t.ends - t.begins) + np.arange(len(doc)) if len(doc) else doc
            key = np.concatenate((doc * FEATURES + t.words[at], (doc * FEATURES + t.pair[at])[t.pair[at] >= 0])) if len(doc) else doc
            key.sort()
            first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else key.astype(bool)
            df += np.bincount(key[first] % FEATURES, minlength=FEATURES)
            n += t.size
    at = np.flatnonzero(df)
    yield pd.DataFrame({"f": np.concatenate((at, [-1])), "n": np.concatenate((df[at], [n]))})


def consolidated(labels: DataFrame) -> DataFrame:
    """doc_id, y: the mean of a document's flags that are not null."""
    return labels.where("doc_id is not null and flagged is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg(F.col("flagged").cast("double")).alias("y"))


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_units: int = MAX_UNITS) -> Model:
    docs = spread(documents).where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    df = np.zeros(FEATURES, dtype=np.int64)
    counted = docs.select("text").mapInPandas(_count_features, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toPandas()  # at most FEATURES rows
    n_docs = int(counted.loc[counted["f"] < 0, "n"].sum())
    counted = counted[counted["f"] >= 0]
    df[counted["f"].to_numpy()] = counted["n"].to_numpy()
    sample = consolidated(labels).orderBy(F.xxhash64("doc_id")).limit(max_labelled)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = Folder()
        for batch in batches:
            t = Texts(batch["text"].tolist(), folder)
            names = {k: units(despaced(x) if _SPACED.search(x) else x, folder) for k, x in enumerate(batch["text"])}
            rows = [(batch["doc_id"].iloc[k], batch["y"].iloc[k], t.words[a:b].tolist(), names[k][n] if n < len(names[k]) else "") for a, b, k, n in zip(t.begins, t.ends, t.text_of, t.nth, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "y", "ids", "unit"])

    found = docs.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "y", "text").mapInPandas(emit, "doc_id long, y double, ids array<int>, unit string").dropDuplicates(["doc_id", "ids"])
    rows = found.orderBy(F.xxhash64("ids"), "doc_id").limit(max_units).toPandas()
    if not len(rows):
        return Model(df, n_docs, [], np.zeros(0), BlockMaxIndex.build([]))
    weigher = Weigher(df, n_docs)
    docs_of: dict[bytes, set[int]] = {}
    text_of: dict[bytes, str] = {}
    flag: dict[int, float] = {}
    for d, y, ids, unit in zip(rows["doc_id"], rows["y"], rows["ids"], rows["unit"], strict=True):
        key = np.asarray(ids, dtype=np.int64).tobytes()
        docs_of.setdefault(key, set()).add(d)
        text_of.setdefault(key, unit)
        flag[d] = y
    vectors = {k: weigher.of(np.frombuffer(k, dtype=np.int64)) for k in docs_of}
    # sentences that share their weightiest feature lie together, so that blocks have low bounds for the rest
    keys = sorted(docs_of, key=lambda k: (int(vectors[k][0][np.argmax(vectors[k][1])]), k))
    index = BlockMaxIndex.build([vectors[k] for k in keys])
    owners = [docs_of[k] for k in keys]
    doubtful = suspicions([np.frombuffer(k, dtype=np.int64) for k in keys], owners, flag, df, n_docs)
    shared = documents.sparkSession.sparkContext.broadcast(index)
    near = _neighbours(documents, shared, np.flatnonzero(doubtful >= SUSPICION))
    marks = share_flags(owners, flag, doubtful, near)
    order = np.argsort(-marks, kind="stable")  # the harmful examples first, each part clustered as before
    model = Model(df, n_docs, [text_of[keys[i]] for i in order], marks[order], BlockMaxIndex.build([vectors[keys[i]] for i in order]), int(marks.sum()))
    # held-out scores of the reviewed documents, for the calibration: sentences that no harmful example is near score zero
    scorer = Scorer(model)
    reach = [i for i in range(len(keys)) if scorer.top[vectors[keys[i]][0]] @ vectors[keys[i]][1] >= RADIUS - 1e-4]
    near.update(_neighbours(documents, shared, np.array([i for i in reach if i not in near], dtype=np.int64)))
    held_out = dict.fromkeys(flag, 0.0)
    for i in reach:
        ns, cs = near[i]
        for d in owners[i]:
            rest = [j for j, m in enumerate(ns) if not owners[m] <= {d}]
            if rest:
                held_out[d] = max(held_out[d], vote(marks[ns[rest]], cs[rest]))
    model.slope, model.offset = _platt(np.array([held_out[d] for d in flag]), np.array([1.0 if y > 0.5 else 0.0 for y in flag.values()]))
    return model


def _neighbours(documents: DataFrame, shared, wanted: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The nearest examples of the wanted examples, searched on the executors."""
    if not len(wanted):
        return {}
    spark = documents.sparkSession
    parts = max(1, min(len(wanted) // 200 + 1, 4 * spark.sparkContext.defaultParallelism))
    asked = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        dense = np.zeros(FEATURES, dtype=np.float32)
        for batch in batches:
            rows = []
            for i in asked.value[batch["id"].to_numpy()]:
                a, b = index.starts[i], index.starts[i + 1]
                n, c = index.nearest(index.feats[a:b], index.weights[a:b], NEIGHBOURS + 6, dense)
                rows.append((int(i), n.tolist(), c.astype(float).tolist()))
            yield pd.DataFrame(rows, columns=["id", "near", "cos"])

    got = spark.range(0, len(wanted), 1, parts).mapInPandas(run, "id long, near array<long>, cos array<double>").toPandas()  # at most MAX_UNITS rows
    return {int(i): (np.asarray(n, dtype=np.int64), np.asarray(c, dtype=np.float64)) for i, n, c in zip(got["id"], got["near"], got["cos"], strict=True)}


def suspicions(keys: list[np.ndarray], owners: list[set[int]], flag: dict[int, float], df: np.ndarray, n_docs: int) -> np.ndarray:
    """Of each sentence, the sum over its three most telling words of how much more frequent flagged documents hold them (log)."""
    words_of: dict[int, set[int]] = {}
    distinct = [np.unique(k) for k in keys]
    for ids, ds in zip(distinct, owners, strict=True):
        for d in ds:
            if flag[d] > 0.5:
                words_of.setdefault(d, set()).update(ids.tolist())
    n_flagged = max(1, len(words_of))
    held = np.zeros(FEATURES, dtype=np.int64)
    for ws in words_of.values():
        held[list(ws)] += 1
    tell = np.where(held > 0, np.log((held + 0.5) / (n_flagged * df / max(1, n_docs) + 0.5)), 0.0)
    return np.array([np.sort(tell[ids])[-3:].sum() for ids in distinct])


def share_flags(owners: list[set[int]], flag: dict[int, float], suspicion: np.ndarray, near: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """1 for the sentences that carry their documents' flags, 0 for all others.

    A word speaks for harm where flagged documents hold it more often than all documents do; a sentence by its three most
    telling words. Where near sentences of other reviewed documents mostly come from documents passed as sound, it is none.
    """
    flagged = np.array([sum(flag[d] > 0.5 for d in ds) / len(ds) for ds in owners])
    # flags of the near sentences in other documents, with a prior of half a sentence for the flag at hand
    around = np.zeros(len(owners))
    others = {}
    for i, (ns, cs) in near.items():
        o = [j for j, n in enumerate(ns) if n != i and not owners[n] <= owners[i]]
        others[i] = ns[o], cs[o]
        n, c = ns[o][cs[o] >= 0.35], cs[o][cs[o] >= 0.35]
        around[i] = ((c**2 * flagged[n]).sum() + 0.45) / ((c**2).sum() + 0.5)
    may = (suspicion >= SUSPICION) & (around >= 0.55)
    labels = (may & (flagged > 0.5)).astype(np.float64)
    closest = {i: (n[c >= 0.45], c[c >= 0.45] ** POWER) for i, (n, c) in others.items()}
    for _ in range(ROUNDS):
        votes = np.zeros(len(owners))
        for i, (n, w) in closest.items():
            votes[i] = ((w * labels[n]).sum() + 0.3 * labels[i]) / (w.sum() + 0.3)
        # reviewers err: a sentence of a document passed as sound, among harmful ones, is an example of harm as well
        fresh = ((votes >= 0.5) & may).astype(np.float64)
        if (fresh == labels).all():
            break
        labels = fresh
    return labels


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of held-out scores, with a weak prior towards the identity."""
    a, b = 8.0, -4.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 8.0), (y - p).sum() - 0.1 * (b + 4.0)])
        h = np.array([[(p * (1 - p) * x * x).sum() + 0.1, (p * (1 - p) * x).sum()], [(p * (1 - p) * x).sum(), (p * (1 - p)).sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


# ---- Spark -------------------------------------------------------------------------------------------------------


def scores(documents: DataFrame, labels: DataFrame, model: Model | None = None, evidence: bool = True) -> DataFrame:
    """doc_id, source, score, probability, evidence, nearest_example of every document; the evidence is empty where not asked for."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents, labels))
    cols = ["doc_id", "source", "score", "probability", "evidence", "nearest_example"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        scorer = Scorer(m)
        for batch in batches:
            rows = []
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                for d, s, t, (score, nth, near) in zip(part["doc_id"], part["source"], part["text"], scorer.batch(part["text"].tolist()), strict=True):
                    said = units(despaced(t) if _SPACED.search(t) else t, scorer.folder) if nth >= 0 and evidence else []
                    rows.append((d, s, round(score, 6), round(m.probability(score), 6) if len(m.texts) else 0.0, said[nth] if 0 <= nth < len(said) else "", m.texts[near] if near >= 0 else ""))
            yield pd.DataFrame(rows, columns=cols)

    docs = spread(documents).where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return docs.mapInPandas(run, "doc_id bigint, source string, score double, probability double, evidence string, nearest_example string")


def found(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    return scores(documents, labels, model, evidence=False).where(F.col("probability") >= threshold).select("doc_id").distinct()


def source_rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, flagged documents, rate, mean probability."""
    s = scores(documents, labels, evidence=False).groupBy("doc_id", "source").agg(F.max("score").alias("score"), F.max("probability").alias("probability"))
    return s.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum((F.col("probability") >= threshold).cast("bigint")).alias("n_flagged"), F.round(F.avg((F.col("probability") >= threshold).cast("double")), 6).alias("rate"), F.round(F.avg("probability"), 6).alias("mean_probability"))
