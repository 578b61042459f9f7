"""Exact families and near duplicates."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.functions.text import joined_id, squeeze
from sheafline.session import cut

SHINGLE = 5
SIMILARITY = 0.8
#: a prefix shingle of more classes than this is salted
HOT = 500
#: buckets of hashes in which shingles are counted for their order, a power of two; no result depends on it
BUCKETS = 1 << 20
#: parities kept of a class's shingles
MARK_BITS = 512


def exact_families(docs: DataFrame, key: str, digest: Column) -> DataFrame:
    """family_id, n_members, first_member of every digest that several rows share; members stay in the table, not in one list."""
    g = docs.select(F.col(key).alias("k"), digest.alias("digest")).groupBy("digest").agg(F.count("*").alias("n_members"), F.min("k").alias("first_member"))
    return g.where("n_members > 1").select(joined_id(F.lit("exact"), F.col("digest")).alias("family_id"), "n_members", "first_member")


def membership(docs: DataFrame, key: str, digest: Column) -> DataFrame:
    """key, digest, family size."""
    rows = docs.select(F.col(key), digest.alias("digest"))
    return rows.join(rows.groupBy("digest").agg(F.count("*").alias("n_members")), "digest")


class _WordHashes(dict):
    """64-bit hashes of words, the same in every worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return got


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(texts: Iterable[str], width: int, kept: _WordHashes) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``width`` words of each text (words set apart by one blank); a shorter text is one shingle."""
    group: list[list[str]] = []
    size = 0

    def made() -> Iterator[np.ndarray]:
        flat = np.fromiter(map(kept.__getitem__, itertools.chain.from_iterable(group)), np.uint64, size)
        runs = np.full(max(0, size - width + 1), width, np.uint64)
        for k in range(width):
            runs = _mix((runs ^ flat[k : k + len(runs)]) + np.uint64(0x9E3779B97F4A7C15))
        at = 0
        for ws in group:
            n = len(ws)
            if n >= width:
                yield runs[at : at + n - width + 1]
            else:
                h = np.full(1, n, np.uint64)
                for k in range(n):
                    h = _mix((h ^ flat[at + k : at + k + 1]) + np.uint64(0x9E3779B97F4A7C15))
                yield h
            at += n

    for text in texts:
        group.append(text.split(" "))
        size += len(group[-1])
        if size > 200_000:
            yield from made()
            group, size = [], 0
    if group:
        yield from made()


def _marks(width: int):
    """Adds n and the parities of the shingles' numbers over MARK_BITS cells, as longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _WordHashes()
        for batch in batches:
            n, bits = [], []
            for h in shingles(batch["t"], width, kept):
                h = np.unique(h)
                n.append(len(h))
                bits.append(np.packbits((np.bincount((h >> np.uint64(40)).astype(np.int64) & MARK_BITS - 1, minlength=MARK_BITS) & 1).astype(np.uint8)).view(np.int64))
            out = batch.assign(n=np.array(n, np.int32))
            for k, column in enumerate(np.array(bits, np.int64).reshape(-1, MARK_BITS // 64).T):
                out[f"m{k}"] = column
            yield out

    return run


def frequency_classes(classes: DataFrame, width: int, buckets: int) -> np.ndarray:
    """Logarithms, in eighths of an octave, of the shingles counted in each of ``buckets`` buckets of hashes, over all texts.

    They order shingles and nothing else: with any order the pairs are the same, with this one there are few candidates.
    """
    block = min(4096, buckets)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, totals = _WordHashes(), np.zeros(buckets, np.int64)
        for batch in batches:
            for h in shingles(batch["t"], width, kept):
                np.add.at(totals, (h & np.uint64(buckets - 1)).astype(np.int64), 1)
        rows = [(k, x.tobytes()) for k, x in enumerate(np.minimum(totals, 2**32 - 1).astype(np.uint32).reshape(-1, block)) if x.any()]
        yield pd.DataFrame(rows, columns=["block", "counts"])

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in batch["counts"])
        logs = np.minimum(255, 8 * np.log2(total + 1)).astype(np.uint8)
        return pd.DataFrame({"block": batch["block"].iloc[:1], "logs": [logs.tobytes()]})

    counted = classes.select("t").mapInPandas(count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, logs binary")
    out = np.zeros(buckets, np.uint8)
    for row in counted.collect():  # one byte a bucket
        out[row.block * block : (row.block + 1) * block] = np.frombuffer(row.logs, np.uint8)
    return out


def similar_classes(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY, width: int = SHINGLE, buckets: int = BUCKETS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(classes, links): text classes with their shingles' number, and all pairs of classes with a Jaccard of at least ``similarity``.

    Copies are one class. A prefix filter makes it exact without comparing all pairs: in whatever one order of all shingles, two
    sets that similar share one among their first n - ceil(s n) + 1; the order is by rarity. Sizes, positions and parities rule
    out most of the rest, by bounds that no similar pair exceeds; what is left is compared shingle by shingle.
    A shingle that many classes share is salted: one side is spread, the other replicated over the salts. Shingles are made anew
    from the texts where they are needed, as shuffling them all costs far more. Joins are merged: the optimizer's estimates of
    these tables are too low for it to choose what to broadcast.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), squeeze(F.lower(F.col(text))).alias("t")).withColumn("class_id", F.sha2("t", 256))
    texts = rows.groupBy("class_id").agg(F.count("*").alias("n_copies"), F.min("k").alias("member"), F.min("t").alias("t")).where("t <> ''")
    marks = [f"m{k}" for k in range(MARK_BITS // 64)]
    schema = T.StructType([*texts.schema, T.StructField("n", T.IntegerType()), *(T.StructField(m, T.LongType()) for m in marks)])
    classes = cut(texts.mapInPandas(_marks(width), schema).withColumn("id", F.monotonically_increasing_id()))
    order = sc.broadcast(frequency_classes(classes, width, buckets))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, logs = _WordHashes(), order.value
        for batch in batches:
            out = []
            for c, h in zip(batch["id"], shingles(batch["t"], width, kept), strict=True):
                h = np.unique(h)
                n = len(h)
                q = logs[(h & np.uint64(buckets - 1)).astype(np.int64)]
                first = np.argsort(q, kind="stable")[: n - math.ceil(n * similarity - 1e-9) + 1]
                q, pos = q[first], np.arange(len(first))
                shared = q > 8  # a bucket of one shingle pairs nothing
                out.append((np.full(shared.sum(), c, np.int64), np.full(shared.sum(), n, np.int32), pos[shared].astype(np.int32), h[first][shared].view(np.int64), np.ceil(2.0 ** (q[shared] / 8) / hot).astype(np.int32)))
            yield pd.DataFrame(dict(zip(("id", "n", "pos", "h", "salts"), map(np.concatenate, zip(*out, strict=True)), strict=True)) if out else {"id": [], "n": [], "pos": [], "h": [], "salts": []})

    prefix = classes.select("id", "t").mapInPandas(prefixes, "id bigint, n int, pos int, h bigint, salts int")
    a = prefix.select("h", F.pmod(F.hash("id"), F.col("salts")).alias("salt"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    b = prefix.select("h", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    # sizes must be near, and what stands behind the shared shingle must be able to make up the overlap
    sizes = (F.col("nb") >= F.col("na") * similarity - 1e-9) & (F.col("na") >= F.col("nb") * similarity - 1e-9)
    room = 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1) + F.least("pa", "pb")
    need = (F.col("na") + F.col("nb")) * (similarity / (1 + similarity))
    pairs = a.hint("merge").join(b, ["h", "salt"]).where((F.col("a") < F.col("b")) & sizes & (room >= need - 1e-9)).select("a", "b").distinct()
    # cells of unlike parity are at most as many as the shingles that only one of the two has
    ma = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), *(F.col(m).alias(f"a{m}") for m in marks))
    mb = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), *(F.col(m).alias(f"b{m}") for m in marks))
    unlike = reduce(Column.__add__, (F.bit_count(F.col(f"a{m}").bitwiseXOR(F.col(f"b{m}"))) for m in marks))
    near = cut(pairs.hint("merge").join(ma, "a").hint("merge").join(mb, "b").where(unlike <= F.col("na") + F.col("nb") - 2 * need + 1e-9).select("a", "b"))
    ends = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    left = classes.select("id", "class_id", "t").hint("merge").join(ends, "id", "left_semi")
    sides = near.hint("merge").join(left.select(F.col("id").alias("a"), F.col("class_id").alias("ca"), F.col("t").alias("ta")), "a").hint("merge").join(left.select(F.col("id").alias("b"), F.col("class_id").alias("cb"), F.col("t").alias("tb")), "b").select("ca", "ta", "cb", "tb")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _WordHashes()
        for batch in batches:
            scores = []
            for x, y in zip(shingles(batch["ta"], width, kept), shingles(batch["tb"], width, kept), strict=True):
                x, y = np.unique(x), np.unique(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                scores.append(both / (len(x) + len(y) - both))
            yield pd.DataFrame({"a": np.minimum(batch["ca"], batch["cb"]), "b": np.maximum(batch["ca"], batch["cb"]), "jaccard": np.array(scores, float)})

    both = sides.mapInPandas(compare, "a string, b string, jaccard double")
    return classes.select("class_id", "n_copies", "member", "n"), both.where(F.col("jaccard") >= similarity - 1e-12).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def near_duplicates(docs: DataFrame, key: str, text: str, similarity: float = SIMILARITY) -> DataFrame:
    """key, class_id, n_copies, n_links of every document: its text class, the class's copies and similar other classes."""
    classes, links = similar_classes(docs, key, text, similarity)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    per_class = classes.select("class_id", "n_copies").hint("merge").join(ends, "class_id", "left").na.fill(0, ["n_links"])
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.sha2(squeeze(F.lower(F.col(text))), 256).alias("class_id"))
    return rows.hint("merge").join(per_class, "class_id").select(key, "class_id", "n_copies", "n_links")


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over one big integer."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2.0 * lcs_length(a, b) / (len(a) + len(b))


def similarity_scores(pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds <column>_score for columns given as left_<column>, right_<column>, and their mean as combined."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["left_id", "right_id"]].copy()
            for c in columns:
                out[f"{c}_score"] = [round(indel_ratio((x or "").casefold(), (y or "").casefold()), 9) for x, y in zip(batch[f"left_{c}"], batch[f"right_{c}"], strict=True)]
            out["combined"] = out[[f"{c}_score" for c in columns]].mean(axis=1).round(9)
            yield out

    schema = "left_id string, right_id string, " + ", ".join(f"{c}_score double" for c in columns) + ", combined double"
    return pairs.mapInPandas(run, schema)
