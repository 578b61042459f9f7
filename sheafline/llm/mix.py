"""Mixing sources to target shares by Pareto order sampling.

Sizes are tokens of a public tokenizer (a parameter; the file is read where it lies). The total is the tokens of all documents
whose source has a target. A source is owed its share of it: every document is taken as many whole times as the owed tokens
allow for all (certain copies), at most ``max_repeats``; for the rest, documents are drawn with inclusion odds in
proportion to their size. Pareto order sampling ranks them by random odds over inclusion odds and takes the first n, which
has a fixed sample size at unequal probabilities. The random number of a document is a hash of its id and a seed, so a
lost executor or another partitioning changes nothing.

No source is ever gathered in one task: inclusion odds are in proportion to the documents' exact sizes; their rate is solved
on a histogram of sizes (exact ones below ``EXACT`` tokens, 64 bins per doubling above, each by its mean), and the n-th rank is found by counting ranks in bins, so that only the documents of the one bin at the border are sorted.

Edge cases: null texts have no tokens and are never taken; null sources have no target; a document row given twice is one
document; sources without documents, targets of null or zero share and repeats below one give a source that falls short or
takes nothing; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the public split pattern of that vocabulary (fixed value)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANK_BINS = 1 << 16
SEED = 20240
#: longer texts are encoded in pieces of about so many characters, cut where the split pattern has a boundary in any case
PIECE = 200_000
#: sizes below so many tokens have a bin each
EXACT = 4096


def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("sheafline", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)|(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        m = _BOUNDARY.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens; one row per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for batch in batches:
            sizes = [sum(len(x) for p in _pieces(t) for x in [enc.encode_ordinary(p)]) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": sizes})

    docs = spread(documents).where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return docs.mapInPandas(run, "doc_id bigint, source string, tokens bigint").dropDuplicates(["doc_id"])


def owed(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its documents and tokens, what it is owed, and whether it falls short. As many rows as targets."""
    t = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("int").alias("max_repeats"))
    have = sizes.where("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tokens").alias("tokens"))
    joined = t.join(have, "source", "left").na.fill(0, ["n_docs", "tokens"])
    total = joined.agg(F.sum("tokens").alias("total"))  # one row
    return joined.crossJoin(F.broadcast(total)).withColumn("owed", F.col("target_share") * F.col("total")).withColumn("short", (F.col("tokens") == 0) | (F.greatest(F.col("max_repeats"), F.lit(0)) * F.col("tokens") < F.col("owed")))


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    return owed(token_sizes(documents, tokenizer), targets).where("short").select("source")


def inclusion_rate(bins: list[tuple[float, int, float]], wanted: float) -> float:
    """c with sum over documents of min(1, c * size) * size = wanted, by bisection over (size, documents, tokens)."""
    if wanted <= 0 or not bins:
        return 0.0
    if wanted >= sum(t for _, _, t in bins):
        return math.inf
    lo, hi = 0.0, 1.0 / min(s for s, _, _ in bins if s > 0)
    for _ in range(80):
        mid = (lo + hi) / 2
        got = sum(min(1.0, mid * s) * t for s, _, t in bins)
        lo, hi = (mid, hi) if got < wanted else (lo, mid)
    return (lo + hi) / 2


def mixture(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """doc_id, source, tokens, copies of every document taken at least once."""
    from sheafline.session import cut

    spark = documents.sparkSession
    sizes = cut(token_sizes(documents, tokenizer).where("tokens > 0 and source is not null"))
    plan = {r.source: r for r in owed(sizes, targets).collect()}  # one row a target
    size_bin = F.when(F.col("tokens") < EXACT, F.col("tokens")).otherwise(EXACT + F.floor(F.log2(F.col("tokens")) * 64)).cast("int")
    histogram: dict[str, list[tuple[float, int, float]]] = {}
    for r in sizes.groupBy("source", size_bin.alias("b")).agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect():  # at most EXACT bins a source, and 64 per doubling beyond
        histogram.setdefault(r.source, []).append((r.t / r.n, r.n, float(r.t)))
    rows = []
    for source, r in plan.items():
        if not r.tokens or r.max_repeats < 1:
            continue
        whole = min(int(r.owed // r.tokens), r.max_repeats)
        rest = r.owed - whole * r.tokens if whole < r.max_repeats else 0.0
        c = inclusion_rate(histogram[source], rest)
        expected = sum(min(1.0, c * s) * n for s, n, _ in histogram[source]) if c != math.inf else float(r.n_docs)
        rows.append((source, whole, min(c, 1e9), int(round(expected))))
    rates = spark.createDataFrame(rows, "source string, whole int, rate double, draw long")
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    lam = F.least(F.lit(1.0), F.col("rate") * F.col("tokens"))
    ranked = sizes.join(F.broadcast(rates), "source").withColumn("lam", lam).withColumn("u", u)
    # random odds over inclusion odds; the certain ones come first
    odds = F.when(F.col("lam") >= 1.0, F.lit(0.0)).when(F.col("lam") <= 0.0, F.lit(1e300)).otherwise((F.col("u") / (1 - F.col("u"))) / (F.col("lam") / (1 - F.col("lam"))))
    ranked = ranked.withColumn("q", odds).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * (RANK_BINS - 1)).cast("int"))
    counted = ranked.groupBy("source", "bin").agg(F.count("*").alias("in_bin"))  # at most RANK_BINS rows a source
    w = Window.partitionBy("source").orderBy("bin")
    before = counted.withColumn("before", F.sum("in_bin").over(w) - F.col("in_bin"))
    border = before.join(F.broadcast(rates.select("source", "draw")), "source").where((F.col("before") < F.col("draw")) & (F.col("before") + F.col("in_bin") > F.col("draw"))).select("source", F.col("bin").alias("border_bin"), (F.col("draw") - F.col("before")).alias("still"))
    full = before.join(F.broadcast(rates.select("source", "draw")), "source").where(F.col("before") + F.col("in_bin") <= F.col("draw")).groupBy("source").agg(F.max("bin").alias("full_to"))
    placed = ranked.join(F.broadcast(border), "source", "left").join(F.broadcast(full), "source", "left")
    at_border = placed.where(F.col("bin") == F.col("border_bin"))
    nth = F.row_number().over(Window.partitionBy("source", "bin").orderBy("q", "doc_id"))
    drawn_border = at_border.withColumn("nth", nth).where(F.col("nth") <= F.col("still")).select("doc_id")
    drawn = placed.where(F.col("bin") <= F.coalesce("full_to", F.lit(-1))).select("doc_id").unionByName(drawn_border).withColumn("extra", F.lit(1))
    taken = ranked.select("doc_id", "source", "tokens", "whole").join(drawn, "doc_id", "left")
    return taken.withColumn("copies", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def reached(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """Per target source: target and reached share of the total, documents, copies and tokens taken."""
    got = mixture(documents, targets, tokenizer, seed).groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    joined = t.join(got, "source", "left").na.fill(0, ["n_docs", "n_copies", "tokens"])
    total = joined.agg(F.sum("tokens").alias("all_tokens"))
    return joined.crossJoin(F.broadcast(total)).select("source", F.round("target_share", 6).alias("target_share"), F.round(F.col("tokens") / F.greatest(F.col("all_tokens"), F.lit(1)), 6).alias("reached_share"), "n_docs", "n_copies", "tokens")
