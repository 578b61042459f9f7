"""The evidence graph of chunks, and traversals by rounds of joins."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import entities, joined_id, link_target, links, squeeze
from sheafline.session import cut, spread


def _topic(kind: str, label) -> object:
    return F.concat(F.lit(kind + ":"), joined_id(F.lit(kind), F.lower(squeeze(label))))


def build_edges(chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """kind, from_id, to_id, evidence, method, status: one row an edge; equal edges stay repeated.

    ``known`` holds concept_id of the link targets that exist; links to others are dropped.
    """
    chunk, concept = F.concat(F.lit("chunk:"), F.col("id")), F.concat(F.lit("concept:"), F.col("concept_id"))

    def edge(kind: str, a: Column, b: Column, method: str, status: str, target: Column | None = None) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), F.lit(method).alias("method"), F.lit(status).alias("status"), (F.lit(None).cast("string") if target is None else target).alias("target"))

    none = F.array().cast("array<string>")
    paths = F.transform(F.coalesce(links(F.col("text")), none), lambda raw: link_target(F.col("concept_id"), raw))
    # all edges of a chunk at once: the chunks are read once, and only link targets are joined
    found = F.concat(
        F.array(edge("contains", concept, chunk, "canonical_chunks/v1", "explicit")),
        F.when(F.col("source_sha256").isNotNull(), F.array(edge("cites", chunk, F.concat(F.lit("source:"), F.col("source_sha256")), "canonical_chunks/v1", "explicit"))).otherwise(F.array()),
        F.transform(F.coalesce("heading_path", none), lambda x: edge("mentions", chunk, _topic("topic", x), "heading_topic/v1", "unverified")),
        F.transform(F.coalesce(entities(F.col("text")), none), lambda x: edge("mentions", chunk, _topic("entity", x), "capitalized_entity/v1", "unverified")),
        F.transform(F.filter(paths, lambda t: t.isNotNull() & (t != F.col("concept_id"))), lambda t: edge("mentions", concept, F.concat(F.lit("concept:"), t), "markdown_link/v1", "explicit", t)),
    )
    rows = chunks.select(F.col("id").alias("evidence"), F.explode(found).alias("e")).select("evidence", "e.*")
    there = (known if known is not None else chunks).select(F.col("concept_id").alias("target")).where("target is not null").distinct().withColumn("there", F.lit(True))
    linked = rows.join(there, "target", "left").where("target is null or there")
    return linked.select("kind", "from_id", "to_id", "evidence", "method", "status")


def build_nodes(edges: DataFrame) -> DataFrame:
    """id, kind, degree_out, degree_in of every end of an edge."""
    ends = edges.select(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("degree_out"), F.sum("i").alias("degree_in")).select("id", F.substring_index("id", ":", 1).alias("kind"), "degree_out", "degree_in")


def concept_links(concepts: DataFrame, body: str = "body", key: str = "concept_id") -> DataFrame:
    """source, target, exists: the Markdown links of bodies; repeated links once."""
    raw = concepts.select(F.col(key).alias("source"), F.explode(links(F.col(body))).alias("raw"))
    pairs = raw.select("source", link_target(F.col("source"), F.col("raw")).alias("target")).where("target is not null and target <> source").distinct()
    there = concepts.select(F.col(key).alias("target"), F.lit(True).alias("there")).distinct()
    return pairs.join(there, "target", "left").select("source", "target", F.coalesce("there", F.lit(False)).alias("exists"))


def unresolved(concepts: DataFrame, body: str = "body", key: str = "concept_id") -> DataFrame:
    return concept_links(concepts, body, key).where("not exists").select("source", "target")


def _hops(edges: DataFrame, both_ways: bool) -> DataFrame:
    hop = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    if both_ways:
        hop = hop.unionByName(edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b")))
    return hop.distinct()


def _levels(hop: DataFrame, starts: DataFrame, depth: int | None) -> DataFrame:
    seen = starts.select("id").distinct().withColumn("level", F.lit(0))
    newest = seen
    level = 0
    while depth is None or level < depth:
        level += 1
        step = newest.join(hop, newest.id == hop.a).select(F.col("b").alias("id")).distinct()
        newest = cut(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
        if level % 16 == 0:
            seen = cut(seen)
    return seen


def reachable(edges: DataFrame, starts: DataFrame, depth: int, both_ways: bool = False) -> DataFrame:
    """id, level: what ``starts`` (id) reach in at most ``depth`` steps; every node once, at its smallest level.

    Each round joins only the newest level with the edges; the seen set is kept by anti-joins and cut by a checkpoint.
    """
    return _levels(_hops(edges, both_ways), starts, depth)


def impact(edges: DataFrame, starts: DataFrame, returning: bool = False) -> DataFrame:
    """id, level: the transitive outward closure, in rounds until one finds nothing new. The starts themselves are left out, or,
    with ``returning``, are in it where links lead back to one, at the length of the shortest way."""
    hop = cut(_hops(edges, False))  # joined in every round
    seen = _levels(hop, starts, None)
    out = seen.where("level > 0")
    if returning:
        back = hop.join(starts.select(F.col("id").alias("b")).distinct(), "b").join(seen, F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg((F.min("level") + 1).alias("level"))
        out = out.unionByName(back)
    return out


def related(edges: DataFrame, node: str, limit: int = 10) -> DataFrame:
    """Neighbours by the number of edges either way."""
    out = edges.where(F.col("from_id") == node).select(F.col("to_id").alias("id"))
    back = edges.where(F.col("to_id") == node).select(F.col("from_id").alias("id"))
    return out.unionByName(back).groupBy("id").agg(F.count("*").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def orphans(concepts: DataFrame, links_: DataFrame, key: str = "concept_id") -> DataFrame:
    """Concepts at neither end of a resolved link."""
    ends = links_.where("exists").select(F.col("source").alias(key)).unionByName(links_.where("exists").select(F.col("target").alias(key))).distinct()
    return concepts.select(key).join(ends, key, "left_anti")


def _whole_word(mention: str) -> re.Pattern:
    """A title as a word of its own, in any case; not at the start of a link's text or target, nor within a path."""
    return re.compile(rf"(?<![(\[A-Za-z0-9_./\-])\b{re.escape(mention)}\b(?![A-Za-z0-9_./\-])", re.IGNORECASE)


_WORDS = re.compile(r"[^\W_]+")
_DOTS = str.maketrans("İı", "ii")
#: bits of the filter of title beginnings; more titles only make it let more through
TITLE_BITS = 1 << 26


def _folded(text: str) -> list[str]:
    """Words under a fold that holds together whatever a regex without case does."""
    return _WORDS.findall(text.translate(_DOTS).casefold())


def _filter_of(titles: DataFrame) -> np.ndarray:
    """Bits of the hashes of the beginnings (shown) by words, and of whole titles with an end mark; of fixed size."""

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = set()
            for shown in batch["shown"]:
                h = 0
                for w in _folded(shown):
                    h = crc32(w.encode() + b" ", h)
                    out.add(h % TITLE_BITS)
                out.add(crc32(b"\0", h) % TITLE_BITS)
            yield pd.DataFrame({"bit": sorted(out)})

    at = titles.select("shown").mapInPandas(bits, "bit bigint")
    rows = at.groupBy(F.floor(F.col("bit") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("v")).collect()  # at most TITLE_BITS / 8
    out = np.zeros(TITLE_BITS // 8, np.uint8)
    for r in rows:
        out[r.byte] = r.v
    return out


def linkify(concepts: DataFrame, body: str = "body", key: str = "concept_id", title: str = "title", min_title: int = 3) -> DataFrame:
    """key, body, mentions (path, shown): bodies with the whole-word mentions of other concepts' titles turned into
    ``[title](path)``, one title after the other in the order of the paths; of equal titles the last path is linked. Bodies
    that change only.

    Titles meet bodies through their word sequences, not by a cross product: a filter lets through what may be a title, a join
    decides. A title without a word, or only in a path just linked, isn't mentioned.
    """
    held = concepts.select(F.col(key).alias("k"), F.col(body).alias("text")).where("k is not null and text is not null")
    stripped = F.regexp_replace(F.col(title), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")
    placed = concepts.where(F.col(key).isNotNull()).select(stripped.alias("shown"), F.split(key, "/").alias("parts")).where(F.length("shown") >= min_title)
    titled = placed.groupBy("shown").agg(F.min("parts").alias("first"), F.array_join(F.max("parts"), "/").alias("path"))
    shared = concepts.sparkSession.sparkContext.broadcast(_filter_of(titled))

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["words"] = [" ".join(_folded(t)) for t in batch["shown"]]
            yield batch

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = shared.value.tobytes()

        def there(h: int) -> int:
            h %= TITLE_BITS
            return bits[h >> 3] >> (h & 7) & 1

        for batch in batches:
            rows = []
            for k, text in zip(batch["k"], batch["text"], strict=True):
                words = _folded(text)
                coded = [w.encode() + b" " for w in words]
                hits = set()
                for i in range(len(words)):
                    h = 0
                    for j in range(i, len(words)):
                        h = crc32(coded[j], h)
                        if not there(h):
                            break
                        if there(crc32(b"\0", h)):
                            hits.add(" ".join(words[i : j + 1]))
                rows.extend((k, w) for w in hits)
            yield pd.DataFrame(rows, columns=["k", "words"])

    whole = titled.select("shown", "first", "path").mapInPandas(sequences, "shown string, first array<string>, path string, words string").where("words <> ''")
    offers = spread(held).mapInPandas(runs, "k string, words string").join(whole, "words").where("k <> path").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("first", "shown", "path"))).alias("offers"))

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = lru_cache(maxsize=20_000)(_whole_word)
        for batch in batches:
            rows = []
            for k, text, titles in zip(batch["k"], batch["text"], batch["offers"], strict=True):
                done = []
                for t in titles:
                    text, n = pattern(t["shown"]).subn(lambda m, t=t: f"[{t['shown']}]({t['path']})", text)
                    if n:
                        done.append({"path": t["path"], "shown": t["shown"]})
                if done:
                    rows.append((k, text, done))
            yield pd.DataFrame(rows, columns=["k", "text", "mentions"])

    linked = held.join(offers, "k").select("k", "text", "offers").mapInPandas(rewrite, "k string, text string, mentions array<struct<path:string,shown:string>>")
    return linked.select(F.col("k").alias(key), F.col("text").alias(body), "mentions")
