"""An inverted index over chunks: terms, postings, BM25, and a small query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafline.functions.text import terms


def postings(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """term, key, tf, positions."""
    t = chunks.select(key, F.posexplode(terms(F.col(text))).alias("pos", "term"))
    return t.groupBy("term", key).agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def term_counts(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """term, df, cf: chunks that hold a term, occurrences."""
    t = chunks.select(key, F.explode(terms(F.col(text))).alias("term"))
    per = t.groupBy("term", key).agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    """BM25 weight of a term; one in at least half of all chunks weighs next to nothing."""
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def _same(word: str):
    return lambda x: x == word


def bm25(chunks: DataFrame, words: list[str], key: str = "id", text: str = "text") -> DataFrame:
    """key, score of the chunks that hold all words; smaller is better. Only the query's words are gathered."""
    wanted = list(dict.fromkeys(words))
    tokens = chunks.select(key, terms(F.col(text)).alias("ts"))
    lengths = tokens.select(key, F.size("ts").alias("dl"), *[F.size(F.filter("ts", _same(w))).alias(f"tf{i}") for i, w in enumerate(wanted)])
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("bigint")).alias(f"df{i}") for i in range(len(wanted))])  # one row
    hits = lengths.where(" and ".join(f"tf{i} > 0" for i in range(len(wanted)))).crossJoin(F.broadcast(stats))
    norm = 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl"))
    score = sum((idf(F.col("n"), F.col(f"df{i}")) * (F.col(f"tf{i}") * 2.2) / (F.col(f"tf{i}") + norm) for i in range(len(wanted))), F.lit(0.0))
    return hits.select(key, (-score).alias("score"))


# ---- query language ----------------------------------------------------------------------------------------------


class QueryError(ValueError):
    """The search query has a syntax error."""


@dataclass(frozen=True)
class Node:
    op: str  # term, prefix, phrase, near, first, and, or, not
    args: tuple = ()


_LEX = re.compile(r'\s*(?:(?P<phrase>"(?:[^"]|"")*")|(?P<lp>\()|(?P<rp>\))|(?P<near>NEAR\s*\()|(?P<word>[^\s()"]+))')


def parse(query: str) -> Node:
    """AND (also implied), OR, NOT, "phrases", prefix*, NEAR(a b, n), ^first, text: and parentheses."""
    tokens: list[tuple[str, str]] = []
    at = 0
    query = query.strip()
    while at < len(query):
        near = re.match(r"\s*NEAR\s*\(", query[at:])
        if near:
            end = query.find(")", at)
            if end < 0:
                raise QueryError("NEAR is not closed")
            tokens.append(("near", query[at + near.end() : end]))
            at = end + 1
            continue
        m = _LEX.match(query, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected text at {at}")
        tokens.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    if not tokens:
        raise QueryError("empty query")
    pos = 0

    def peek() -> tuple[str, str] | None:
        return tokens[pos] if pos < len(tokens) else None

    def atom() -> Node:
        nonlocal pos
        t = peek()
        if t is None:
            raise QueryError("a term is missing")
        pos += 1
        kind, text = t
        if kind == "lp":
            inner = either()
            if peek() is None or peek()[0] != "rp":
                raise QueryError("a parenthesis is not closed")
            pos += 1
            return inner
        if kind == "rp" or text in ("AND", "OR"):
            raise QueryError(f"unexpected {text}")
        if kind == "near":
            inside, _, dist = text.partition(",")
            return Node("near", (tuple(_plain(inside)), int(dist) if dist.strip() else 10))
        text = re.sub(r"^text\s*:\s*", "", text)
        if not text and peek():
            return atom()
        if kind == "phrase":
            ws = _plain(text.strip('"'))
            return Node("phrase", tuple(ws)) if len(ws) > 1 else Node("term", tuple(ws))
        if text.startswith("^"):
            return Node("first", tuple(_plain(text[1:])))
        if text.endswith("*"):
            return Node("prefix", tuple(_plain(text[:-1])))
        ws = _plain(text)
        if not ws:
            raise QueryError(f"no term in {text}")
        return Node("term", (ws[0],)) if len(ws) == 1 else Node("phrase", tuple(ws))

    def both() -> Node:
        nonlocal pos
        left = atom()
        while (t := peek()) and t[1] != "OR" and t[0] != "rp":
            if t[1] == "NOT":
                pos += 1
                left = Node("not", (left, atom()))
            else:
                if t[1] == "AND":
                    pos += 1
                left = Node("and", (left, atom()))
        return left

    def either() -> Node:
        nonlocal pos
        left = both()
        while (t := peek()) and t[1] == "OR":
            pos += 1
            left = Node("or", (left, both()))
        return left

    tree = either()
    if pos != len(tokens):
        raise QueryError("unbalanced parenthesis")
    return tree


def _plain(text: str) -> list[str]:
    import unicodedata

    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [w for w in re.split(r"[\W_]+", flat) if w]


def _holds(node: Node, ts: Column) -> Column:
    """Does an array of terms satisfy the node? Evaluated in the scan, without a shuffle."""
    if node.op == "and":
        return _holds(node.args[0], ts) & _holds(node.args[1], ts)
    if node.op == "or":
        return _holds(node.args[0], ts) | _holds(node.args[1], ts)
    if node.op == "not":
        return _holds(node.args[0], ts) & ~_holds(node.args[1], ts)
    if node.op == "term":
        return F.array_contains(ts, node.args[0])
    if node.op == "prefix":
        return F.exists(ts, lambda x: x.startswith(node.args[0]))
    if node.op == "first":
        return F.coalesce(F.get(ts, 0) == node.args[0], F.lit(False))
    if node.op == "phrase":
        joined = F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" "))
        return joined.contains(" " + " ".join(node.args) + " ")
    ws, dist = node.args
    places = F.transform(ts, lambda x, i: F.when(x.isin(*ws), i))
    starts = F.filter(places, lambda p: p.isNotNull())
    window = lambda p: F.slice(ts, p + 1, dist + len(ws))
    every = lambda part: F.lit(len(ws)) == F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.array_contains(part, w)))
    return F.exists(starts, lambda p: every(window(p)))


def match(chunks: DataFrame, query: str, text: str = "text") -> DataFrame:
    """The chunks a query matches."""
    tree = parse(query)
    # bound once: the terms are not made again for every position looked at
    return chunks.where(F.element_at(F.transform(F.array(terms(F.col(text))), lambda ts: _holds(tree, ts)), 1))


def _once(c: Column, f) -> Column:
    """f of a column that is evaluated once, however often f names it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def _phrases(node: Node, ts: Column) -> list[tuple[Column, Column]]:
    """(does the text hold it, its hits) of each term and phrase that isn't negated. As in FTS5, NEAR counts the hits within
    its distance only, and a branch of OR counts only where it holds as a whole."""
    if node.op == "and":
        return _phrases(node.args[0], ts) + _phrases(node.args[1], ts)
    if node.op == "not":
        return _phrases(node.args[0], ts)
    if node.op == "or":
        return [(has, F.when(_holds(a, ts), n).otherwise(0)) for a in node.args for has, n in _phrases(a, ts)]
    if node.op == "near":
        ws, dist = node.args
        wide = dist + len(ws)
        every = lambda part: F.forall(F.array(*[F.lit(w) for w in ws]), lambda w: F.array_contains(part, w))
        places = F.transform(ts, lambda x, i: F.when(x.isin(*ws), i))
        starts = F.filter(places, lambda p: p.isNotNull() & every(F.slice(ts, p + 1, wide)))
        near = lambda w: _once(starts, lambda at: F.size(F.filter(F.transform(ts, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull() & F.exists(at, lambda p: (p <= i) & (i < p + wide)))))
        return [(F.array_contains(ts, w), near(w)) for w in ws]
    if node.op == "phrase":
        k = len(node.args)
        hits = F.size(F.filter(F.transform(ts, lambda x, i: F.when(x == node.args[0], F.slice(ts, i + 1, k))), lambda part: F.coalesce(part == F.array(*[F.lit(w) for w in node.args]), F.lit(False))))
    elif node.op == "prefix":
        hits = F.size(F.filter(ts, lambda x: x.startswith(node.args[0])))
    elif node.op == "first":
        hits = _holds(node, ts).cast("int")
    else:
        hits = F.size(F.filter(ts, _same(node.args[0])))
    return [(_holds(node, ts), hits)]


def ranked(chunks: DataFrame, query: str, keys: tuple[str, ...] = ("id",), text: str = "text") -> DataFrame:
    """keys, score of every chunk the query matches; smaller is better."""
    tree = parse(query)

    def counted(ts: Column) -> Column:
        parts = _phrases(tree, ts)
        return F.struct(F.size(ts).alias("dl"), _holds(tree, ts).alias("hit"), F.array(*[has for has, _ in parts]).alias("has"), F.array(*[n for _, n in parts]).alias("tf"))

    width = len(_phrases(tree, F.lit(None)))
    rows = chunks.where(F.col(text).isNotNull()).select(*keys, _once(terms(F.col(text)), counted).alias("c")).select(*keys, "c.*")
    stats = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum(F.get("has", F.lit(i)).cast("bigint")).alias(f"df{i}") for i in range(width)])  # one row
    norm = 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl"))
    tf = lambda i: F.get("tf", F.lit(i))
    score = sum((idf(F.col("n"), F.col(f"df{i}")) * (tf(i) * 2.2) / (tf(i) + norm) for i in range(width)), F.lit(0.0))
    return rows.where("hit").crossJoin(F.broadcast(stats)).select(*keys, (-score).alias("score"))


def search(chunks: DataFrame, query: str, limit: int = 20, key: str = "id", tie: tuple[str, ...] = ("concept_id", "ordinal")) -> DataFrame:
    """The best chunks by BM25 summed over the query's positive terms and phrases, ties by path and ordinal."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    if not query.strip():
        return chunks.select(key, *tie).withColumn("score", F.lit(0.0)).limit(0)
    return ranked(chunks, query, (key, *tie)).orderBy("score", *tie).limit(limit)


def substring_hits(concepts: DataFrame, needle: str, columns: tuple[str, ...]) -> DataFrame:
    """Case-insensitive substring search over several columns."""
    low = needle.lower()
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False))
    return concepts.where(cond)


def index_delta(old: DataFrame, new: DataFrame, key: str = "id", digest: str = "hash") -> DataFrame:
    """key, action (added, changed, removed, kept) between two index states."""
    o = old.select(key, F.col(digest).alias("old_hash"))
    n = new.select(key, F.col(digest).alias("new_hash"))
    action = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "changed").otherwise("kept")
    return o.join(n, key, "full_outer").select(key, action.alias("action"))
