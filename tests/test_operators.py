import hashlib
import itertools
import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from sheafline.operators import attest, claims, concepts, dedupe, diff, graph, incremental, quality, reports, search, vectors
from sheafline.plans import minisql


# ---- chunks ------------------------------------------------------------------------------------------------------


def pack_plainly(blocks, limit):
    out, open_, heading = [], None, None
    for n, (kind, text) in enumerate(blocks):
        if open_ and (kind == "heading" or open_["size"] + len(text) > limit):
            out.append(open_)
            open_ = None
        if kind == "heading":
            heading = text.lstrip("#").strip()
        if open_ is None:
            open_ = {"heading": heading, "ordinals": [], "text": "", "size": 0}
        open_["ordinals"].append(n)
        open_["text"] += ("\n\n" if open_["text"] else "") + text
        open_["size"] += len(text)
        if kind in ("table", "code"):
            out.append(open_)
            open_ = None
    return out + ([open_] if open_ else [])


def test_chunk_packing_against_plain_loop(spark):
    bodies = {
        "a.md": "# T\n\nalpha beta\n\n| a | b |\n| --- | --- |\n\ngamma\n\n## U\n\n" + "x" * 30 + "\n\n" + "y" * 25,
        "b.md": "",
        "c.md": "only",
        "d.md": "\n\n# H\n\n" + "\n\n".join("w" * k for k in range(1, 25)),
    }
    df = spark.createDataFrame(list(bodies.items()), "concept_id string, body string")
    got = concepts.chunks_of(df, max_chars=40).collect()
    for key, body in bodies.items():
        blocks = [(r.kind, r.text) for r in sorted(concepts.blocks(df).where(F.col("concept_id") == key).collect(), key=lambda r: r.ordinal)]
        want = pack_plainly(blocks, 40)
        mine = sorted((r for r in got if r.concept_id == key), key=lambda r: r.ordinal)
        assert [(r.heading, r.text, r.oversize) for r in mine] == [(w["heading"], w["text"], w["size"] > 40) for w in want]


# ---- search ------------------------------------------------------------------------------------------------------

TEXTS = ["the quick brown fox", "quick quick fox jumps over the lazy dog", "brown dog sleeps", "a fox and a dog and a fox", "élan vital café", "", "dog " * 30, "nothing here at all but words"]


@pytest.fixture()
def little(spark):
    return spark.createDataFrame([(str(i), f"c{i}.md", i, t) for i, t in enumerate(TEXTS)], "id string, concept_id string, ordinal int, text string")


def fts(query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text)")
    con.executemany("insert into f(rowid, text) values (?, ?)", [(i + 1, t) for i, t in enumerate(TEXTS)])
    return {str(r[0] - 1): r[1] for r in con.execute("select rowid, bm25(f) from f where f match ?", (query,))}


@pytest.mark.parametrize("query", ["fox", "quick AND fox", "fox dog", "fox OR sleeps", "dog NOT fox", '"quick brown"', "qui*", "(fox OR dog) NOT lazy", "NEAR(fox dog, 3)", "^quick", "cafe", '"a fox"'])
def test_matches_follow_fts5(little, query):
    assert {r.id for r in search.match(little, query).collect()} == set(fts(query))


@pytest.mark.parametrize("words", [["fox"], ["quick", "fox"], ["dog"]])
def test_bm25_follows_fts5(little, words):
    got = {r.id: r.score for r in search.bm25(little, words).collect()}
    want = fts(" AND ".join(words))
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_search_limits_and_errors(little):
    assert [r.id for r in search.search(little, "fox", 2).collect()] == [k for k, _ in sorted(fts("fox").items(), key=lambda x: (x[1], f"c{x[0]}.md"))[:2]]
    assert search.search(little, "  ", 3).count() == 0
    with pytest.raises(ValueError):
        search.search(little, "fox", 0)
    for bad in ("(fox", "fox AND", "OR fox", "NEAR(a b"):
        with pytest.raises(search.QueryError):
            search.parse(bad)


@pytest.mark.parametrize("query", ["fox OR sleeps", "fox AND (quick OR sleeps)", "dog NOT fox", "dog NOT (fox AND lazy)", '"quick fox" OR sleeps', '"a fox"', "qui*", "^quick OR brown", "sleeps OR (fox AND lazy)", "NEAR(fox dog, 3)", "NEAR(a fox, 1) OR brown", "fox OR fox"])
def test_ranks_of_every_query_follow_fts5(little, query):
    want = fts(query)
    got = search.search(little, query, 20).collect()
    assert {r.id: r.score for r in got} == pytest.approx(want, rel=1e-9)
    assert [r.id for r in search.search(little, query, 2).collect()] == [r.id for r in got][:2] and [r.score for r in got] == sorted(r.score for r in got)


def test_index_delta(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "id string, hash string")
    assert {r.id: r.action for r in search.index_delta(old, new).collect()} == {"a": "removed", "b": "kept", "c": "changed", "d": "added"}


# ---- graph -------------------------------------------------------------------------------------------------------


def test_traversals(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a"), ("b", "c")], "from_id string, to_id string")
    s = spark.createDataFrame([("a",)], "id string")
    assert {r.id: r.level for r in graph.reachable(e, s, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.id: r.level for r in graph.impact(e, s).collect()} == {"b": 1, "c": 2, "d": 3}
    assert {r.id for r in graph.reachable(e, s, 1, both_ways=True).collect()} == {"a", "b", "c", "x"}
    assert [(r.id, r.score) for r in graph.related(e, "b").collect()] == [("c", 2), ("a", 1)]
    assert graph.reachable(e, spark.createDataFrame([], "id string"), 3).count() == 0


def test_impact_goes_on_to_the_end_and_back(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n70", "n66"), ("n2", "n0")], "from_id string, to_id string")
    got = {r.id: r.level for r in graph.impact(e, spark.createDataFrame([("n0",)], "id string"), returning=True).collect()}
    assert got == {**{f"n{i}": i for i in range(1, 71)}, "n0": 3}
    assert graph.impact(e, spark.createDataFrame([("n70",)], "id string"), returning=True).where("id = 'n70'").first().level == 5


def test_edges_and_links(spark):
    c = spark.createDataFrame(
        [("1", "k/alpha.md", "s1", ["Intro"], "See [Beta](beta.md) and [Beta](beta.md), [out](https://x.example/), [gone](none.md). Alice Smith wrote it."), ("2", "k/beta.md", "s2", [], "text")],
        "id string, concept_id string, source_sha256 string, heading_path array<string>, text string",
    )
    edges = graph.build_edges(c).collect()
    linked = [x for x in edges if x.method == "markdown_link/v1"]
    assert [(x.from_id, x.to_id) for x in linked] == [("concept:k/alpha.md", "concept:k/beta.md")] * 2  # repeated links stay
    assert sum(x.kind == "contains" for x in edges) == 2 and sum(x.method == "capitalized_entity/v1" for x in edges) == 1
    bodies = c.select("concept_id", F.col("text").alias("body"))
    assert {(r.source, r.target) for r in graph.unresolved(bodies).collect()} == {("k/alpha.md", "k/none.md")}
    assert graph.orphans(bodies, graph.concept_links(bodies)).count() == 0


def test_linkify_against_plain_loop(spark):
    rows = [
        ("a/ledger.md", "Ledger", "The LEDGER and the big ledger, subledgers, ledger.txt and [Ledger](x.md)."),
        ("a-b.md", "Big Ledger", "A ledger; one Big ledgers, the Big Ledger. Café notes, cafénotes"),
        ("a/z.md", "ledger ", "Only the ledger itself, and C++ (draft) work"),
        ("b/cafe.md", "Café Notes", "see CAFÉ notes, (Big Ledger), path/Big Ledger, x-ledger, ledger"),
        ("b/c.md", "C++", "nothing of it"),
        ("b/d.md", "ab", "ab ab"),
        ("b/e.md", "Same", "ſame Same"),
        ("c/f.md", "Same", "Same again, \\1 same"),
        ("c/g.md", "Reading \\d Room", "a reading \\D room"),
        ("c/h.md", None, "Reading \\d Room and Same"),
        ("c/i.md", "Void", None),
    ]
    by_title = {}
    for path, title, _ in sorted(rows, key=lambda r: r[0].split("/")):
        if title:
            by_title[title.strip()] = path
    want = {}
    for path, _, body in rows:
        new, used = body or "", []
        for title, target in by_title.items():
            if target != path and len(title) >= 3:
                new, n = re.subn(rf"(?<![(\[A-Za-z0-9_./\-])\b{re.escape(title)}\b(?![A-Za-z0-9_./\-])", lambda m, t=title, p=target: f"[{t}]({p})", new, flags=re.IGNORECASE)
                used += [(target, title)] * bool(n)
        if used:
            want[path] = (new, used)
    df = spark.createDataFrame(rows, "concept_id string, title string, body string").repartition(3)
    got = {r.concept_id: (r.body, [tuple(m) for m in r.mentions]) for r in graph.linkify(df).collect()}
    assert got == want
    assert got["a-b.md"][0].startswith("A [Ledger](a/ledger.md); one Big ledgers") and "b/d.md" not in got


# ---- duplicates --------------------------------------------------------------------------------------------------


def test_near_duplicates_against_all_pairs(spark):
    base = [f"w{k}" for k in range(40)]
    texts = {1: " ".join(base), 2: " ".join(base[:-1] + ["other"]), 3: " ".join(base[:20] + ["x", "y", "z"] + base[20:]), 4: "  ".join(base).upper(), 5: "short", 6: "short text", 7: None, 8: "", 9: " ".join(f"q{k}" for k in range(40)), 10: " ".join(base[1:])}
    df = spark.createDataFrame([(k, t, "extra") for k, t in texts.items()], "doc_id bigint, text string, class_id string").drop("class_id")

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    norm = {k: " ".join(t.lower().split()) for k, t in texts.items() if t is not None}
    classes = {}
    for k, n in norm.items():
        classes.setdefault(n, []).append(k)
    links = dict.fromkeys(classes, 0)
    for a, b in itertools.combinations(classes, 2):
        x, y = grams(a), grams(b)
        if x and y and len(x & y) / len(x | y) >= 0.8:
            links[a] += 1
            links[b] += 1
    got = {r.doc_id: (r.n_copies, r.n_links) for r in dedupe.near_duplicates(df, "doc_id", "text").collect()}
    want = {k: (len(classes[n]), links[n]) for k, n in norm.items() if n}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_near_duplicates_whatever_the_order_of_shingles(spark):
    """Random copies with edits: one bucket (no order by rarity) and salts for every shingle give the pairs of brute force."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.choice([1, 4, 5, 6, 60, 90, 120, 400, 700]))) for _ in range(24)]
    for t in list(texts):
        ws = t.split(" ")
        for _ in range(4):
            new = list(ws)
            for _ in range(rng.randint(1, max(1, len(ws) // 80))):
                new[rng.randrange(len(new))] = "edit"
            texts.append(" ".join(new[rng.randint(0, 2) :] or new))
    texts = sorted(set(texts))
    grams = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split(" ") for t in texts)]
    want = {tuple(sorted((texts[i], texts[j]))) for i, j in itertools.combinations(range(len(texts)), 2) if len(grams[i] & grams[j]) / len(grams[i] | grams[j]) >= 0.8}
    by = {hashlib.sha256(t.encode()).hexdigest(): t for t in texts}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for more in ({}, {"buckets": 1, "hot": 20}):
        _, links = dedupe.similar_classes(df, "doc_id", "text", **more)
        got = [tuple(sorted((by[r.a], by[r.b]))) for r in links.collect()]
        assert set(got) == want and len(got) == len(want) > 20, more


def test_near_duplicates_broadcast_no_table_and_make_pairs_once(spark):
    """Texts and shingles are larger than the optimizer takes them for: none goes through the driver."""
    df = spark.createDataFrame([(k, f"a b c d e f {k}") for k in range(9)], "doc_id bigint, text string")
    plan = dedupe.near_duplicates(df, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") < 8


def test_lcs_and_ratio():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for a, b in itertools.product(["", "abc", "abcbdab", "bdcaba", "kitten", "sitting"], repeat=2):
        assert dedupe.lcs_length(a, b) == plain(a, b)
    assert dedupe.indel_ratio("", "") == 1.0


# ---- claims, quality ---------------------------------------------------------------------------------------------


def test_claims_and_conflicts(spark):
    c = spark.createDataFrame([("1", "Owner: Alice\nbudget $10"), ("2", "owner: Bob\n$10.50 on 2024-01-02"), ("3", "Owner:  ALICE"), ("4", None)], "id string, text string")
    found = claims.claims(c, "id", "text", F.lit("bundle"))
    assert {(r.kind, r.value) for r in found.collect()} == {("owner", "alice"), ("owner", "bob"), ("amount", "10"), ("amount", "10.50"), ("date", "2024-01-02")}
    con = {r.kind: r.n_conflicts for r in claims.conflicts(found).collect()}
    assert con == {"owner": 2, "amount": 1}
    assert claims.capped(found, 3).first().too_many


def test_conflict_counts_equal_enumerated_pairs(spark):
    vals = ["a", "b", "a", "c", "b", "a"]
    df = spark.createDataFrame([("s", "owner", v) for v in vals], "scope string, kind string, value string")
    assert claims.conflicts(df).first().n_conflicts == sum(x != y for x, y in itertools.combinations(vals, 2))


def test_packs_inherit_and_reject_cycles(monkeypatch):
    assert [r[0] for r in quality.pack_rules("pii-safe")] == ["sources-required", "review-pending", "redaction-proposed"]
    monkeypatch.setitem(quality.PACKS, "loop", (("loop",), ()))
    with pytest.raises(ValueError):
        quality.pack_rules("loop")


def test_redaction(spark):
    df = spark.createDataFrame([(1, "sk-" + "a" * 24 + " and sk-short"), (2, None)], "k int, t string")
    assert quality.secrets(df, "k", "t").count() == 1
    assert df.select(quality.without_secrets(F.col("t")).alias("t")).first().t == "[REDACTED] and sk-short"


def test_health_rounds_half_to_even(spark):
    t, e = spark.createDataFrame([(200,)], "total bigint"), spark.createDataFrame([(5,)], "errors bigint")
    assert quality.health(t, e).first().score == 98  # 97.5


# ---- attestation -------------------------------------------------------------------------------------------------


def tree(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(b"\x01" + bytes.fromhex(tree(leaves[:k])) + bytes.fromhex(tree(leaves[k:]))).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_merkle_root_and_proofs(spark, n):
    rows = [(f"p{i:03}", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, leaf string")
    got = attest.merkle_root(df).first()
    assert got.n_leaves == n and got.root == (tree([x for _, x in rows]) if n else attest.EMPTY_ROOT)
    if n in (3, 5):
        proof = attest.proofs(df).collect()
        for path, leaf in rows:
            node = leaf
            for s in sorted((p for p in proof if p.path == path), key=lambda p: p.step):
                a, b = (node, s.sibling) if s.side == "right" else (s.sibling, node)
                node = hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()
            assert node == got.root


# ---- reports, sync, diff, vectors, SQL ---------------------------------------------------------------------------


def test_attachment_budget_skips_do_not_count(spark):
    df = spark.createDataFrame([(1, [("a", 5), ("b", 50), ("c", 5), ("d", 5)]), (2, [])], "canon_id int, attachments array<struct<filename:string,byte_size:bigint>>")
    r = reports.attachment_budget(df, 10, 2, 100).first()
    assert (r.n_kept, r.n_quarantined, r.bytes_kept) == (2, 2, 10)


def test_sync(spark):
    state = spark.createDataFrame([("s1", "a.txt", 1), ("s2", "b.txt", 3), ("s3", "c.txt", 1)], "source_sha256 string, current_relpath string, generation int")
    files = spark.createDataFrame([("a.txt", "s1"), ("0.txt", "s2"), ("b.txt", "s2"), ("n.txt", "s4")], "relpath string, sha256 string")
    assert {r.source_sha256: r.action for r in incremental.reconcile(state, files).collect()} == {"s1": "unchanged", "s2": "renamed", "s3": "deleted_candidate"}
    assert {r.source_sha256: (r.current_relpath, r.generation) for r in incremental.sync_merge(state, files).collect()} == {"s1": ("a.txt", 2), "s2": ("0.txt", 4), "s3": ("c.txt", 1), "s4": ("n.txt", 1)}


def test_element_changes():
    got = diff.element_changes("# A\n\none two three\n\nsame", "# A\n\nsame\n\none two four\n\nnew")
    assert [(s, k) for s, k, _, _ in got] == [("added", "paragraph"), ("modified", "paragraph"), ("moved", "paragraph"), ("unchanged", "heading")]


def test_cells(spark):
    df = spark.createDataFrame([("k", "| a | b |\n| --- | :---: |\n| 1 | x\\|y |")], "k string, t string")
    assert {(r.row, r.col): r.value for r in diff.cells(df, "k", "t").collect()} == {(0, 0): "a", (0, 1): "b", (1, 0): "1", (1, 1): "x\\|y"}


def test_nearest_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id bigint, embedding array<double>").repartition(5)
    got = vectors.nearest(df, df.where("vec_id % 20 = 0"), 4).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 200, 20):
        sims = u @ u[q]
        want = [i for i in sorted(range(200), key=lambda i: (-round(sims[i], 9), i)) if i != q][:4]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_mini_sql(spark):
    c = spark.createDataFrame([("a", "Note", None), ("b", "Doc", "x")], "concept_id string, type string, status string")
    run = lambda q: [tuple(r) for r in minisql.run(q, {"concepts": c, "links": c}).collect()]
    assert run("SELECT concept_id FROM concepts WHERE type = 'Note'") == [("a",)]
    assert run("select concept_id, nope from concepts where status != x") == [("a", None)]
    assert run("SELECT concept_id FROM concepts WHERE type LIKE '^d'") == [("b",)]
    assert run("SELECT concept_id FROM concepts WHERE concept_id IN (a, b)") == [("a",), ("b",)]
    assert len(run("SELECT * FROM concepts WHERE what is this")) == 2
    with pytest.raises(minisql.MiniSqlError):
        run("DROP TABLE concepts")
