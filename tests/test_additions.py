import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sheafline.operators import attest, claims, concepts, diff, factors, index_store, outputs, search, vectors
from sheafline.sources import adapters, pdf

QUERIES = ["red", "red blue", "red OR green", '"red blue"', "re*", "NEAR(red green, 2)", "^red", "red NOT blue", "red (blue OR green)", '("red blue" OR grey*) NOT pink', "nothing", 'red OR "green red"']


def test_stored_index_ranks_as_the_texts_do(spark, tmp_path):
    rng = random.Random(6)
    words = ["red", "blue", "green", "grey", "greyish", "pink", "Röd"]
    rows = [(f"k{i}", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))), f"c{i % 7}", i) for i in range(120)] + [("null", None, "c", 1), ("empty", "", "c", 2)]
    df = spark.createDataFrame(rows, "id string, text string, concept_id string, ordinal int")
    index_store.write(df, str(tmp_path / "index"), buckets=4)
    index = index_store.Index(spark, str(tmp_path / "index"))
    for q in QUERIES:
        a = {(r.id, round(r.score, 6)) for r in index.ranked(q).collect()}
        b = {(r.id, round(r.score, 6)) for r in search.ranked(df, q).collect()}
        assert a == b, q
    plan = index.postings(["red"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
    with pytest.raises(search.QueryError):
        index.search("(red")
    index_store.write(df.limit(0), str(tmp_path / "none"))
    assert index_store.Index(spark, str(tmp_path / "none")).search("red").count() == 0


def reference_root(leaves):
    if len(leaves) == 1:
        return leaves[0]
    k = 1 << (len(leaves) - 1).bit_length() - 1
    return hashlib.sha256(b"\x01" + reference_root(leaves[:k]) + reference_root(leaves[k:])).digest()


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1023, 1024, 1025, 3001])
def test_tree_in_blocks_equals_the_recursive_definition(spark, n):
    rows = [(f"{i:05d}.md", hashlib.sha256(str(i).encode()).hexdigest()) for i in range(n)]
    df = spark.createDataFrame(rows, "path string, leaf string")
    got = attest.merkle_root(df).first()
    assert got.n_leaves == n
    assert got.root == (reference_root([bytes.fromhex(x) for _, x in rows]).hex() if n else attest.EMPTY_ROOT)
    if n in (3, 7, 1025):
        assert attest.proven(df, attest.proofs(df), got.root).where("not ok").count() == 0
        assert attest.proven(df, attest.proofs(df), "0" * 64).where("ok").count() == 0
    if n == 7:
        good = attest.verified(df, df, got.root).first()
        assert good.map_ok and good.root_ok and good.proofs_ok and good.n_ok == 7
        bad = attest.verified(df.where("path <> '00003.md'"), df, got.root).first()
        assert not bad.map_ok and not bad.root_ok and not bad.proofs_ok and bad.n_missing == 1
        import json

        text = "".join(r.line for r in attest.statement(df, got.root).orderBy("part").collect())
        assert [o["path"] for o in json.loads(text)["predicate"]["outputs"]] == [p for p, _ in rows]


def test_findings_of_claims(spark):
    rows = [("a", "Owner: Alice\ntotal $10", "s"), ("b", "Owner: Bob", "s"), ("c", "owner: ALICE", "s"), ("d", "Owner: Eve", "other"), ("e", None, "s"), ("f", "", None)]
    df = spark.createDataFrame(rows, "id string, text string, scope string")
    all_claims = claims.claims(df, "id", "text", F.col("scope"))
    assert {(r.chunk, r.kind, r.value, r.position) for r in all_claims.collect()} == {("a", "owner", "alice", 0), ("a", "amount", "10", 0), ("b", "owner", "bob", 0), ("c", "owner", "alice", 0), ("d", "owner", "eve", 0)}
    assert [tuple(r) for r in claims.checked(all_claims).collect()] == [("claim_conflict", "s", "owner", "alice", "bob", 2)]
    assert claims.checked(all_claims, kinds_off=("owner",)).count() == 0
    assert [tuple(r) for r in claims.checked(all_claims, cap=4).collect()] == [("claims_too_many", None, None, None, None, 5)]
    assert claims.checked(all_claims.limit(0)).count() == 0


def test_factors_take_only_listed_names(spark):
    registry = factors.Registry()
    with pytest.raises(ValueError):
        registry.register("colour", lambda now: F.lit(1.0))
    docs = spark.createDataFrame([(1, "s", "human:pending", {"ocr_enabled": "true"}, "x sk-" + "a" * 24, "u", "Note", "2020-01-01", None), (2, None, None, None, None, None, None, None, None)], "canon_id long, source_sha256 string, okf_verified string, metadata map<string,string>, body_md string, source_uri string, okf_type string, okf_stale_after string, converted_at timestamp")
    with pytest.raises(ValueError):
        registry.queue(docs, "2025-06-01", {"colour": 2.0})
    assert {r.canon_id: r.priority for r in registry.queue(docs, "2025-06-01").collect()} == {1: 4.0, 2: 1.0}
    registry.register("age", lambda now: F.lit(2.0), 0.25)
    assert {r.canon_id: r.priority for r in registry.queue(docs, "2025-06-01", {"stale_state": 0}).collect()} == {1: 3.5, 2: 1.5}
    assert registry.contributions(docs, "2025-06-01").where("canon_id = 1").agg(F.sum("contribution")).first()[0] == 4.5


def test_outputs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a/x.pdf", "u", "Note", None, None, None), (2, "b/x.txt", "u", "Note", "draft", None, "2030-01-01"), (3, "c.pdf", None, "Note", None, None, None), (4, "d.pdf", "u", None, None, None, None), (5, "e.pdf", "u", "Note", "s", "v", "w"), (6, None, "u", "Note", None, None, None)], "canon_id long, source_relpath string, source_uri string, okf_type string, okf_status string, okf_verified string, okf_stale_after string")
    fixed = outputs.safe_fixes(docs, "2025-06-01").collect()
    assert [tuple(r) for r in fixed] == [(2, "x.md", "+verified", "draft", "human:pending", "2030-01-01")]
    lines = spark.createDataFrame([("one",), ("two",)], "line string")
    for _ in range(2):
        got = outputs.append_lines(lines, str(tmp_path / "m"), "7")
    assert sorted(r.value for r in got.collect()) == ["one", "two"] and outputs.append_lines(lines, str(tmp_path / "m"), "8").count() == 4
    cells = diff.cells(spark.createDataFrame([(1, "| a | b |\n| --- | --- |\n| x, y | \"q\" |")], "k long, t string"), "k", "t")
    r = outputs.table_sidecars(cells, "k").first()
    assert r.csv == 'a,b\n"x, y","""q"""\n' and r.json == '[{"a":"x, y","b":"\\"q\\""}]'
    maps = spark.createDataFrame([(1, {"a": "1", "b": "2"}, {"a": "1", "c": "3"})], "k long, left map<string,string>, right map<string,string>")
    assert [tuple(x) for x in diff.frontmatter_changes(maps, "k").collect()] == [(1, "b", "2", None), (1, "c", None, "3")]
    both = spark.createDataFrame([("# A\ntext", "#  a \nother"), ("# A", "# B")], "l string, r string")
    assert [x[0] for x in both.select(outputs.rendered_same(F.col("l"), F.col("r"))).collect()] == [True, False]


def test_numbers_within_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 5}", f"box/mail-{i:04d}.pst") for i in range(900, 0, -1)]
    df = spark.createDataFrame(rows, "canon_id long, source_sha256 string, source_relpath string")
    got = {r.canon_id: r.n for r in outputs.numbered_within(df, "source_sha256", "canon_id").collect()}
    for g in {x[1] for x in rows}:
        ids = sorted(i for i, s, _ in rows if s == g)
        assert [got[i] for i in ids] == list(range(1, len(ids) + 1))
    assert outputs.message_paths(df).where("canon_id = 1").first().path == "box/mail-0001.md"
    assert outputs.message_paths(df.limit(0)).count() == 0


def test_decisions_and_lint_families(spark):
    from sheafline.operators import quality, review

    docs = spark.createDataFrame([(1, "human:pending"), (2, "human:pending"), (3, "human:x"), (4, None)], "canon_id long, okf_verified string")
    said = spark.createDataFrame([(1, "reject", "b", 5), (1, "approve", "a", 2), (1, "look", "z", 1), (2, "look", "a", 1), (3, "approve", "a", 1), (None, "approve", "a", 1)], "canon_id long, action string, reviewer string, at long")
    assert [tuple(r) for r in review.decide(docs, said).collect()] == [(1, "human:pending", "human:a", "a", "approve")]
    long = "x" * 300
    rows = [(i, p, long, None, "u", "0" * 64, "s", "v") for i, p in enumerate(["okf/a.md", "b/_md/a.md", "c.md", None])]
    linted = quality.lint_all(spark.createDataFrame(rows, "canon_id long, source_relpath string, body_md string, okf_type string, source_uri string, source_sha256 string, okf_status string, okf_verified string"))
    assert {(r.canon_id, r.rule) for r in linted.collect()} == {(0, "type-required"), (1, "line-length"), (2, "type-required"), (2, "line-length"), (3, "type-required"), (3, "line-length")}


def test_providers_and_refresh(spark):
    p = vectors.Providers()
    p.register("hashed", "words", 8, "1", lambda c: vectors.hashed_embedding(c, 8))
    with pytest.raises(ValueError):
        p.register("hashed", "words", 8, "1", lambda c: c)
    with pytest.raises(ValueError):
        p.register("bad", "", 8, "1", lambda c: c)
    chunks = spark.createDataFrame([("a b",), ("c",), ("c",), (None,), ("",)], "text string")
    first = p.refresh(spark.createDataFrame([], "key string, embedding array<double>"), chunks, "hashed")
    assert first.count() == 3
    marked = first.withColumn("embedding", F.array(F.lit(9.0)))
    again = p.refresh(marked, chunks.where("text = 'c'").unionByName(spark.createDataFrame([("new",)], "text string")), "hashed").collect()
    assert sorted(len(r.embedding) for r in again) == [1, 8]  # the kept one is the cache's, the new one is made


def test_packing_keeps_rows_apart(spark):
    df = spark.createDataFrame([(1, "# A\n\none\n\ntwo"), (1, "# A\n\none\n\ntwo"), (2, ""), (3, None)], "k long, body string")
    assert concepts.chunks_of(df, "body", "k").groupBy("k").count().collect() == [(1, 2)]


# ---- PDF ---------------------------------------------------------------------------------------------------------


def make_pdf(contents, extra="", resources=""):
    parts = ["%PDF-1.5", "1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", f"2 0 obj <</Type /Pages /Kids [{' '.join(f'{10 + i} 0 R' for i in range(len(contents)))}]>> endobj"]
    out = "\n".join(parts).encode() + b"\n"
    for i, c in enumerate(contents):
        ref = f"/Contents {50 + i} 0 R" if c is not None else ""
        out += f"{10 + i} 0 obj <</Type /Page {resources} {ref}>> endobj\n".encode()
        if c is not None:
            raw = zlib.compress(c)
            out += f"{50 + i} 0 obj <</Length {len(raw)} /Filter /FlateDecode>> stream\n".encode() + raw + b"\nendstream endobj\n"
    return out + extra.encode("latin-1")


def test_pdf_text():
    page = b"BT /F1 12 Tf 72 700 Td (Fixture \\(one\\) \\101) Tj 0 -14 Td [(sec) 20 (ond) -300 (line)] TJ ET"
    assert pdf.page_texts(make_pdf([page, None])) == ["Fixture (one) A\nsecond line", ""]
    cmap = "70 0 obj <<>> stream\n1 beginbfchar <01> <00C9> endbfchar 1 beginbfrange <02> <04> <0061> endbfrange\nendstream endobj\n71 0 obj <</Type /Font /ToUnicode 70 0 R>> endobj\n"
    assert pdf.page_texts(make_pdf([b"BT /F9 9 Tf <01020304> Tj ET"], cmap, "/Resources <</Font <</F9 71 0 R>>>>")) == ["Éabc"]
    inner = b"10 0 <</Type /Page /Contents 50 0 R>>"
    head = f"{len(b'10 0 ')}"
    packed = zlib.compress(inner)
    doc = b"%PDF-1.5\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [10 0 R]>> endobj\n" + f"5 0 obj <</Type /ObjStm /N 1 /First {head} /Filter /FlateDecode>> stream\n".encode() + packed + b"\nendstream endobj\n50 0 obj <<>> stream\nBT (packed) Tj ET\nendstream endobj\n"
    assert pdf.page_texts(doc) == ["packed"]


def test_pdf_failures_are_typed(spark):
    good = make_pdf([b"BT (hello) Tj ET", None])
    files = [("a.pdf", good), ("b.pdf", make_pdf([b"BT (x) Tj ET"], "trailer <</Encrypt 9 0 R>>")), ("c.pdf", b"no pdf"), ("d.pdf", None), ("e.rst", b"* a\n"), ("f.ipynb", b'{"cells": [{"cell_type": "markdown", "source": ["# T"]}, {"cell_type": "code", "source": "1+1"}]}'), ("g.xml", b"<a><b>x</b> y</a>"), ("h.xml", b"<a>")]
    df = spark.createDataFrame(files, "relpath string, content binary")
    got = {r.relpath: r for r in adapters.extract(df).collect()}
    assert got["a.pdf"].body_md == "## Page 1\n\nhello\n\n> **Note:** 1 page(s) (2) have no extractable text layer.\n"
    assert [got[x].status for x in ("b.pdf", "c.pdf", "d.pdf", "h.xml")] == ["failed"] * 4 and "encrypted" in got["b.pdf"].error
    assert got["f.ipynb"].body_md == "# T\n\n```\n1+1\n```\n" and got["g.xml"].body_md == "x\n\ny\n" and got["e.rst"].engine == "fallback"


# ---- safety ------------------------------------------------------------------------------------------------------


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    names = entry.queries()
    assert names and not any(n.startswith("p") and n[1].isdigit() and n[2] == "_" for n in names) and set(entry.oracle_sql()) <= set(names)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace as S

    from sheafline import session

    none = S(isEmpty=lambda: True)
    context = S(_jsc=S(sc=lambda: S(getCheckpointDir=lambda: none)), master="spark://host:7077", setCheckpointDir=lambda x: None)
    with pytest.raises(RuntimeError):
        session.checkpoint_dir(S(sparkContext=context, conf=S(get=lambda k, d: None)))


def test_element_changes_of_long_documents_take_no_square_of_time():
    import time

    body = "\n\n".join(f"Paragraph {i % 50}" for i in range(20_000))
    start = time.process_time()
    got = diff.element_changes(body, "New\n\n" + body + "\n\n# Head")
    assert time.process_time() - start < 5
    assert [x[0] for x in got].count("moved") == 20_000 and ("added", "paragraph", None, "New") in got and ("added", "heading", None, "# Head") in got
    assert diff.element_changes("a\n\nb", "b\n\nc") == [("modified", "paragraph", "a", "c"), ("moved", "paragraph", "b", "b")]
