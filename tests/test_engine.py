import pytest

from sheafline.functions.snippet import snippet
from sheafline.plans.engine import Engine, UnknownConcept


def test_snippet():
    text = " ".join(f"w{i}" for i in range(40)) + " Café near the LEDGER end"
    got = snippet(text, frozenset({"cafe", "ledger"}))
    assert "[Café]" in got and "[LEDGER]" in got and got.startswith("…")
    assert snippet("", frozenset({"x"})) == "" and snippet("only x", frozenset({"x"})) == "only [x]"


def test_engine(spark, sf):
    e = Engine(spark, sf)
    hits = e.search("ledger", 5).collect()
    assert 0 < len(hits) <= 5 and all("[" in h.snippet for h in hits) and [h.score for h in hits] == sorted(h.score for h in hits)
    name = e.page(1, 1).first().concept_id
    assert e.resolve(name) == name and e.get_concept(name).count() == 1
    assert e.context(name, 1).first().concept_id == name
    assert e.related(name).count() > 0 and e.impact(name).count() > 0
    assert e.doctor().first().total == e.concepts().count()
    assert e.diff(e).count() == 0
    assert e.find("LEDGER").count() > 0 and e.list_bundles().count() == 24
    assert e.sql("SELECT concept_id FROM concepts WHERE type = 'Note'").columns == ["concept_id"]
    with pytest.raises(UnknownConcept):
        e.resolve("no such concept")


def test_search_over_a_stored_index(spark, sf, tmp_path):
    plain, stored = Engine(spark, sf), Engine(spark, sf)
    stored.build_index(str(tmp_path / "index"))
    for query in ("ledger", '"the scanned"', "cabinet OR ledger", "conver* NOT ledger"):
        rows = lambda e: [(r.id, round(r.score, 6), r.snippet) for r in e.search(query, 10).collect()]  # noqa: B023, E731
        assert rows(plain) == rows(stored) and rows(plain)
