import random

import numpy as np
import pytest

from sheafline.llm import leak

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items, width=13):
    grams = {}
    for item, text in items:
        w = leak.words(text or "")
        for k in range(len(w) - width + 1):
            grams.setdefault(tuple(w[k : k + width]), set()).add(item)
    return {(d, i) for d, t in docs if t for w in [leak.words(t)] for k in range(len(w) - width + 1) for i in grams.get(tuple(w[k : k + width]), ())}


def test_suffix_array_and_ranks():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        s = rng.integers(0, 4, n)
        s[-1] = 0
        order = leak.suffix_array(s)
        key = lambda i: [(0, i2) if s[i2] == 0 else (1, int(s[i2])) for i2 in range(i, n)]  # noqa: E731, B023
        assert list(order) == sorted(range(n), key=key)
        wm = leak.WaveletMatrix(s, 3)
        for c in range(4):
            for i in range(n + 1):
                assert wm.rank(np.array([c]), np.array([i]))[0] == int((s[:i] == c).sum())
        symbol, before = wm.access(np.arange(n))
        assert (symbol == s).all() and all(before[i] == (s[:i] == s[i]).sum() for i in range(n))


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    s = np.concatenate([np.append(rng.integers(1, 4, 80), 0) for _ in range(6)])
    fm = leak.FMIndex(s, 3, sample=5)
    phrases = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (1, 2, 3)])
    which, lo, hi = fm.count(phrases)
    for p, a, b in zip(which, lo, hi, strict=True):
        want = [i for i in range(len(s) - 2) if (s[i : i + 3] == phrases[p]).all()]
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short")]
    shared = items[0][1].split()[:20] if len(items[0][1].split()) >= 20 else items[1][1].split()[:20]
    items.append((60, "Lead in words. " + " ".join(shared)))
    docs = [(1, None), (2, ""), (3, "nothing of it")]
    for k in range(60):
        words = [rng.choice(WORDS) for _ in range(30)]
        item = rng.choice(items[:12])[1].split()
        cut = item[: rng.randint(8, 20)]
        style = rng.choice(["plain", "html", "json", "quoted", "upper"])
        piece = {"plain": " ".join(cut), "html": "<b>" + "</b> <i>".join(cut), "json": "\\n".join(cut), "quoted": "\n> ".join(cut), "upper": ", ".join(cut).upper()}[style]
        docs.append((10 + k, " ".join(words) + " " + piece + " " + " ".join(words)))
    docs += [docs[-1], (999, "long " * 30_000 + items[3][1] + " tail" * 10)]
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id bigint, text string, item_id string").repartition(3)
    it = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked_pairs(df, it).collect()}
    assert got == brute(docs, items) and got
    assert {(r.doc_id, r.item_id) for r in leak.leaked_pairs(df, it, shard_tokens=50).collect()} == got


def test_spans_cover_the_passage(spark):
    item = " ".join(WORDS[:20])
    text = "Before it. " + item.replace("w5", "**w5**").upper() + " after it."
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, item), (8, item)], "item_id bigint, text string")
    r = leak.removal_spans(df, it).first()
    assert text[r.start_char : r.end_char].startswith("W0") and text[: r.start_char] == "Before it. " and text[r.end_char :] == " after it." and r.item_ids == "7,8"
    assert {x.item_id: (x.n_docs, x.longest_words) for x in leak.leak_report(df, it).collect()} == {7: (1, 20), 8: (1, 20)}


@pytest.mark.parametrize("docs, items", [([], [(1, " ".join(WORDS))]), ([(1, "text")], [])])
def test_empty_tables(spark, docs, items):
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert leak.leaked_pairs(df, it).count() == 0 and leak.removal_spans(df, it).count() == 0


def test_long_tags_are_markup_and_long_comparisons_are_words():
    tag = '<img alt="' + "many words " * 60 + '" src="a.png">'
    assert leak.words(f"one {tag} two") == ["one", "two"]
    assert len(leak.words("if a <b then " + "word " * 200 + "> c")) == 205
