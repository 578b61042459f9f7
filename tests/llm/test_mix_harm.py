import os
import random

import numpy as np
import pytest

from sheafline.llm import harm, mix

needs_tokenizer = pytest.mark.skipif(not os.path.exists(mix.TOKENIZER), reason="no vocabulary file here")
TARGETS = "source string, target_share double, max_repeats int"


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join("word" for _ in range(rng.randint(1, 200))), rng.choices(["big", "mid", "small", None, "free"], [60, 20, 5, 5, 10])[0], 0) for i in range(n)]
    return spark.createDataFrame(rows + [rows[0], (9_001, None, "big", 0), (9_002, "", "big", 0)], "doc_id bigint, text string, source string, tokens int")


@needs_tokenizer
def test_shares_copies_and_short_sources(spark):
    docs = corpus(spark)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 5)], TARGETS)
    size = {}
    for r in mix.token_sizes(docs).collect():
        size.setdefault(r.source, {})[r.doc_id] = r.tokens
    total = sum(sum(size.get(s, {}).values()) for s in ("big", "mid", "small", "absent"))
    want = {s for s, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3), ("absent", 0.05, 5)) if not size.get(s) or most * sum(size[s].values()) < share * total}
    assert {r.source for r in mix.short_sources(docs, targets).collect()} == want and "absent" in want
    taken = mix.mixture(docs, targets).collect()
    assert len({r.doc_id for r in taken}) == len(taken)
    for s, share, most in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 3)):
        mine = [r for r in taken if r.source == s]
        assert all(1 <= r.copies <= most for r in mine)
        got = sum(r.copies * r.tokens for r in mine)
        if s not in want:
            assert abs(got / (share * total) - 1) < 0.1
        else:
            assert got == most * sum(size[s].values())
    assert sorted((r.doc_id, r.copies) for r in mix.mixture(docs.repartition(7), targets).collect()) == sorted((r.doc_id, r.copies) for r in taken)
    assert abs(sum(r.reached_share for r in mix.reached(docs, targets).collect()) - 1) < 1e-4


@needs_tokenizer
def test_mix_edges(spark):
    targets = spark.createDataFrame([("a", None, None), (None, 0.5, 1), ("b", 1.0, 0)], TARGETS)
    none = corpus(spark).limit(0)
    assert {r.source for r in mix.short_sources(none, targets).collect()} == {"a", "b"}
    assert mix.mixture(none, targets).count() == 0 and mix.mixture(corpus(spark), targets.limit(0)).count() == 0
    assert mix.inclusion_rate([], 5) == 0.0 and mix.inclusion_rate([(2.0, 3, 6.0)], 99) == float("inf")


def test_pieces_lose_nothing():
    text = "ab " * 300_000 + "x" * 250_000
    assert "".join(mix._pieces(text)) == text


def test_pieces_change_no_count():
    if os.path.exists(mix.TOKENIZER):
        enc = mix._encoding(mix.TOKENIZER)
        for text in ("word 12 ledger, " * 30_000, "ab1" * 120_000, "Größe\n\n  x " * 40_000):
            assert sum(len(enc.encode_ordinary(p)) for p in mix._pieces(text)) == len(enc.encode_ordinary(text)) and len(list(mix._pieces(text))) > 1


@needs_tokenizer
def test_taken_tokens_are_near_what_is_owed_on_uneven_sizes(spark):
    """Inclusion odds by exact sizes: the expected tokens are those owed; over seeds the mean deviation is small."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "word " * int(rng.paretovariate(1.1) * 20), "a" if i % 4 else "b") for i in range(600)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 2)], TARGETS)
    plan = {r.source: r for r in mix.owed(mix.token_sizes(docs), targets).collect()}
    off = [sum(r.copies * r.tokens for r in mix.mixture(docs, targets, seed=s).collect() if r.source == "a") / plan["a"].owed - 1 for s in (1, 2, 3, 4)]
    assert abs(sum(off) / len(off)) < 0.05 and max(map(abs, off)) < 0.15


# ---- harm --------------------------------------------------------------------------------------------------------


def test_spelling_folds():
    t = lambda s: harm.tokens(s)
    assert t("You are an i.d.i.o.t") == t("you are an idiot") == t("YOU are an 1d10t") == t("you are an id-iot") == t("you are an i d i o t")
    assert t("stuuuupid") == ["stupid"] and t("аsshοle") == ["asshole"] and t("route 66") == ["route", "0"]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    weigher = harm.Weigher(np.zeros(harm.FEATURES, dtype=np.int64), 10)
    words = [f"w{i}" for i in range(60)]
    vectors = [weigher.vector([words[j] for j in rng.integers(0, 60, 8)]) for _ in range(300)]
    index = harm.BlockMaxIndex.build(vectors)
    dense = np.zeros(harm.FEATURES, dtype=np.float32)
    for _ in range(40):
        ids, values = weigher.vector([words[j] for j in rng.integers(0, 60, 8)])
        full = np.zeros(harm.FEATURES, dtype=np.float32)
        full[ids] = values
        sims = np.array([float((full[i] * v).sum()) for i, v in vectors])
        order = [i for i in np.lexsort((np.arange(300), -sims.round(6))) if sims[i] >= harm.RADIUS][:12]
        got, cos = index.nearest(ids, values, 12, dense)
        assert np.allclose(sorted(sims[order], reverse=True), cos, atol=1e-5) and len(got) == len(order)


def test_bounds_lose_no_neighbour():
    """Sentences bounded at once score what a search of every run finds; a word met many times included."""
    rng = np.random.default_rng(9)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) + ". " + " ".join(rng.choice(words[:9], rng.integers(1, 60))) for _ in range(120)] + ["", None, "wab " * 40, "w a b c d", "u\r\nv"]
    df = rng.integers(1, 90, harm.FEATURES)
    weigher = harm.Weigher(df, 100)
    vectors = [weigher.vector(list(rng.choice(words, rng.integers(2, 9)))) for _ in range(150)]
    model = harm.Model(df, 100, [f"x{i}" for i in range(150)], np.array([1.0] * 40 + [0.0] * 110), harm.BlockMaxIndex.build(vectors), 40)
    scorer = harm.Scorer(model)
    got = scorer.batch(texts)
    dense = np.zeros(harm.FEATURES, dtype=np.float32)
    for text, (score, _, _) in zip(texts, got, strict=True):
        best = 0.0
        t = harm.Texts([text or ""], scorer.folder)
        for a, b in zip(t.begins, t.ends, strict=True):
            runs = [(a, b)] + ([(x, min(x + harm.WINDOW, b)) for x in range(a, b - harm.WINDOW // 2, harm.WINDOW // 2)] if b - a > harm.WINDOW + 4 else [])
            for x, y in runs:
                near, cos = model.index.nearest(*weigher.of(t.words[x:y]), harm.NEIGHBOURS, dense)
                if (near < model.leading).any():
                    best = max(best, harm.vote(model.labels[near], cos))
        assert abs(best - score) < 1e-6
    assert harm.units("He said so. No\nmatter what") == ["He said so.", "No matter what"]


def test_harm_end_to_end(spark):
    rng = random.Random(2)
    nouns = ["ledger", "folder", "cabinet", "binder", "carton", "label"]
    calm = lambda: f"The {rng.choice(nouns)} was moved next to the {rng.choice(nouns)} on day {rng.randint(1, 30)}."
    insults = ["You are a worthless fool and everybody hates you.", "Shut up you worthless filthy fool, get lost.", "Get lost you filthy liar, everybody hates you."]
    texts, bad = {}, set()
    for i in range(600):
        lines = [calm() for _ in range(4)]
        if i % 6 == 0:
            lines.insert(2, rng.choice(insults).upper() if i % 12 else rng.choice(insults).replace("o", "0"))
            bad.add(i)
        texts[i] = "\n".join(lines)
    rows = [(i, t, "s1" if i % 2 else None, 0.0) for i, t in texts.items()] + [(700, None, "s1", 0.0), (701, "", "s1", 0.0), (0, texts[0], None, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    labels = [(i, int(i in bad) if i % 25 else 1 - int(i in bad), f"r{i}") for i in range(0, 300)] + [(5, None, "x"), (12, 0, "y"), (None, 1, "z")]
    lab = spark.createDataFrame(labels, "doc_id bigint, flagged int, reviewer string")
    got = {r.doc_id for r in harm.found(docs, lab).collect()}
    assert len(got & bad) / len(bad) > 0.95 and len(got - bad) <= 2
    rates = {r.source: r.rate for r in harm.source_rates(docs, lab).collect()}
    assert set(rates) == {"s1", None}
    assert harm.found(docs, lab.limit(0)).count() == 0 and harm.found(docs.limit(0), lab).count() == 0
