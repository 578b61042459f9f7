import itertools
import random

from sheafline.llm import pii

LEX = pii.Lexicon.of({"Mara", "Hartwell", "Jörg", "Eskelholz"})


def spans(text):
    return [(text[a:b], k) for a, b, k, _ in pii.SemiMarkov(pii.model_weights()).best(pii.candidates(text, LEX))]


def test_kinds_and_decoys():
    assert spans("Mara Hartwell called twice from +44 20 7946 0123.") == [("Mara Hartwell", "person_name"), ("+44 20 7946 0123", "phone")]
    assert ("hartwell [at] firm [dot] example", "email") in spans("Write to hartwell [at] firm [dot] example today")
    assert spans("Deliver it to 14 Old Mill Road, Apt 3")[0][1] == "street_address"
    assert spans("Die Rückgabe erfolgt an Lindwurmgasse 12b")[0] == ("Lindwurmgasse 12", "street_address")
    for text, kind in (("SSN 123-45-6789", "id_number"), ("NINO QQ 12 34 56 C", "id_number"), ("DNI 12345678-Z", "id_number"), ("Tel. 030/23125662", "phone"), ("NIR 2 67 99 99 430 452 69", "id_number")):
        assert [k for _, k in spans(text)] == [kind], text
    for text in ("Order no. 020-7696-18 covers lot 212.555.696.", "Ticket 4418-555-652 refers to ISO 00652-1.", "Message-ID: <20240411.714180@mail.firm.example>", "Install tools@2.246.0 now.", "See @mara-handbook.", "Shelf range 9849-10-2000", "Since 2020-11-17 it is 04.02.2021."):
        assert spans(text) == [], text
    garbled = "JÃ¶rg Eskelholz"
    assert spans(garbled)[0][1] == "person_name"


def test_numbers_over_line_breaks():
    assert [k for _, k in spans("reach me on +44 20\n> 7946 0946.")] == ["phone"]
    assert [k for _, k in spans("SSN: 967 30\n5057")] == ["id_number"]


def test_viterbi_is_the_best_segmentation():
    rng = random.Random(3)
    for _ in range(60):
        cands = sorted({(a, a + rng.randint(1, 5), rng.choice(pii.KINDS), (f"f{rng.randint(0, 5)}",)) for a in (rng.randint(0, 10) for _ in range(7))})
        weights = {(k, 0, f"f{i}"): rng.uniform(-1, 1) for k in pii.KINDS for i in range(6)} | {("step", x, y): rng.uniform(-1, 1) for x in pii.KINDS for y in pii.KINDS}
        model = pii.SemiMarkov(weights)

        def total(sub):
            return sum(model.score(c[2], c[3]) for c in sub) + sum(model.step(x[2], y[2]) for x, y in zip(sub, sub[1:]) if y[0] - x[1] <= pii.NEAR)

        top = max(total(sub) for r in range(len(cands) + 1) for sub in itertools.combinations(cands, r) if all(x[1] <= y[0] for x, y in zip(sub, sub[1:])))
        assert abs(total(model.best(cands)) - top) < 1e-9


def test_the_model_chooses_among_many_segments():
    """A region's runs are all candidates; the boundaries come from the weights, not from the order or length of candidates."""
    for text in ("Dear Mara Hartwell, see Jörg", "reach Mara Hartwell on +44 20 7946 0123 today", "The Hartwell Archive moved."):
        found = pii.candidates(text, LEX)
        chosen = pii.SemiMarkov(pii.model_weights()).best(found)
        assert len(found) >= 2 * max(1, len(chosen)) and len({c[:2] for c in found if c[2] == "person_name"}) >= 3
    assert pii.SemiMarkov({}).best(pii.candidates("Mara Hartwell, +44 20 7946 0123", LEX)) == []
    rng = random.Random(5)  # with random weights other boundaries win
    got = {tuple(c[:3] for c in pii.SemiMarkov({k: rng.uniform(-1, 1) for k in pii.model_weights()}).best(pii.candidates("Dear Mara Hartwell, 020 7946 0123", LEX))) for _ in range(40)}
    assert len(got) > 5


def test_training_separates_held_out_sentences():
    rng = random.Random(99)
    lex = pii.Lexicon.of({*pii._FIRST, *pii._FAMILY})
    model = pii.SemiMarkov(pii.model_weights())
    right = total = 0
    for _ in range(400):
        text, gold = pii._fill(rng, rng.choice([x for x in pii._GOOD + pii._BAD if x]))
        got = {k for *_, k, _ in model.best(pii.candidates(text, lex))}
        right += got == {k for *_, k in gold}
        total += 1
    assert right / total > 0.9


def test_spark_rows(spark):
    docs = spark.createDataFrame([(1, "- **From**: Zora Quill <zora@x.example>\n- **To**: Zora Quill <z@x.example>", "c"), (2, None, "c"), (3, "", "c"), (4, "Zora was here", "c"), (5, "x" * 300_000, "c")], "canon_id bigint, body_md string, text string")
    chunks = spark.createDataFrame([("k", "Quill at SSN 123-45-6789", "c"), ("k", "Quill at SSN 123-45-6789", "c"), (None, "Quill", "c"), ("n", None, "c")], "id string, text string, body_md string")
    got = {(r.field_name, r.record_key, r.pii_kind) for r in pii.found(docs, chunks).collect()}
    assert got == {("body_md", "1", "person_name"), ("body_md", "1", "email"), ("body_md", "4", "person_name"), ("chunk_text", "k", "person_name"), ("chunk_text", "k", "id_number")}
    clean = {r.record_key: r.redacted for r in pii.redacted(docs).collect()}
    assert clean["4"] == "[PERSON] was here" and clean["1"].startswith("- **From**: [PERSON] <[EMAIL]>")
    assert pii.found(docs.limit(0), chunks.limit(0)).count() == 0


def test_names_beyond_the_most_frequent_count_too(spark):
    """However few names and garbled forms are sent to the workers, the rows are the same."""
    names = ["Zora Quill", "Jörg Eskelholz", "Nadège Ferrôt", "Mara-Lena Vörös", "山田太郎"]
    bodies = [f"- **From**: {n} <x{k}@x.example>" for k, n in enumerate(names)] * 2
    bodies += [f"{n} was here" for n in names] + ["Then Quill left, and Ferrôt came.", "昨日 山田太郎 が来た", "The ledger was here."]
    bodies += [f"handed to {n.encode().decode('cp1252', 'replace')} yesterday" for n in names[1:4]]
    docs = spark.createDataFrame(list(enumerate(bodies)), "canon_id bigint, body_md string")
    chunks = docs.selectExpr("concat('c', canon_id) as id", "body_md as text")
    lexicon, rest = pii.build_lexicon(docs)
    assert rest is None and lexicon.garbled
    whole = {tuple(r) for r in pii.found(docs, chunks).collect()}
    clean = {tuple(r) for r in pii.redacted(docs, chunks).collect()}
    named = sum(k == "person_name" for *_, k in whole)
    assert named > len({tuple(r) for r in pii.found(docs, chunks, pii.Lexicon.of({"Nobody"})).collect() if r.pii_kind == "person_name"})
    for tokens, garbled in ((1, 20), (100, 1), (0, 0)):
        sent, rest = pii.build_lexicon(docs, tokens, garbled)
        forms = rest.collect()
        assert sent.names | {r.w for r in forms if not r.garbled} == lexicon.names
        assert (sent.garbled | {r.w for r in forms if r.garbled}) - lexicon.names == lexicon.garbled
        assert {tuple(r) for r in pii.found(docs, chunks, tokens=tokens, garbled=garbled).collect()} == whole
        assert {tuple(r) for r in pii.redacted(docs, chunks, tokens=tokens, garbled=garbled).collect()} == clean
