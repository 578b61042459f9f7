import pytest

from sheafline.llm import encoding as E

SOUND = [
    "Die Außenstelle prüfte sämtliche Umschläge für das Büro und öffnete den Anhang, größere Mengen später.",
    "L’équipe a relevé des différences entre les deux éditions à cause de l’humidité, le procès-verbal révisé.",
    "La señora del mostrador revisó el último anexo, según la delegación también faltan páginas en la edición.",
    "The café next to the reading room – the curator’s list – closes early; naïve façade.",
    "O relatório de revisão não está concluído, as alterações não se aplicam à documentação.",
]
COLS = "canon_id bigint, title string, body_md string, chain string, text string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, b, "clash", "clash") for i, (t, b) in enumerate(rows)], COLS)


def garble(text, wrong, right):
    """Text of set ``right`` read as ``wrong``."""
    raw = text.encode(right)
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw) if wrong not in E.MULTI_BYTE else raw.decode(wrong)


CHAINS = [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1250", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("mac_roman", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "cp1252"), ("cp850", "cp1252")]


@pytest.fixture(scope="module")
def dictionaries(spark):
    return E.build_dictionaries(table(spark, [(None, s) for s in [*SOUND, "ÂGE «Â», caja Ñ √2 ≈ ├── x"]] * 4))


@pytest.mark.parametrize("wrong, right", CHAINS)
def test_planted_garbling_is_found_and_restored(spark, dictionaries, wrong, right):
    rows = [("Plain title", garble(s, wrong, right)) for s in SOUND[:3]] + [(None, s) for s in SOUND]
    got = E.garbled_fields(table(spark, rows), dictionaries).collect()
    assert {(r.canon_id, r.field_name) for r in got} == {(0, "body_md"), (1, "body_md"), (2, "body_md")}
    for r in got:
        assert r.restored == SOUND[r.canon_id] and r.recoverable


def test_twice_garbled_partial_and_lost(spark, dictionaries):
    twice = garble(garble(SOUND[0], "cp1252", "utf-8"), "cp1252", "utf-8")
    partial = SOUND[1] + "\n\n" + garble(SOUND[2], "cp1252", "utf-8")
    lost = SOUND[0].encode("latin-1", "replace").decode("utf-8", "replace")
    got = {r.canon_id: r for r in E.garbled_fields(table(spark, [(None, twice), (None, partial), (None, lost), ("ÂGE", "«Â», caja Ñ √2 ≈ ├── x")]), dictionaries).collect()}
    assert set(got) == {0, 1, 2}
    assert got[0].restored == SOUND[0] and got[1].restored == SOUND[1] + "\n\n" + SOUND[2]
    assert not got[2].recoverable


def test_garbled_words_that_outnumber_the_sound_ones(spark):
    bad = [garble(SOUND[0], "cp1252", "utf-8"), garble("Später größere Schlüssel", "cp1252", "utf-8")]
    rows = [(None, s) for s in SOUND for _ in range(2)] + [(None, b) for b in bad for _ in range(7)]
    got = {r.canon_id: r.restored for r in E.garbled_fields(table(spark, rows)).collect()}
    assert got == {10 + i: (SOUND[0] if i < 7 else "Später größere Schlüssel") for i in range(14)}


def test_letters_alone_are_no_misreading():
    assert not E._misread("Рёбра", E._readings("Рёбра"), E.Counter({"Рёбра": 9}), set("Рёбраи"))


def test_edges(spark, dictionaries):
    assert E.found(table(spark, [])).count() == 0
    rows = [(None, None), ("", ""), ("plain", "ascii only"), (None, "é" * 50_000), ("Ñandú", None)]
    assert E.found(table(spark, rows), dictionaries=dictionaries).count() == 0
    bad = garble(SOUND[1], "cp1252", "utf-8")
    df = table(spark, [(bad, bad)])
    assert sorted(r.field_name for r in E.found(df.unionAll(df), dictionaries=dictionaries).collect()) == ["body_md", "title"]
    assert E.found(df).count() >= 0 and E.chain_report(df).count() >= 0


def test_round_trip_of_the_chains():
    for name, (steps, _) in E.CHAINS.items():
        if len(steps) == 1 and steps[0][1] == "utf-8" and steps[0][0] not in E.MULTI_BYTE:
            assert E.decode(garble("größer", steps[0][0], "utf-8"), name) == "größer"


def test_corpus_wide_judging_equals_judging_each_field(spark):
    """Words judged once for the corpus give the chains that judging every field by itself gives."""
    bad = [garble(s, w, r) for s in SOUND for w, r in CHAINS[:4] + CHAINS[7:]]
    df = table(spark, [(None, s) for s in SOUND * 3] + [(b.split(" ")[0], b + "\n" + SOUND[0]) for b in bad])
    known = E.build_dictionaries(df)
    judge = E.Judge(known)
    want = {(r.canon_id, n) for r in df.collect() for n in ("title", "body_md") if r[n] and judge.chains(r[n])}
    assert {(r.canon_id, r.field_name) for r in E.found(df, known).collect()} == want and len(want) > 20


def test_known_words_are_compressed_like_all_others():
    words = ["café", "Schlüssel", "prüfte", "révisé", "curator’s"] * 3
    length = E.Lengths({"en": E.units(" " + " ".join(dict.fromkeys(words)) + " ")})
    for w in words:
        assert length(w) == min(len(c.compress(E.units(f" {w} "))) for c in length.compressors) < length(garble(w, "mac_roman", "cp1252"))
