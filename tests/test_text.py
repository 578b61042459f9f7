import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from sheafline.functions import cleanup, text


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr(F.col("t")).alias("x")).first().x


def test_squeeze_and_counts_follow_python(spark):
    for s in ("", "  a  b ", "x y z", "one\n\ntwo\tthree", "　日本 語\x1c", "ß\u0085é"):
        assert one(spark, s, text.squeeze) == " ".join(s.split())
        assert one(spark, s, text.word_count) == len(s.split())
        assert one(spark, s, text.token_estimate) == max(1, (len(s.split()) + 3) // 4)
    assert one(spark, None, text.squeeze) is None


def test_ids_and_paths(spark):
    assert one(spark, "a", lambda c: text.joined_id(c, F.lit("b"))) == hashlib.sha256(b"a\x00b").hexdigest()
    assert one(spark, "a/b/c.PDF", text.suffix) == ".pdf"
    assert one(spark, "a/b/c.PDF", text.concept_path) == "a/b/c.md"
    assert one(spark, "A/b/c.pdf", text.path_tags) == ["a", "b", "pdf"]
    assert one(spark, "plain", text.path_tags) == ["document"]
    assert one(spark, "../x.md#top", lambda c: text.link_target(F.lit("a/b/c.md"), c)) == "a/x.md"
    assert one(spark, "/r/y.md", lambda c: text.link_target(F.lit("a/c.md"), c)) == "r/y.md"
    assert one(spark, "https://x.example/a", lambda c: text.link_target(F.lit("a/c.md"), c)) is None


def test_terms_strip_marks(spark):
    assert one(spark, "Éa straße NAÏVE-x 12", text.terms) == ["ea", "straße", "naive", "x", "12"]
    assert len(text.MARKED) == len(text.PLAIN)


def test_glob(spark):
    assert one(spark, "a-1.pdf", lambda c: c.rlike(text.glob_regex("a-[0-9].pdf")), "string")
    assert not one(spark, "a-x.pdf", lambda c: c.rlike(text.glob_regex("a-[!a-z].pdf")))


def test_percent_and_cells(spark):
    assert spark.range(1).select(text.percent(F.lit(1), F.lit(3)).alias("x")).first().x == "33.3%"
    assert spark.range(1).select(text.percent(F.lit(1), F.lit(0)).alias("x")).first().x == "0%"
    assert one(spark, ["a|b", " c\nd "], text.table_row, "array<string>") == "| a\\|b | c d |"


CASES = {
    "compose": ("é\r\nx\ry", "é\nx\ny"),
    "soft_hyphens": ("ab­cd", "abcd"),
    "ligatures": ("oﬃce ﬁn x", "office fin x"),
    "quotes": ("“x” – — …", '"x" - -- ...'),
    "entities": ("a &amp;amp; b", "a & b"),
    "spaces": ("a \t b\n\n\n\nc", "a b\n\nc"),
    "hyphens": ("exam-\nple é-\nü", "example éü"),
    "wraps": ("one\ntwo\n\n# h\n- a\n- b", "one two\n\n# h\n- a\n- b"),
    "orphans": ("a\n --\nb", "a\n\nb"),
    "bylines": ("By somebody\nx\nBy somebody", "\nx\n"),
    "headings": ("### a\n##### b\n# c", "# a\n## b\n# c"),
}


def test_cleanup_stages(spark):
    for stage, (given, wanted) in CASES.items():
        assert one(spark, given, cleanup.STAGES[stage]) == wanted, stage
        assert one(spark, None, cleanup.STAGES[stage]) is None


def test_clean_is_idempotent_and_selects_stages(spark):
    dirty = "“Exam-\nple” &amp; more\r\n\r\n\r\n\r\n### Title\nline one\nline two"
    once = one(spark, dirty, cleanup.clean)
    assert one(spark, once, cleanup.clean) == once
    assert one(spark, dirty, lambda c: cleanup.clean(c, ["quotes"])) == dirty.replace("“", '"').replace("”", '"')
    try:
        cleanup.clean(F.lit("x"), ["nothing"])
        raise AssertionError
    except KeyError:
        pass


def test_contents_block():
    assert cleanup.drop_opening_contents("# T\nA\nB\nC\n\nx\nA\nB\nC\ny") == "\nx\nA\nB\nC\ny"
    assert cleanup.drop_opening_contents("A\nB\nC\nD\nE") == "A\nB\nC\nD\nE"


def test_entities_match_python(spark):
    s = "Alice Smith met Bob Jones near Élan Vital and X Y."
    want = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", s)))
    assert one(spark, s, text.entities) == want
    assert unicodedata.normalize("NFC", s) == s
