import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sheafline.operators import emit
from sheafline.sources import adapters, files
from sheafline.streaming import watch


def one(adapter, content, stem="stem"):
    return next(iter(adapter(content, stem)))


def test_html():
    r = one(adapters.html, b"<html><head><title>T</title><script>x()</script></head><body><nav>Menu</nav><main><h1>Main &amp; more</h1><p>One <b>two</b> <a href='/x'>three</a>.</p><ul><li>a<li>b</ul><table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>a|b</td></tr></table></main><footer>F</footer></body></html>")
    assert r.title == "Main & more"
    assert "# Main & more" in r.body_md and "One **two** [three](/x)." in r.body_md and "- a\n- b" in r.body_md
    assert "| h | i |\n| --- | --- |\n| 1 | a\\|b |" in r.body_md
    assert "Menu" not in r.body_md and "x()" not in r.body_md and "F" not in r.body_md.replace("First", "")
    assert one(adapters.html, b"").title == "stem"


def test_plain_formats():
    assert one(adapters.txt, "caf\xe9 \n".encode("cp1252")).body_md == "```text\ncafé\n```\n"
    assert one(adapters.md, b"---\ntype: x\n---\n# Hello\n\ntext").title == "Hello"
    assert one(adapters.csv_table, b"a;b\n1;x\n2;y\n;\n").body_md.endswith("_2 rows \u00d7 2 columns_\n")
    j = one(adapters.json_file, b'{"name": "N", "v": 1}')
    assert j.title == "N" and j.body_md.startswith("- **name**: N")
    with pytest.raises(adapters.AdapterError):
        one(adapters.json_file, b"{")
    assert one(adapters.rtf, b"{\\rtf1{\\fonttbl{\\f0 Arial;}}\\f0 Hi\\par caf\\'e9 \\u8364?}").body_md == "Hi\ncaf\u00e9 \u20ac\n"


def test_mail():
    raw = b"From: A <a@example.org>\r\nTo: b@example.org\r\nSubject: Hi\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=X\r\n\r\n--X\r\nContent-Type: text/html\r\n\r\n<p>body <i>x</i></p>\r\n--X\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\nContent-Transfer-Encoding: base64\r\n\r\nQUJD\r\n--X--\r\n"
    r = one(adapters.eml, raw)
    assert r.title == "Hi" and "body *x*" in r.body_md and r.attachments == [("a.pdf", 3)] and "## Attachments" in r.body_md
    box = list(adapters.mbox(b"From a Mon Jan  1 00:00:00 2024\nSubject: 1\n\nx\n\nFrom b Mon Jan  1 00:00:00 2024\nSubject: 2\n\ny\n", "box"))
    assert [x.title for x in box] == ["box — 1", "box — 2"]


def docx(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="urn:w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_office_and_odf():
    assert one(adapters.office, docx("body")).body_md == "# Head\n\nbody\n"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", '<o xmlns:t="urn:t"><t:h t:outline-level="2">H</t:h><t:p>para</t:p><t:table><t:table-row><t:table-cell>a</t:table-cell><t:table-cell>b</t:table-cell></t:table-row></t:table></o>')
    assert one(adapters.odf, out.getvalue()).body_md == "## H\n\npara\n\n| a | b |\n| --- | --- |\n"
    with pytest.raises(adapters.AdapterError):
        one(adapters.office, b"no zip")


def test_extract_keeps_failures(spark):
    df = spark.createDataFrame([("a/x.txt", bytearray(b"hi")), ("a/y.docx", bytearray(b"broken")), ("a/z.unknown", bytearray(b"")), ("a/p.pdf", bytearray(b"%PDF"))], "relpath string, content binary")
    got = {r.relpath: (r.engine, r.status) for r in adapters.extract(df).collect()}
    assert got == {"a/x.txt": ("txt", "ok"), "a/y.docx": ("office", "failed"), "a/z.unknown": (None, "skipped"), "a/p.pdf": ("pdf", "failed")}


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "d")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("../evil.txt", "x")
        z.writestr("big.txt", "b" * 100)
        z.writestr("in.zip", inner.getvalue())
    df = spark.createDataFrame([("x.zip", bytearray(outer.getvalue())), ("bad.zip", bytearray(b"PK"))], "relpath string, content binary")
    got = {r.relpath: r.reason for r in adapters.expand_archives(df, max_member_bytes=200, max_total_bytes=10_000).collect()}
    assert got["x.zip!/a.txt"] is None and got["x.zip!/../evil.txt"] == "path_traversal" and got["x.zip!/in.zip!/deep.txt"] is None and got["bad.zip"] == "malformed_archive"
    small = {r.relpath: r.reason for r in adapters.expand_archives(df, max_member_bytes=50).collect()}
    assert small["x.zip!/big.txt"] == "max_member_bytes"
    assert adapters.inspect(outer.getvalue(), "x.zip") == ["archive_traversal"]


def test_walk_bundle_and_write(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/.git").mkdir()
    (tmp_path / "in/a.txt").write_text("x")
    (tmp_path / "in/sub/b.pdf").write_text("y")
    (tmp_path / "in/.hidden").write_text("z")
    (tmp_path / "in/.git/c.txt").write_text("g")
    got = {r.relpath for r in files.walk(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.txt", "sub/b.pdf"}
    assert {r.relpath for r in files.walk(spark, str(tmp_path / "in"), include="*.pdf").collect()} == {"sub/b.pdf"}
    rows = spark.createDataFrame([("k/c.pdf", "Document", "A: title", "ok", "p", None, "2030-01-01", "file:///x", "s" * 64, "body  \n")], "source_relpath string, okf_type string, title string, okf_status string, okf_generated string, okf_verified string, okf_stale_after string, source_uri string, source_sha256 string, body_md string")
    emit.write_files(emit.concept_files(rows), str(tmp_path / "out"))
    back = files.bundle(spark, str(tmp_path / "out")).first()
    assert (back.concept_id, back.type, back.title, back.status) == ("k/c.md", "Document", "A: title", "ok")


def test_stream_equals_batch(spark, tmp_path, sf):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / f"in/f{n}.txt").write_text(f"text {n}")
    seen = []
    q = watch.watch_folder(spark, str(tmp_path / "in"), lambda df, _: seen.extend(r.sha256 for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == sorted(r.sha256 for r in files.walk(spark, str(tmp_path / "in")).collect())
    (tmp_path / "in/f9.txt").write_text("new")
    q = watch.watch_folder(spark, str(tmp_path / "in"), lambda df, _: seen.extend(r.sha256 for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert len(seen) == 4
    before = spark.createDataFrame([("a",), ("b",)], "relpath string")
    assert [r.relpath for r in watch.deletions(before, before.where("relpath = 'a'")).collect()] == ["b"]
    assert F.lit(1) is not None
