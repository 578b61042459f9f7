from pyspark.sql import functions as F

from sheafline.llm import mail, page

HEAD = "## Headers\n\n- **From**: Ann Reed <ann@x.example>\n- **To**: Bob Low <bob@y.example>\n- **Subject**: Re: Note\n- **Date**: Thu, 11 Apr 2024 01:57 +0000\n\n## Body\n\n"
DOCS = "canon_id bigint, source_format string, source_relpath string, source_uri string, title string, body_md string, host string, line_no int"


def docs(spark, rows):
    """(id, format, body) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, f, p, u, t, b, "clash", -1) for i, f, p, u, t, b in rows], DOCS)


def gone(df):
    return sorted((r.canon_id, r.line_no) for r in mail.removed_lines(df).collect())


def lines(body, *wanted):
    return [n for n, x in enumerate(body.split("\n")) if x.strip() in wanted]


def test_quotes_signatures_and_notices(spark):
    a = HEAD + "Hi Bob,\n\nNew text here.\n\nBest,\nAnn\n\n--\nAnn Reed\nClerk, Paper House\nTel. 020 7946 0000\n\nOn 2024-04-10 09:00, Bob Low wrote:\n> Hi Ann\n>\n> old text\n\n## Attachments\n\n- `a.pdf`"
    b = HEAD + "FYI\n\n-----Original Message-----\n*From:* Bob Low <bob@y.example>\n*Sent:* 10.04.2024 18:23\n*To:* Ann\n*Subject:* Note\n\nold words"
    c = HEAD + "Counts so far:\n> 40 boxes\n> 12 boxes\n\nSteps:\n-- open it\n\nThe form says \"strictly confidential\", so it stays.\n\nBest,\nAnn\n\nSent from my phone"
    # closings are known by their recurrence alone: other mails end in the same lines
    others = [(10 + i, ".eml", f"{i}.eml", None, None, HEAD.replace("Ann Reed", f"Pat N{i}").replace("ann@", f"p{i}@") + f"Case {'abcdef'[i]} is done.\n\nBest,\nPat\n\n--\nPat N{i}\nClerk, Paper House\nTel. 020 7946 000{i}\n\nSent from my phone") for i in range(6)]
    df = docs(spark, [(1, ".eml", "a.eml", None, None, a), (2, None, "b.msg", None, None, b), (3, ".eml", "c.eml", None, None, c), *others])
    want = [(1, n) for n in lines(a, "--", "Ann Reed", "Clerk, Paper House", "Tel. 020 7946 0000", "On 2024-04-10 09:00, Bob Low wrote:", "> Hi Ann", ">", "> old text")]
    body = b.split("\n")
    want += [(2, n) for n in range(body.index("-----Original Message-----"), len(body)) if body[n].strip()]
    want += [(3, n) for n in lines(c, "Sent from my phone")]
    assert [x for x in gone(df) if x[0] < 10] == sorted(want)
    assert [n for i, n in gone(df) if i == 12] == [n for n, x in enumerate(others[2][5].split("\n")) if n > 11 and x and x != "Pat"]
    kept = {r.canon_id: r.new_text for r in mail.new_text(df).collect()}
    assert kept[1] == "Hi Bob,\n\nNew text here.\n\nBest,\nAnn" and kept[2] == "FYI"


def test_recurrent_closings_are_learnt(spark):
    notice = "Our house asks every reader of this letter to weigh paper before use."
    rows = [(i, ".eml", f"{i}.eml", None, None, HEAD.replace("Ann Reed", f"Pat N{i}").replace("ann@", f"p{i}@") + f"Point {i} is settled and filed today with care.\n\n{notice}") for i in range(8)]
    assert [n for i, n in gone(docs(spark, rows)) if i == 3] == lines(rows[3][5], notice)


def test_first_author_keeps_a_line(spark):
    said = "The green ledger was moved to the second floor last week."
    a = HEAD + said
    b = HEAD.replace("Ann Reed <ann@x.example>", "TMP").replace("Bob Low <bob@y.example>", "Ann Reed <ann@x.example>").replace("TMP", "Bob Low <bob@y.example>").replace("11 Apr", "12 Apr") + said + "\n\nI agree with it."
    got = gone(docs(spark, [(1, ".eml", "a.eml", None, None, a), (2, ".eml", "b.eml", None, None, b)]))
    assert got == [(2, n) for n in lines(b, said)]


def test_nothing_goes_without_the_method(spark, monkeypatch):
    """Without recurrence no closing goes, without dates and ranks no quotation does."""
    body = HEAD + "New text here.\n\nBest,\nAnn\n\nSent from my phone\n\nOn 2024-04-10 09:00, Bob Low wrote:\n> old text of mine"
    df = docs(spark, [(i, ".eml", "a.eml", None, None, body.replace("ann@", f"a{i}@")) for i in range(6)])
    assert len(gone(df)) == 18
    monkeypatch.setattr(mail, "SENDER_MESSAGES", 10**9)
    monkeypatch.setattr(mail, "ALL_MESSAGES", 10**9)
    assert len(gone(df)) == 12
    assert mail.removed(mail.message_lines(df).withColumn("at", F.lit(0.0))).count() == 0


def test_third_party_and_tied_dates(spark):
    """A line belongs to its first author among any number of parties; a mail converted twice is no copy of itself."""
    said = "The green ledger was moved to the second floor last week."
    first = HEAD.replace("- **To**: Bob Low <bob@y.example>", "- **To**: Bob Low <bob@y.example>, Cy Dee <cy@z.example>") + said
    later = HEAD.replace("Ann Reed <ann@x.example>", "Cy Dee <cy@z.example>").replace("- **To**: Bob Low <bob@y.example>", "- **To**: Ann Reed <ann@x.example>, Bob Low <bob@y.example>").replace("11 Apr", "13 Apr") + said + "\n\nI agree."
    stranger = HEAD.replace("Ann Reed <ann@x.example>", "Ed Fox <ed@f.example>").replace("11 Apr", "14 Apr") + said
    rows = [(1, ".eml", "a.eml", None, None, first), (2, ".eml", "b.eml", None, None, later), (3, ".eml", "c.eml", None, None, stranger), (4, ".eml", "a2.eml", None, None, first)]
    assert gone(docs(spark, rows)) == [(2, n) for n in lines(later, said)]


def test_mail_edges(spark):
    long = HEAD + "word " * 40_000
    rows = [(1, ".eml", "a.eml", None, None, None), (2, ".pdf", "a.pdf", None, None, "x"), (3, ".eml", "a.eml", None, None, ""), (4, ".pst", "a.pst", None, None, "# t\n\n| Field | Value |\n|---|---|\n| **From** | A B <a@b.example> |\n\n\ntext"), (5, None, None, None, None, "y"), (6, ".eml", "l.eml", None, None, long)]
    df = docs(spark, rows)
    assert gone(df) == [] and gone(df.unionAll(df)) == [] and gone(docs(spark, [])) == []


# ---- pages -------------------------------------------------------------------------------------------------------


def web(i, host="h.example", extra=""):
    return f"- [Home](/home)\n- [News](/news)\n\nHome > News > Title number {i}\n\n# Title number {i}\n\n{i}. May 2024\n\nParagraph {i} tells how case {i} was handled in the hall.\n\n## Notes\n\n- A sentence about case {i} in a list.\n{extra}\n**Most read**\n\n- [Other {i * 7}](/a/{i})\n[Thing {i * 3}](/n/{i})\n\nWe use cookies to count visits. [Accept](#ok)\n\n---\nImprint | Privacy\n© House {2000 + i}"


def test_template_goes_and_article_stays(spark):
    rows = [(i, ".html", f"{i}.html", f"https://h.example/p/{i}.html", f"Title number {i}", web(i, extra="\n| Holder | Number |\n| --- | --- |\n| A | 1 |\n" if i == 3 else "")) for i in range(12)]
    df = docs(spark, rows)
    got = {}
    for r in page.furniture_lines(df).collect():
        got.setdefault(r.canon_id, set()).add(r.line_no)
    for i, *_, body in rows:
        text = body.split("\n")
        stay = {n for n, x in enumerate(text) if x.startswith(("#", "Paragraph", "- A sentence", "|")) or x == f"{i}. May 2024"}
        assert got[i] == {n for n, x in enumerate(text) if x.strip()} - stay
    main = {r.canon_id: r.main_md for r in page.main_text(df).collect()}
    assert main[1].startswith("# Title number 1\n\n1. May 2024\n\nParagraph 1") and "cookies" not in main[1]
    assert page.host_report(df).first().n_pages == 12
    assert page.furniture_lines(df.unionAll(df)).count() == sum(map(len, got.values()))


def test_without_recurrence_nothing_goes(spark):
    """A single page has no template; the same page among others of its host has one; a few pages of a large host suffice."""
    alone = [(1, ".html", "1.html", "https://h.example/p/1.html", "Title number 1", web(1))]
    assert page.furniture_lines(docs(spark, alone)).count() == 0
    plain = [(100 + i, ".html", f"{i}.html", f"https://h.example/p/{i}.html", f"T{i}", f"# T{i}\n\nPage {i} holds {i * 13} words about case {i} of the hall.") for i in range(200)]
    some = [(i, ".html", f"{i}.html", f"https://h.example/p/{i}.html", f"Title number {i}", web(i)) for i in range(3)]
    got = page.furniture_lines(docs(spark, plain + some)).groupBy("canon_id").count().collect()
    assert {r.canon_id for r in got} == {0, 1, 2} and len({r["count"] for r in got}) == 1
    assert page.furniture(web(1), "Title number 1", set()) == []


def test_page_edges(spark):
    rows = [(1, ".html", None, None, None, None), (2, ".htm", "x.htm", None, None, ""), (3, None, "x.html", "no uri", None, "just one sentence stands here."), (4, ".pdf", "x.pdf", None, None, "x"), (5, ".html", "y.html", "https://b.example/", "T", "# T\n\n" + "A long tale of paper. " * 20_000)]
    assert page.furniture_lines(docs(spark, rows)).count() == 0 and page.furniture_lines(docs(spark, [])).count() == 0
