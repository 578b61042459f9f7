import io
import zipfile

import pytest

from sheafline.operators import benchmark, review
from sheafline.sources import exports, policies
from pyspark.sql import functions as F


def test_packs_from_files(tmp_path):
    (tmp_path / "base.toml").write_text('id = "base"\n[[rules]]\nid = "sources-required"\nseverity = "error"\ncondition = "sources.missing"\n')
    (tmp_path / "child.toml").write_text('id = "child"\nextends = ["base"]\n[[rules]]\nid = "old"\ncondition = "stale.expired"\n')
    assert [r[0] for r in policies.load_pack(tmp_path / "child.toml")] == ["sources-required", "old"]
    (tmp_path / "loop.toml").write_text('extends = "loop"\n')
    (tmp_path / "twice.toml").write_text('extends = "base"\n[[rules]]\nid = "sources-required"\ncondition = "sources.missing"\n')
    (tmp_path / "bad.toml").write_text('[[rules]]\nid = "X"\ncondition = "nope"\n')
    for name in ("loop", "twice", "bad", "absent"):
        with pytest.raises(policies.PolicyError):
            policies.load_pack(tmp_path / f"{name}.toml")
    (tmp_path / "p.toml").write_text('[trust]\ntypes = ["Note"]\n')
    assert policies.load_policy(tmp_path / "p.toml") == {"types": ("Note",), "statuses": ("*",), "verified": ("*",)}


def test_export(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a/One.md", "# One Page\n\n## Properties\n**Owner:** Al\n**State:** open\n\n## Text\nx")
        z.writestr("b/One.md", "# One Page\n")
        z.writestr("t.csv", "h,i\n1,2\n3,4\n")
        z.writestr("pic.png", "p")
        z.writestr("../evil.md", "# no")
    df = spark.createDataFrame([("x.zip", bytearray(out.getvalue())), ("y.zip", bytearray(b"no"))], "relpath string, content binary")
    m = exports.pages(df)
    rows = {r.path: r for r in m.where("archive = 'x.zip'").collect()}
    assert rows["a/One.md"].properties == {"Owner": "Al", "State": "open"} and rows["t.csv"].n_rows == 2 and set(rows) == {"a/One.md", "b/One.md", "t.csv", "pic.png"}
    assert {r.path: r.target for r in exports.target_names(m).collect()} == {"a/One.md": "one_page.md", "b/One.md": "one_page-1.md"}
    s = {r.archive: (r.n_pages, r.n_databases, r.n_files) for r in exports.summary(m).collect()}
    assert s == {"x.zip": (2, 1, 1), "y.zip": (0, 0, 0)}


def test_review_log(spark):
    e = spark.createDataFrame([("a", 1, "claim", "ann"), ("a", 2, "claim", "bob"), ("a", 3, "decide", "bob"), ("a", 4, "claim", "ann"), ("b", 1, "decide", "ann"), ("c", 1, "claim", "ann"), ("c", 2, "decide", "ann"), ("d", 1, "suppress", "x")], "item string, seq int, action string, reviewer string")
    got = {r.item: (r.state, r.reviewer, r.rejected) for r in review.fold(e).collect()}
    assert got == {"a": ("claimed", "ann", 2), "b": ("open", None, 1), "c": ("decided", "ann", 0), "d": ("suppressed", None, 0)}


def test_benchmark(spark):
    df = spark.createDataFrame([("# A\n\n## B\ntext one", ["one", "gone"], ["A", "B"]), ("x", [], ["A"])], "t string, a array<string>, h array<string>")
    got = df.select(benchmark.anchor_recall(F.col("t"), F.col("a")).alias("r"), benchmark.heading_order(F.col("t"), F.col("h")).alias("h")).collect()
    assert [(r.r, r.h) for r in got] == [(0.5, True), (1.0, False)]
    a, b = spark.createDataFrame([("f", 1.0), ("g", 1.0)], "k string, m double"), spark.createDataFrame([("f", 0.75)], "k string, m double")
    assert [tuple(r) for r in benchmark.deltas(a, b, "k", ("m",)).collect()] == [("f", "m", 0.25)]
    assert [r.k for r in benchmark.unknown_fixtures(a, b, "k").collect()] == ["g"]
