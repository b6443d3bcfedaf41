"""Scalar expressions and small parsers."""

import pytest
from pyspark.sql import functions as F

from codelattice.functions import findings as X
from codelattice.functions import paths as P
from codelattice.functions import text as T
from codelattice.functions.stemming import porter_stem
from codelattice.operators import refactor as RF
from codelattice.operators.search import kind_boosts
from codelattice.sources.diff import parse_unified_diff
from codelattice.sources.files import safe_ref


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [
    ("CWE-089", "CWE-89"), ("cwe-89", "CWE-89"), (" cwe-0 ", "CWE-0"), ("", ""), (None, ""), ("CWE-89: Improper", "CWE-89: IMPROPER"), ("other", "OTHER"),
])
def test_cwe(spark, raw, want):
    assert one(spark, X.normalise_cwe, raw) == want


@pytest.mark.parametrize("raw,severity,rank", [
    ("error", "HIGH", 2), ("WARNING", "MEDIUM", 2), ("INFO", "LOW", 2), ("critical", "CRITICAL", 4), (None, "MEDIUM", 2), ("odd", "MEDIUM", 2), ("low", "LOW", 1),
])
def test_severity(spark, raw, severity, rank):
    assert one(spark, X.normalise_severity, raw) == severity
    assert one(spark, X.dedup_rank, raw) == rank


def test_verdict(spark):
    text = "VERDICT: false_positive\nSEVERITY: low\nCVSS: 1.2.3\nCVSS_VECTOR: N/A\nDESCRIPTION: a\nb\nPOC: none\nREASONING: end"
    v = one(spark, X.parse_verdict, text)
    assert (v["verdict"], v["severity"], v["cvss_score"], v["cvss_vector"], v["description"], v["poc"], v["reasoning"]) == (
        "FALSE_POSITIVE", "LOW", None, None, "a\nb", None, "end")
    assert one(spark, X.parse_verdict, "nothing")["verdict"] == "NEEDS_REVIEW"


@pytest.mark.parametrize("path,want", [("a/b.PY", "python"), ("x.tsx", "tsx"), ("Makefile", None), ("a.b/c", None), (".py", None)])
def test_language(spark, path, want):
    assert one(spark, P.language_of, path) == want


def test_names(spark):
    assert one(spark, T.split_identifier, "getUserName_v2.x") == ["get", "User", "Name", "v2", "x"]
    assert one(spark, T.slug, "--A b__C--") == "a-b-c"
    assert one(spark, T.sanitize_name, "a\x00b\tc\x1f") == "ab\tc"
    assert one(spark, lambda c: T.contains_text(c, "get_u", wildcards=True), "GetXUser") is True
    assert one(spark, lambda c: T.contains_text(c, "get_u"), "GetXUser") is False
    assert one(spark, lambda c: T.line_slice(c, F.lit(2), F.lit(9)), "a\nb\r\nc") == "b\nc"
    assert one(spark, lambda c: P.relative_to(c, "/t"), "/t/x.py") == "x.py"


def test_diff(spark):
    text = "\n".join(["+++ b/a.py", "@@ -1 +5 @@", "+x", "@@ -1,2 +7,3 @@ f", "@@ -9,2 +9,0 @@", "+++ b/dir/b.py", "@@ -1 +1,2 @@", "+++ /dev/null", "@@ -1 +4 @@"])
    got = [(r["file_path"], r["start"], r["end"]) for r in parse_unified_diff(spark.createDataFrame([("d", text)], "diff_id string, text string")).collect()]
    assert got == [("a.py", 5, 5), ("a.py", 7, 9), ("a.py", 9, 9), ("dir/b.py", 1, 2), ("dir/b.py", 4, 4)]


def test_apply_edits(spark):
    src = spark.createDataFrame([("a.py", "x foo foo\nfoo(1)\nbar")], "file_path string, text string")
    edits = spark.createDataFrame([("a.py", 2, "foo", "baz"), ("a.py", 3, "foo", "qux")], "file string, line int, old string, new string")
    assert RF.apply_edits(src, edits).first()["text"] == "x qux foo\nbaz(1)\nbar"
    bad = spark.createDataFrame([("../x", 1), ("/r/a", 1), ("/etc/p", 1), ("a/b.py", 1)], "file string, line int")
    assert {r["file"] for r in RF.safe_paths(bad, "/r").collect()} == {"/r/a", "a/b.py"}


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("adjustment", "adjust"), ("sky", "sky")])
def test_stem(word, want):
    assert porter_stem(word) == want


def test_boosts_and_refs():
    assert kind_boosts("MyClass") == {"Class": 1.5, "Type": 1.5}
    assert kind_boosts("get_users.x") == {"Function": 1.5, "_qualified": 2.0}
    assert kind_boosts("  ") == {}
    assert safe_ref("HEAD~1") and not safe_ref("a;b") and not safe_ref("-x")
