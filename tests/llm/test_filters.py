"""URL rules and the filter audit."""

import math
import random

from pyspark.sql import functions as F

from codelattice.llm import filter_audit, url_rules
from helpers import odd_rows

RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
    ("block", "org", ""), ("allow", "a.org", "/x"), ("block", "a.org", "/xy"), ("allow", "b.a.org", "/x/y/z"), ("block", "com:80", "/"), ("allow", "", ""),
]


def odd_urls():
    hosts = ["net", "Example.NET", "m.example.net", "xnet", ".net", "net.", "example.com", "a.example.com", "org", "a.org", "b.a.org", "c.b.a.org", "u@a.org", "com:80", "", "日本.net", "a..org"]
    paths = ["", "/", "/en/", "/en", "/EN/1", "/de/5.html", "/fr/", "/x", "/xy", "/xyz/1", "/x/y/z", "/x/y/zz/", "//x", "/é/x", "?q=/en/", "#/de/", "/fr?x#y", "/de/#?", "/en/?://"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS", "") for h in hosts for p in paths]
    return [*urls, None, "", "no scheme", "http:/a.org/x", "://", "a://b://c/d", "x://" + "a." * 3000 + "net/" + "en/" * 3000, "http://net/" + "z" * 100_000]


def pages(spark, urls):
    rows = [(i, u, "x", "y", "z", 1) for i, u in enumerate(urls)] + [(3, urls[3], "x", "y", "z", 1), (None, urls[5], "x", "y", "z", 1), (3, None, "x", "y", "z", 1)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, prefix int").repartition(3)


def test_url_rules_equal_brute_force(spark):
    rows, df = pages(spark, odd_urls())
    for rules, default in ((RULES[:4], "allow"), (RULES, "block"), (RULES[:9], "allow")):
        got = url_rules.judge(df, url_rules.rules_of(spark, rules), default=default).collect()
        want = [(r[0], *x) for r, x in zip(rows, url_rules.brute_force([r[1] for r in rows], rules, default), strict=True)]
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    kept = url_rules.reject(df, url_rules.rules_of(spark, RULES[:4]))
    want = [r for r, x in zip(rows, url_rules.brute_force([r[1] for r in rows], RULES[:4]), strict=True) if x[3] == "allow"]
    assert kept.columns == df.columns and sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_many_url_rules(spark):
    random.seed(4)
    rules = sorted({(random.choice(["allow", "block"]), ".".join(random.choices("abcd", k=random.randint(1, 4))), "/" + "/".join(random.choices(["x", "yy", "z1", "z12", ""], k=random.randint(0, 3)))) for _ in range(400)})
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    urls = ["http://" + ".".join(random.choices("abcd", k=random.randint(1, 6))) + "/" + "/".join(random.choices(["x", "yy", "z1", "z12", "z123"], k=random.randint(0, 4))) for _ in range(3000)]
    rows, df = pages(spark, urls)
    got = url_rules.judge(df, url_rules.rules_of(spark, rules)).collect()
    want = [(r[0], *x) for r, x in zip(rows, url_rules.brute_force([r[1] for r in rows], rules), strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_url_tables_without_rows_and_rules(spark):
    rows, df = pages(spark, odd_urls()[:20])
    assert url_rules.judge(df.limit(0), url_rules.rules_of(spark, RULES)).count() == 0
    none = url_rules.judge(df, url_rules.rules_of(spark, []), default="block").collect()
    assert len(none) == len(rows) and {(r["rule"], r["verdict"]) for r in none} == {(None, "block")}
    odd = url_rules.rules_of(spark, [("block", "NET", "/"), ("allow", "net", "/"), ("maybe", "net", "/en/"), ("block", None, "/"), ("allow", "org", None)])
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_rules.judge(df.where("page_id < 3").withColumn("url", df["url"]), odd).collect()}
    assert got[1] == ("net/", "block")


# ---------------------------------------------------------------- filter audit

def audited_rows():
    random.seed(9)
    rows = [(k, t, random.choice(["a", "b", "", None])) for k, t in odd_rows()]
    for i in range(100, 190):
        words = [random.choice(["word", "Large", "UPPER", "x#y", "plain", f"w{random.randrange(90)}"]) for _ in range(random.choice([10, 49, 50, 51, 90]))]
        if i % 3:
            words = [f"u{random.randrange(10**6)}" for _ in words]
        rows.append((i, " ".join(words) + random.choice(["", "", "|", " A" * 12]), f"s{i % 4}"))
    rows += [(i + 100, rows[i][1], "copies") for i in range(30, 60)] + [(k, t, "b") for k, t, _ in rows[20:40]]
    return rows


def test_audit_equals_brute_force(spark):
    rows = audited_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for name in ("part", "mask", "key", "n", "good", "digest", "quality"):
        df = df.withColumn(name, F.lit("x"))
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 260, 2)] + [(101, 1, 0), (101, 0, 1), (None, 1, 1), (103, None, 1)]
    got = filter_audit.audit(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    known = {}
    for k, q, t in marks:
        a = known.get(k, (0, 0))
        known[k] = (max(a[0], q or 0), max(a[1], t))
    known.pop(None)
    want = filter_audit.brute_force(rows, known)
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 600 * len({r["part"] for r in got})
    assert len({tuple(r)[4:] for r in got}) > 50


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = filter_audit.audit(docs.unionAll(spark.createDataFrame([(1, None, None)], docs.schema)), labels).collect()
    assert len(one) == 600 and {(r["part"], r["kept"] + r["removed"]) for r in one if r["step"] == 1} == {("", 1)}


def test_swaps_meet_all_orders_and_keep_counts():
    random.seed(3)
    for n in (1, 2, 3, 4, 5):
        cells = {m: (random.randrange(9), random.randrange(5), random.randrange(3)) for m in random.sample(range(2**n), random.randint(1, 2**n))}
        diagram, met = filter_audit.Diagram(cells, n), set()
        for level in [None, *filter_audit.neighbour_swaps(n)]:
            if level is not None:
                diagram.swap(level)
            met.add(tuple(diagram.order))
            assert diagram.weight[diagram.root] == tuple(map(sum, zip(*cells.values(), strict=True)))
            mask = 0
            for one, kept, removed in diagram.steps():
                inside = [c for m, c in cells.items() if not m & mask]
                mask |= 1 << one
                assert kept == tuple(sum(x) for x in zip((0, 0, 0), *[c for m, c in cells.items() if not m & mask], strict=True))
                assert removed[0] == sum(c[0] for c in inside) - kept[0]
        assert len(met) == math.factorial(n)
