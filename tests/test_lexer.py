"""The pass that tells code from comments and strings."""

import re

import pytest

from pyspark.sql import functions as F

from codelattice.sources.lexer import brackets, code_lines, mask, runner_calls

CASES = [
    ("javascript", "script", "a('x(', \"y'(\") // c(\nb", "a('  ', \"   \")       \nb"),
    ("javascript", "script", "/* a\n * see /* b */ f() /* c */ g()", "    \n              f()           g()"),
    ("javascript", "script", "/* a\n*/ x /*\ny */ z", "    \n   x   \n     z"),
    ("javascript", "script", "`a ${f(`b ${g({k: 1})} }`)} {`;h()", "`    f(`    g({k: 1})   `)   `;h()"),
    ("javascript", "script", "`a \\` ${'}'} `+b", "`       ' '  `+b"),
    ("javascript", "script", "x = /[/\"]{/g; y = a / b / c('d')", "x = /     /g; y = a / b / c(' ')"),
    ("javascript", "script", "'open\nf()", "'    \nf()"),
    ("rust", "rust", "fn f<'a>(x: &'a str) { '{'; /* a /* b */ c */ g() }", "fn f<'a>(x: &'a str) { ' ';                   g() }"),
    ("c", "c_like", "/* a /* b */ c()\n#define X don't {\nd('\\'')", "             c()\n                 \nd('  ')"),
    ("java", "c_like", 'x = """a "q" {\n// b""" + c()', 'x = """       \n    """ + c()'),
    ("go", "go", "x := `a\\` + \"b`\" // `", "x := `  ` + \"  \"     "),
    ("lua", "lua", "--[[ a\nb ]] c() --d\nx = [==[ ]] ]==] e", "      \n     c()    \nx = [==[    ]==] e"),
    ("ruby", "ruby", "=begin\ndef a\n=end\ndef b # c", "      \n     \n    \ndef b    "),
    ("perl", "perl", "$#a; # b\n=pod\nsub c\n=cut\nd", "$#a;    \n    \n     \n    \nd"),
    ("python", "python", "f('''a(\n#''', 'b') # c", "f('''  \n ''', ' ')    "),
    ("r", "r", "f('a\nb(') # c", "f(' \n  ')    "),
]


@pytest.mark.parametrize("language,group,source,expected", CASES)
def test_code_of_texts(language, group, source, expected):
    text, code = mask(source, language, group)
    assert re.sub(" +", " ", code) == re.sub(" +", " ", expected)
    assert all(c in (" ", o) for c, o in zip(code, source)) and all(t in (" ", o) for t, o in zip(text, source))
    assert len(text) == len(source) and [len(x) for x in text.split("\n")] == [len(x) for x in source.split("\n")]


@pytest.mark.parametrize("piece", ["'", '"', "`", "/*", "${", "}", "--[[", "\\", "=begin\n", '"""'])
def test_open_ends_and_long_texts(piece):
    """Unfinished and very long texts end, with every offset kept."""
    for language, group in [("javascript", "script"), ("kotlin", "c_like"), ("rust", "rust"), ("lua", "lua"), ("ruby", "ruby"), ("python", "python")]:
        for source in (piece, piece * 2000, "a" * 100_000 + piece + "b" * 100_000, ""):
            text, code = mask(source, language, group)
            assert len(text) == len(code) == len(source)


def test_brackets_and_runner_calls():
    assert brackets("(a[1]{)") == {0: 6, 2: 4}
    source = "it('a', () => { describe.skip(`b\n c ${1}`, f) }); it.each([1])('n', g); x.it('z'); it`t`"
    code = mask(source, "javascript", "script")[1]
    assert [(name, code[first:last + 1][:9]) for name, first, last, _ in runner_calls(source, code)] == [
        ("it:a", "it(' ', ("), ("describe:b c ${1}", "describe."), ("it:n", "it.each([")]


def test_blanked_lines_take_linear_time(spark):
    """A long comment leaves a line of blanks; import and function patterns must not try it again from each of them."""
    import time

    from codelattice.sources.line_patterns import PATTERNS

    _, functions, imported = PATTERNS["script"]
    blanks = F.repeat(F.lit(" "), 100_000)
    rows = spark.range(1).select(
        blanks.alias("a"), F.concat(F.lit("import x from"), blanks).alias("b"), F.concat(F.lit("function"), blanks).alias("c"),
        F.concat(F.lit("import x from  "), F.lit('  "m"')).alias("d"), F.lit("  const m = require( 'n' )").alias("e"), F.lit("function  * go (").alias("f"))
    start = time.time()
    got = rows.select(*[F.regexp_extract(c, imported, 1) for c in "abde"], *[F.regexp_extract(c, functions[0], 1) for c in "cf"]).first()
    assert tuple(got) == ("", "", "m", "n", "", "go") and time.time() - start < 15


def test_texts_are_dealt_over_tasks(spark, sf_dir):
    """One small file of keys makes many large texts, which one task must not read alone."""
    from codelattice.plans import source_queries as Q
    from codelattice.sources.commerce import workspace

    w = workspace(spark, sf_dir)
    for texts in (Q.flow_texts(w), Q.python_files(w)):
        assert "RepartitionByExpression" in texts._jdf.queryExecution().optimizedPlan().toString()


def test_blank_lines_are_left_out_but_for_the_last(spark):
    """Lines hidden whole hold nothing to find; the last one still says how long the file is."""
    source = "a()\n/*\n" + "hidden {\n" * 50 + "*/\n\nb()\n\n"
    files = spark.createDataFrame([("x.js", "script", "javascript", source)], "file_path string, group string, language string, text string")
    rows = {r["line"]: r["code"].strip() for r in code_lines(files).collect()}
    assert rows == {1: "a()", 55: "b()", 57: ""}
