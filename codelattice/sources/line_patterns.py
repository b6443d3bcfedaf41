"""Definitions, imports and calls by line patterns, for languages without a syntax tree.

Lines come from the pass of ``lexer``, which blanks comments and strings; they are
stored once, all steps over them are built-in expressions. Block depth (braces, or
block words in Lua and Ruby) is a running sum per file, so a block ends where its
depth is reached again. Calls of test runners in script test files become Test
nodes named ``it:description@L7`` below the function or test around them; a line's
calls belong to the last function or test that starts on or before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice import schema as S
from codelattice.session import stage
from codelattice.sources.lexer import MODIFIERS, code_lines

_WORD = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|virtual|open|sealed|pub(?:\([^)]*\))?|unsafe|suspend|inline|const)\s+)*"

# language group → (class pattern, function patterns, import pattern)
PATTERNS: dict[str, tuple[str, tuple[str, ...], str]] = {
    "script": (
        rf"^\s*{_MODS}(?:class|interface)\s+{_WORD}",
        (rf"^\s*{_MODS}function\s*+\*?\s*+{_WORD}\s*\(", rf"^\s*{_MODS}(?:const|let|var)\s+{_WORD}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>",
         rf"^\s*{_MODS}(?:const|let|var)\s+{_WORD}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*:[^=]+=>)",
         rf"^\s+{_MODS}{_WORD}\s*\((?![^;]*\bfunction\b)[^;]*\)\s*(?::[^{{]+)?\{{\s*$"),
        # White space is never given back: a blanked line of n characters would be tried n times.
        r"""^\s*+(?:import\b.*?\bfrom\s++|import\s++|.*\brequire\()\s*+["']([^"']+)["']""",
    ),
    "c_like": (
        rf"^\s*{_MODS}(?:class|interface|enum|struct|record|object|trait|protocol|contract|library|mixin)\s+{_WORD}",
        (rf"^\s*{_MODS}(?:[\w<>\[\],.?&*:]+\s+)+[*&]?{_WORD}\s*\([^;]*$", rf"^\s*{_MODS}(?:fun|func|function|def)\s+(?:<[^>]*>\s*)?{_WORD}\s*[(\[]"),
        r"""^\s*(?:import|using|use|#include|@import)\s+(?:static\s+)?["<]?([\w./:\\*{}, -]+?)[">]?\s*;?\s*$""",
    ),
    "go": (
        rf"^\s*type\s+{_WORD}\s+(?:struct|interface)",
        (rf"^\s*func\s+(?:\([^)]*\)\s*)?{_WORD}\s*[(\[]",),
        r"""^\s*(?:import\s+)?(?:\w+\s+)?"([^"]+)"\s*$""",
    ),
    "rust": (
        rf"^\s*{_MODS}(?:struct|enum|trait|impl)\s+(?:<[^>]*>\s*)?{_WORD}",
        (rf"^\s*{_MODS}fn\s+{_WORD}",),
        r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    ),
    "r": (
        rf"""^\s*set(?:Ref)?Class\(\s*["']{_WORD}""",
        (rf"^\s*{_WORD}\s*(?:<-|=)\s*function\s*\(",),
        r"""^\s*(?:library|require|source)\(\s*["']?([\w./]+)""",
    ),
    "perl": (
        r"^\s*package\s+([\w:]+)",
        (rf"^\s*sub\s+{_WORD}",),
        r"^\s*(?:use|require)\s+([A-Za-z][\w:]*)",
    ),
    "lua": (
        r"^\s*(?:local\s+)?([A-Z]\w*)\s*=\s*(?:class|setmetatable)\b",
        (r"^\s*(?:local\s+)?function\s+(?:[\w.]+[.:])?(\w+)\s*\(", r"^\s*(?:local\s+)?(?:[\w.]+\.)?(\w+)\s*=\s*function\s*\("),
        r"""\brequire\s*\(?\s*["']([^"']+)["']""",
    ),
    "ruby": (
        r"^\s*(?:class|module)\s+([A-Z]\w*)",
        (r"^\s*def\s+(?:self\.)?(\w+)",),
        r"""^\s*require(?:_relative)?\s*\(?\s*["']([^"']+)["']""",
    ),
}

GROUP = {
    "javascript": "script", "typescript": "script", "tsx": "script", "vue": "script",
    "java": "c_like", "csharp": "c_like", "kotlin": "c_like", "swift": "c_like", "php": "c_like",
    "scala": "c_like", "dart": "c_like", "c": "c_like", "cpp": "c_like", "solidity": "c_like",
    "go": "go", "rust": "rust", "r": "r", "perl": "perl", "lua": "lua", "ruby": "ruby",
}

_NOT_CALLS = (
    "if", "for", "while", "switch", "catch", "return", "function", "func", "fn", "fun", "def",
    "new", "sizeof", "typeof", "else", "match", "when", "super", "constructor", "elsif", "elseif", "unless", "sub", "and", "or", "not",
)
_NOT_NAMES = ("if", "for", "while", "switch", "catch", "return", "else", "new", "throw", "match", "when")


def _by_group(group: Column, pick) -> Column:
    out = F.lit("")
    for name, spec in PATTERNS.items():
        out = F.when(group == name, pick(spec)).otherwise(out)
    return out


def _count(code: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(code, F.lit(pattern), 0))


def _opens(group: Column, code: Column) -> Column:
    """Blocks that a line opens."""
    lua = _count(code, r"\b(?:function|do|then)\b") - _count(code, r"\belseif\b")
    ruby = _count(code, r"^\s*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
    return F.when(group == "lua", lua).when(group == "ruby", ruby).otherwise(F.length(code) - F.length(F.replace(code, F.lit("{"), F.lit(""))))


def _closes(group: Column, code: Column) -> Column:
    words = _count(code, r"\bend\b")
    return F.when(group.isin("lua", "ruby"), words).otherwise(F.length(code) - F.length(F.replace(code, F.lit("}"), F.lit(""))))


def extract_by_lines(files: DataFrame) -> DataFrame:
    """Records in the shape of the Python reader for (file_path, text, language)."""
    flat: list[Column] = []
    for lang, group in GROUP.items():
        flat += [F.lit(lang), F.lit(group)]
    group = F.try_element_at(F.create_map(*flat), F.col("language"))
    lines = stage(code_lines(files.withColumn("group", group).where(F.col("group").isNotNull())), "lines")
    ups, downs = _opens(F.col("group"), F.col("code")), _closes(F.col("group"), F.col("code"))
    running = Window.partitionBy("file_path").orderBy("line")
    first = lambda pattern, column="code": F.regexp_extract(column, pattern, 1)

    def function_name(spec) -> Column:
        hits = [F.nullif(first(p), F.lit("")) for p in spec[1]]
        found = F.coalesce(*hits, F.lit(""))
        return F.when(F.col("calls").isNotNull() & found.isin(*S.TEST_RUNNER_NAMES), "").otherwise(found)

    marked = lines.select(
        "file_path", "group", "line", "text", "code", "calls",
        F.sum(ups - downs).over(running).alias("depth"),
        (ups - downs).alias("_net"), ups.alias("_ups"),
        _by_group(F.col("group"), lambda s: first(s[0])).alias("cls"),
        _by_group(F.col("group"), function_name).alias("fn"),
        _by_group(F.col("group"), lambda s: first(s[2], "text")).alias("imp"),
    ).withColumn("before", F.col("depth") - F.col("_net"))
    defs = marked.where((F.col("cls") != "") | ((F.col("fn") != "") & ~F.col("fn").isin(*_NOT_NAMES))).select(
        "file_path", "line", "before", F.when(F.col("cls") != "", "Class").otherwise("Function").alias("kind"),
        F.when(F.col("cls") != "", F.col("cls")).otherwise(F.col("fn")).alias("name"),
        # Lua: ``function Box.area`` and ``function Box:area`` belong to the table Box.
        F.when(F.col("group") == "lua", F.nullif(first(r"^\s*function\s+(?:\w+[.])*(\w+)[.:]\w+\s*\("), F.lit(""))).alias("table"),
        ((F.col("_ups") > 0) & (F.col("_net") == 0)).alias("one_line"),
    )
    # The block of a definition closes at the first later line back at its depth.
    closes = marked.where(F.col("_net") < 0).select("file_path", F.col("line").alias("close"), "depth")
    # From the last line on, so that the nearest close is a running minimum.
    level = Window.partitionBy("file_path", "level").orderBy(F.desc("at"), F.desc("is_close")).rowsBetween(Window.unboundedPreceding, -1)
    events = defs.select("file_path", F.col("before").alias("level"), F.col("line").alias("at"), F.lit(0).alias("is_close")).unionByName(
        closes.select("file_path", F.col("depth").alias("level"), F.col("close").alias("at"), F.lit(1).alias("is_close"))
    )
    ends = events.withColumn("stop", F.min(F.when(F.col("is_close") == 1, F.col("at"))).over(level)).where("is_close = 0").select(
        "file_path", F.col("at").alias("line"), "stop"
    ).distinct()
    spans = defs.join(ends, ["file_path", "line"]).withColumn(
        "last", F.when(F.col("one_line"), F.col("line")).otherwise(F.coalesce("stop", F.col("line")))
    )
    tests = lines.where(F.col("calls").isNotNull()).select("file_path", "line", F.explode("calls").alias("c")).select(
        "file_path", "line", "c.name", "c.last", "c.column", "c.around",
    )
    # Innermost enclosing class and function of each line, by the latest start.
    at = F.struct("start", "column")
    covered = spans.select("file_path", "kind", "name", F.lit(-1).alias("column"), "line", "last").unionByName(
        tests.select("file_path", F.lit("Test").alias("kind"), "name", "column", "line", "last")
    ).unionByName(
        spans.where(F.col("table").isNotNull()).select(
            "file_path", F.lit("Table").alias("kind"), F.col("table").alias("name"), F.lit(-1).alias("column"), "line", "last")
    ).select("file_path", "kind", "name", "column", F.col("line").alias("start"), F.explode(F.sequence("line", "last")).alias("line"))
    earlier = F.col("start") < F.col("line")
    inside = covered.groupBy("file_path", "line").agg(
        F.coalesce(
            F.max_by("name", F.when(F.col("kind") == "Table", at)), F.max_by("name", F.when((F.col("kind") == "Class") & earlier, at))
        ).alias("in_class"),
        F.max_by("name", F.when(F.col("kind").isin("Function", "Test"), at)).alias("in_func"),
        F.max_by("name", F.when(F.col("kind").isin("Function", "Test") & earlier, at)).alias("above"),
    )
    empty = lambda t="string": F.lit(None).cast(t)
    shaped = lambda df, **c: df.select(
        c["rec"].alias("rec"), c["kind"].alias("kind"), c.get("name", empty()).alias("name"), "file_path",
        F.col("line").cast("int").alias("line_start"), c.get("end", empty("int")).alias("line_end"),
        c.get("parent", empty()).alias("parent_name"), empty().alias("params"), empty().alias("return_type"),
        empty("array<string>").alias("decorators"), c.get("top", empty("boolean")).alias("top_level"),
        c.get("source", empty()).alias("source"), c.get("target", empty()).alias("target"),
    )
    sizes = lines.groupBy("file_path").agg(F.max("line").alias("n")).withColumn("line", F.lit(1))
    file_rows = shaped(sizes, rec=F.lit("node"), kind=F.lit("File"), name=F.col("file_path"), end=F.col("n").cast("int"))
    symbols = spans.join(inside, ["file_path", "line"], "left")
    def_rows = shaped(
        symbols, rec=F.lit("node"), kind=F.col("kind"), name=F.col("name"), end=F.col("last").cast("int"),
        parent=F.col("in_class"), top=F.col("in_class").isNull() & (F.col("before") == 0),
    )
    owned = lambda name: F.concat("file_path", F.lit("::"), F.when(F.col("in_class").isNotNull(), F.concat("in_class", F.lit("."), name)).otherwise(name))
    around = F.coalesce("around", "above")
    test_rows = shaped(
        tests.join(inside, ["file_path", "line"]), rec=F.lit("node"), kind=F.lit("Test"), name=F.col("name"), end=F.col("last").cast("int"),
        parent=F.col("in_class"), top=F.lit(False), source=F.when(around.isNull(), F.col("file_path")).otherwise(owned(around)),
    )
    import_rows = shaped(
        marked.where(F.col("imp") != ""), rec=F.lit("edge"), kind=F.lit("IMPORTS_FROM"),
        source=F.col("file_path"), target=F.trim("imp"),
    )
    body = marked.join(inside, ["file_path", "line"]).where(F.col("in_func").isNotNull())
    called = body.select(
        "file_path", "line", "in_class", "in_func", "fn", F.col("calls").isNotNull().alias("runs"),
        F.explode(F.regexp_extract_all("code", F.lit(rf"{_WORD}\s*\("), 1)).alias("callee"),
    ).where(~F.col("callee").isin(*_NOT_CALLS) & (F.col("callee") != F.col("fn"))
            & ~(F.col("runs") & F.col("callee").isin(*S.TEST_RUNNER_NAMES, *MODIFIERS)))
    call_rows = shaped(
        called, rec=F.lit("edge"), kind=F.lit("CALLS"), source=owned(F.col("in_func")), target=F.col("callee"),
    )
    # ``import D, { a, b as c } from "m"`` binds D, a and c to m.
    binding = r"""^\s*import\s+(?:type\s+)?(.+?)\s+from\s+["']"""
    bound = (
        marked.where((F.col("imp") != "") & (first(binding, "text") != "")).select(
            "file_path", "line", "imp",
            F.explode(F.split(F.regexp_replace(first(binding, "text"), r"[{}]", ","), ",")).alias("item"),
        )
        .select("file_path", "line", "imp", F.regexp_extract(F.trim("item"), r"(\w+)$", 1).alias("name"))
        .where(F.col("name") != "")
    )
    name_rows = shaped(bound, rec=F.lit("name"), kind=F.lit("IMPORT"), name=F.col("name"), target=F.trim("imp"))
    return file_rows.unionByName(def_rows).unionByName(test_rows).unionByName(import_rows).unionByName(call_rows).unionByName(name_rows)
