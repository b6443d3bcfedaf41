"""Source texts to nodes and raw edges; resolution happens in Spark joins.

Python files are read with the standard syntax tree, one file per row; a file that
does not parse is read by its lines and indentation, and its File node says so
(``extra["reader"] = "lines"``). Other languages go through ``line_patterns``.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.functions.paths import is_test_file, is_test_function, qualified_name
from codelattice.sources.lexer import brackets, mask

RECORDS = (
    "rec string, kind string, name string, file_path string, line_start int, line_end int, "
    "parent_name string, params string, return_type string, decorators array<string>, "
    "top_level boolean, source string, target string"
)
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in RECORDS.split(", "))])
# A result batch ends with the file that fills it.
BATCH_ROWS = 10_000

_BLOCK = re.compile(r"\s*(?:async\s+)?(def|class)\s+(\w+)")
_IMPORT = re.compile(r"\s*import\s+(.+)")
_FROM = re.compile(r"\s*from\s+(\.*[\w.]*)\s+import\s+(.+)")
_CALLED = re.compile(r"([A-Za-z_]\w*)\s*\(")


def _records_by_indent(path: str, text: str) -> list[dict]:
    """Definitions, bases, imports and calls of a file with a syntax error.

    A block ends before the next code at its indentation or left of it; lines
    inside brackets do not count, but for those that start a definition or an import.
    """
    out: list[dict] = []
    shown, code = mask(text.replace("\r\n", "\n").replace("\r", "\n"), "python", "python")
    blocks: list[tuple[int, dict]] = []
    depth = 0
    for n, (plain, line) in enumerate(zip(shown.split("\n"), code.split("\n")), 1):
        if not line.strip():
            continue
        head, single, several = _BLOCK.match(line), _IMPORT.match(line), _FROM.match(line)
        if head or single or several:
            depth = 0
        wide = line.expandtabs()
        indent = len(wide) - len(wide.lstrip())
        while depth == 0 and blocks and blocks[-1][0] >= indent:
            blocks.pop()
        for _, block in blocks:
            block["line_end"] = n
        if head:
            cls = next((b["name"] for _, b in reversed(blocks) if b["kind"] == "Class"), None)
            start, closes = line.find("(", head.end()), brackets(line)
            inner = plain[start:closes[start] + 1] if start in closes else None
            kind = "Class" if head.group(1) == "class" else "Function"
            block = {"rec": "node", "kind": kind, "name": head.group(2), "line_start": n, "line_end": n,
                     "parent_name": cls, "top_level": not blocks, "params": inner if kind == "Function" else None}
            place = f"{path}::{cls}.{head.group(2)}" if cls else f"{path}::{head.group(2)}"
            out.append(block)
            blocks.append((indent, block))
            if kind == "Class" and inner:
                out += [{"rec": "edge", "kind": "INHERITS", "line_start": n, "source": place, "target": base.strip()}
                        for base in inner[1:-1].split(",") if re.fullmatch(r"\s*[A-Za-z_][\w.]*\s*", base)]
        elif several:
            out.append({"rec": "edge", "kind": "IMPORTS_FROM", "line_start": n, "source": path, "target": several.group(1)})
            names = re.findall(r"(\w+)(?:\s+as\s+(\w+))?", several.group(2)) if not blocks else []
            out += [{"rec": "name", "kind": "IMPORT", "line_start": n, "name": b or a, "target": several.group(1)} for a, b in names]
        elif single:
            out += [{"rec": "edge", "kind": "IMPORTS_FROM", "line_start": n, "source": path, "target": item.split()[0]}
                    for item in single.group(1).split(",") if item.strip()]
        func = blocks[-1][1] if blocks and blocks[-1][1]["kind"] == "Function" else None
        if func:
            owner = f"{path}::{func['parent_name']}.{func['name']}" if func["parent_name"] else f"{path}::{func['name']}"
            out += [{"rec": "edge", "kind": "CALLS", "line_start": n, "source": owner, "target": called}
                    for called in _CALLED.findall(line, head.end() if head else 0) if not keyword.iskeyword(called)]
        depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
    return out


def _python_records(path: str, text: str) -> list[dict]:
    """Definitions, bases, imports and calls of one file (a small tree walk)."""
    import ast

    out: list[dict] = [{"rec": "node", "kind": "File", "name": path, "line_start": 1, "line_end": text.count("\n") + 1}]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        out[0]["target"] = "lines"
        return out + _records_by_indent(path, text)
    lines = text.split("\n")

    def add(rec: str, kind: str, node, **more) -> None:
        out.append({"rec": rec, "kind": kind, "line_start": node.lineno, **more})

    def place(cls: str | None, name: str) -> str:
        return f"{path}::{cls}.{name}" if cls else f"{path}::{name}"

    def parameter_text(node) -> str | None:
        """Source text of the parameter list, by balanced brackets of the header."""
        last = node.body[0].lineno
        depth, start, header = 0, None, "\n".join(lines[node.lineno - 1:last])
        skip = header.find(node.name) + len(node.name)
        quote = ""
        for i in range(skip, len(header)):
            ch = header[i]
            if quote:
                quote = "" if ch == quote and header[i - 1] != "\\" else quote
            elif ch in "\"'":
                quote = ch
            elif ch in "([{":
                if ch == "(" and start is None:
                    start = i
                depth += start is not None
            elif ch in ")]}" and start is not None:
                depth -= 1
                if depth == 0:
                    return header[start:i + 1]
        return None

    stack = [(child, None, None, True) for child in reversed(tree.body)]
    while stack:
        node, cls, func, top = stack.pop()
        inner = (cls, func, False)
        if isinstance(node, ast.ClassDef):
            add("node", "Class", node, name=node.name, line_end=node.end_lineno, parent_name=cls, top_level=top)
            for base in node.bases:
                if isinstance(base, (ast.Name, ast.Attribute)):
                    add("edge", "INHERITS", node, source=place(cls, node.name), target=ast.unparse(base))
            inner = (node.name, None, False)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(
                "node", "Function", node, name=node.name, line_end=node.end_lineno, parent_name=cls, top_level=top,
                params=parameter_text(node), decorators=[ast.unparse(d) for d in node.decorator_list] or None,
                return_type=ast.get_source_segment(text, node.returns) if node.returns else None,
            )
            inner = (cls, node.name, False)
        elif isinstance(node, ast.Import):
            for item in node.names:
                add("edge", "IMPORTS_FROM", node, source=path, target=item.name)
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            add("edge", "IMPORTS_FROM", node, source=path, target=module)
            for item in node.names if top else ():
                add("name", "IMPORT", node, name=item.asname or item.name, target=module)
        elif isinstance(node, ast.Call) and func:
            called = node.func
            label = called.id if isinstance(called, ast.Name) else called.attr if isinstance(called, ast.Attribute) else None
            if label:
                add("edge", "CALLS", node, source=place(cls, func), target=label)
        decorators = getattr(node, "decorator_list", [])
        for child in reversed(list(ast.iter_child_nodes(node))):
            stack.append((child, cls, func, False) if child in decorators else (child, *inner))
    return out


def extract_python(files: DataFrame) -> DataFrame:
    """Records of Python texts (file_path, text); the File node is always there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column("file_path").to_pylist(), batch.column("text").to_pylist()):
                rows += [{**r, "file_path": path} for r in _python_records(path, text or "")]
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("file_path", "text").mapInArrow(run, RECORDS)


def nodes_of(records: DataFrame, language) -> DataFrame:
    """Typed nodes with test flags and qualified names."""
    path, name = F.col("file_path"), F.col("name")
    test = (F.col("kind") == "Test") | ((F.col("kind") == "Function") & is_test_function(name, path, F.col("decorators")))
    kind = F.when(test, "Test").otherwise(F.col("kind"))
    return records.where(F.col("rec") == "node").select(
        kind.alias("kind"), "name",
        qualified_name(F.col("kind"), path, F.col("parent_name"), name).alias("qualified_name"),
        "file_path", "line_start", "line_end", language.alias("language"), "parent_name", "params", "return_type",
        F.when(F.col("kind") == "File", is_test_file(path)).otherwise(test).alias("is_test"),
        "decorators",
        F.when((F.col("kind") == "File") & F.col("target").isNotNull(), F.create_map(F.lit("reader"), F.col("target"))).alias("extra"),
        F.coalesce("top_level", F.lit(False)).alias("top_level"), F.col("source").alias("container"),
    )


def raw_edges(records: DataFrame) -> DataFrame:
    return records.where(F.col("rec") == "edge").select(
        "kind", "source", "target", "file_path", F.col("line_start").alias("line")
    )


def contains_edges(nodes: DataFrame) -> DataFrame:
    """File or class → symbol; a class always hangs below its file, a runner's test below its ``container``."""
    owner = F.when(F.col("container").isNotNull(), F.col("container")).when(
        (F.col("kind") != "Class") & F.coalesce(F.col("parent_name") != "", F.lit(False)),
        F.concat("file_path", F.lit("::"), "parent_name"),
    ).otherwise(F.col("file_path"))
    return nodes.where(F.col("kind") != "File").select(
        F.lit("CONTAINS").alias("kind"), owner.alias("source"), F.col("qualified_name").alias("target"),
        "file_path", F.col("line_start").alias("line"),
    )


def import_names(records: DataFrame) -> DataFrame:
    return records.where(F.col("rec") == "name").select("file_path", "name", F.col("target").alias("module")).distinct()
