"""Arguments of calls, definitions of variables and the links between them, of Python texts.

The reader walks each function once (loops until their definitions settle) and
gives rows; what flows where across functions and files is joined in Spark
(``operators/value_flow.py``).
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codelattice.sources.code import BATCH_ROWS

FLOWS = (
    "rec string, id string, func string, file_path string, line int, name string, position int, keyword string, "
    "shape string, concatenated boolean, parameterised boolean, through array<string>"
)
_ARROW = pa.schema([
    ("rec", pa.string()), ("id", pa.string()), ("func", pa.string()), ("file_path", pa.string()), ("line", pa.int32()),
    ("name", pa.string()), ("position", pa.int32()), ("keyword", pa.string()), ("shape", pa.string()),
    ("concatenated", pa.bool_()), ("parameterised", pa.bool_()), ("through", pa.list_(pa.string())),
])
_SHAPES = {ast.Tuple: "tuple", ast.List: "list", ast.Dict: "dict", ast.Name: "identifier", ast.Call: "call",
           ast.Attribute: "attribute", ast.Subscript: "subscript"}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> str:
    """``a.b.c`` of a chain of names; a chain that starts elsewhere keeps its attributes."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts))


def _shape(node: ast.AST) -> tuple[str, bool]:
    """Kind of an expression, and whether it puts values into a text."""
    if isinstance(node, ast.JoinedStr):
        filled = any(isinstance(v, ast.FormattedValue) for v in node.values)
        return ("f_string", True) if filled else ("string_literal", False)
    if isinstance(node, ast.Constant):
        return ("string_literal" if isinstance(node.value, str) else "literal"), False
    if isinstance(node, ast.BinOp):
        text = isinstance(node.left, ast.JoinedStr) or (isinstance(node.left, ast.Constant) and isinstance(node.left.value, str))
        if isinstance(node.op, ast.Mod) and text:
            return "percent_format", True
        varies = any(isinstance(n, (ast.Name, ast.Call, ast.Attribute)) for n in ast.walk(node))
        return "binary_op", isinstance(node.op, ast.Add) and varies
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
        return "format_call", True
    return _SHAPES.get(type(node), "other"), False


def _merge(*states: dict | None) -> dict | None:
    live = [s for s in states if s is not None]
    if not live:
        return None
    return {name: frozenset().union(*(s.get(name, frozenset()) for s in live)) for s in live for name in s}


class _Function:
    """Definitions that reach each use of one function; a state maps names to definitions, None is dead code."""

    def __init__(self, path: str, func: str, rows: dict):
        self.path, self.func, self.rows = path, func, rows
        self.loops: list[tuple[list, list]] = []

    def note(self, rec: str, node: ast.AST, tag: str, **more) -> str:
        ident = f"{self.func}@{node.lineno}:{node.col_offset}:{tag}"
        self.rows[rec, ident] = {"rec": rec, "id": ident, "func": self.func, "file_path": self.path, "line": node.lineno, **more}
        return ident

    def feed(self, ident: str, node: ast.AST | None, state: dict, through: tuple[str, ...] = ()) -> None:
        """Links from all that ``node`` reads; ``through`` are the calls around it."""
        if node is None or isinstance(node, _FUNCTIONS):
            return
        if isinstance(node, ast.Name):
            for source in state.get(node.id, ()):
                self.join("link", ident, source, through)
        elif isinstance(node, ast.Call):
            called = _dotted(node.func)
            self.join("origin", ident, called, through)
            for part in [getattr(node.func, "value", None), *node.args, *(k.value for k in node.keywords)]:
                self.feed(ident, part, state, (*through, called))
        else:
            if isinstance(node, ast.Attribute):
                self.join("origin", ident, _dotted(node), through)
            for part in ast.iter_child_nodes(node):
                self.feed(ident, part, state, through)

    def join(self, rec: str, ident: str, name: str, through: tuple[str, ...]) -> None:
        self.rows[rec, ident, name, through] = {
            "rec": rec, "id": ident, "func": self.func, "file_path": self.path, "name": name, "through": list(through)}

    def define(self, target: ast.AST, value: ast.AST | None, state: dict, before: dict | None = None) -> None:
        """``state`` gets the new definition; the value is read in ``before``, if that is another state."""
        before, weak = dict(state) if before is None else before, False
        if isinstance(target, (ast.Tuple, ast.List)):
            for part in target.elts:
                self.define(part, value, state, before)
            return
        if isinstance(target, ast.Starred):
            target = target.value
        while isinstance(target, (ast.Attribute, ast.Subscript)):  # part of a value: the rest stays as it was
            target, weak = target.value, True
        if not isinstance(target, ast.Name):
            return
        shape, joined = _shape(value) if value is not None else ("other", False)
        ident = self.note("def", target, target.id, name=target.id, shape=shape, concatenated=joined)
        self.feed(ident, value, before)
        state[target.id] = frozenset([ident]) | (state.get(target.id, frozenset()) if weak else frozenset())

    def read(self, node: ast.AST | None, state: dict) -> None:
        """Argument rows of every call in an expression, and names it binds."""
        for part in ast.walk(node) if node is not None else ():
            if isinstance(part, ast.NamedExpr):
                self.define(part.target, part.value, state)
            elif isinstance(part, ast.Call):
                given = [(i, None, a) for i, a in enumerate(part.args)] + [(None, k.arg, k.value) for k in part.keywords]
                for position, word, value in given:
                    shape, joined = _shape(value)
                    ident = self.note(
                        "arg", part, f"{part.end_lineno}:{part.end_col_offset}:{word or position}", name=_dotted(part.func), position=position,
                        keyword=word, shape=shape, concatenated=joined,
                        parameterised=bool(position) and shape in ("tuple", "list", "dict"))
                    self.feed(ident, value, state)

    def block(self, body: list, state: dict | None, passed: list | None = None) -> dict | None:
        for node in body:
            if state is None:
                return None
            state = self.step(node, dict(state))
            if passed is not None:
                passed.append(state)
        return state

    def loop(self, node, state: dict) -> dict | None:
        while True:
            here = dict(state)
            if isinstance(node, ast.While):
                self.read(node.test, here)
            else:
                self.read(node.iter, here)
                self.define(node.target, node.iter, here)
            self.loops.append(([], []))
            end = self.block(node.body, here)
            left, again = self.loops.pop()
            merged = _merge(state, here, end, *again)
            if merged == state:
                return _merge(self.block(node.orelse, state), *left)
            state = merged

    def step(self, node: ast.AST, state: dict) -> dict | None:
        if isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            return state
        if isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            return self.loop(node, state)
        if isinstance(node, ast.If):
            self.read(node.test, state)
            return _merge(self.block(node.body, state), self.block(node.orelse, state))
        if isinstance(node, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            passed: list = [state]
            end = self.block(node.body, state, passed)
            ends = [self.block(node.orelse, end)]
            ends += [self.block(h.body, _merge(*passed)) for h in node.handlers]
            return self.block(node.finalbody, _merge(*ends))
        if isinstance(node, ast.Match):
            self.read(node.subject, state)
            return _merge(state, *(self.block(case.body, state) for case in node.cases))
        if isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                self.read(item.context_expr, state)
                if item.optional_vars is not None:
                    self.define(item.optional_vars, item.context_expr, state)
            return self.block(node.body, state)
        self.read(node, state)
        if isinstance(node, ast.Assign):
            before = dict(state)
            for target in node.targets:
                self.define(target, node.value, state, before)
        elif isinstance(node, ast.AnnAssign) and node.value is not None:
            self.define(node.target, node.value, state)
        elif isinstance(node, ast.AugAssign):
            self.define(node.target, ast.BinOp(node.target, node.op, node.value), state)
        elif isinstance(node, ast.Return):
            if node.value is not None:
                shape, joined = _shape(node.value)
                self.feed(self.note("return", node, "return", shape=shape, concatenated=joined), node.value, state)
            return None
        elif isinstance(node, ast.Raise):
            return None
        elif isinstance(node, (ast.Break, ast.Continue)) and self.loops:
            self.loops[-1][isinstance(node, ast.Continue)].append(state)
            return None
        return state

    def run(self, node, method: bool) -> None:
        state: dict = {}
        if isinstance(node, _FUNCTIONS):
            spec = node.args
            named = [*spec.posonlyargs, *spec.args]
            skip = 1 if method and named and named[0].arg in ("self", "cls") else 0
            placed = [(i, a) for i, a in enumerate(named[skip:])]
            for position, a in [*placed, *((None, a) for a in [*spec.kwonlyargs, spec.vararg, spec.kwarg] if a)]:
                ident = self.note("def", a, a.arg, name=a.arg, position=position, keyword=a.arg, shape="parameter", concatenated=False)
                state[a.arg] = frozenset([ident])
        self.block(node.body, state)


def _flow_rows(path: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    rows: dict = {}
    stack: list[tuple[ast.AST, str | None]] = [(tree, None)]
    while stack:
        node, cls = stack.pop()
        if isinstance(node, (ast.Module, *_FUNCTIONS)):
            name = path if isinstance(node, ast.Module) else f"{path}::{cls}.{node.name}" if cls else f"{path}::{node.name}"
            _Function(path, name, rows).run(node, cls is not None)
        inner = node.name if isinstance(node, ast.ClassDef) else None if isinstance(node, _FUNCTIONS) else cls
        stack += [(child, inner) for child in ast.iter_child_nodes(node)]
    return list(rows.values())


def extract_flows(files: DataFrame) -> DataFrame:
    """Rows of Python texts (file_path, text): arguments, definitions, returns, links, origins.

    ``arg`` and ``def`` rows carry the shape of their value; a ``link`` row says
    that the definition ``name`` may be read by the row ``id``, an ``origin`` row
    that the call or attribute ``name`` is, each with the calls in between. A text
    that does not parse, is null or empty has no rows; names of an outer function are not followed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column("file_path").to_pylist(), batch.column("text").to_pylist()):
                rows += _flow_rows(path, text or "")
                if len(rows) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("file_path", "text").mapInArrow(run, FLOWS)
