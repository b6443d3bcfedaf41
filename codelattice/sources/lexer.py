"""Which characters of a file are code: one pass over each text, in Arrow batches.

A machine with the states code, line comment, block comment (nested where the
language nests them), string and template goes through the text from token to
token; templates keep a stack, so code inside ``${}`` counts as code and may hold
templates again. Both results keep every offset and line break of the text:
``text`` has blanks for comments, ``code`` also for what stands in strings.
A string over several lines shows its first line only in ``text``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from codelattice import schema as S

LINES = "file_path string, group string, language string, line int, text string, code string, calls array<struct<name:string,last:int,column:int,around:string>>"
_CALL = pa.struct([("name", pa.string()), ("last", pa.int32()), ("column", pa.int32()), ("around", pa.string())])
_ARROW = pa.schema([
    ("file_path", pa.string()), ("group", pa.string()), ("language", pa.string()), ("line", pa.int32()),
    ("text", pa.string()), ("code", pa.string()), ("calls", pa.list_(_CALL)),
])
# A result batch ends at so many lines or characters.
BATCH_LINES, BATCH_CHARS = 20_000, 8_000_000

_SLASHED = {"script", "c_like", "go", "rust"}
_NESTED = {"rust", "kotlin", "swift", "scala", "dart"}
_TRIPLE = {"python", "java", "kotlin", "scala", "swift", "csharp", "dart"}
# A single quote starts a string here; elsewhere it marks a character or a lifetime.
_QUOTING = {"php", "dart", "python", "r", "perl", "ruby", "lua"}
_OVER_LINES = {"php", "r"}
_CHARACTER = re.compile(r"'(?:\\(?:u\{?[0-9A-Fa-f]+\}?|x[0-9A-Fa-f]+|[0-7]{1,3}|.)|[^'\\\n])'")
_REGEX = re.compile(r"/(?!>)(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[=(,:\[!&|?{;+\-*%~^\n]|\b(?:return|typeof|case|in|of|do|else|yield|await|throw|void|delete))\s*$")
_FRAGMENT = re.compile(r"[^`\\$]*(?:(?:\\[\s\S]|\$(?!\{))[^`\\$]*)*")


def _blank(piece: str) -> str:
    return "\n".join([" " * len(line) for line in piece.split("\n")])


def _body(quote: str, over_lines: bool) -> re.Pattern:
    plain = rf"[^{quote}\\]*" if over_lines else rf"[^{quote}\\\n]*"
    return re.compile(rf"{plain}(?:\\[\s\S]{plain})*")


@lru_cache(maxsize=None)
def _tokens(language: str, group: str) -> re.Pattern:
    """What may change the state while in code, longest first."""
    parts = []
    if group == "lua":
        parts += [r"--\[=*\[", r"--", r"\[=*\["]
    if group == "ruby":
        parts += [r"^=begin\b"]
    if group == "perl":
        parts += [r"^=[a-z]\w*", r"(?<![$\w])#"]
    if group in ("python", "r"):
        parts += ["#"]
    if group == "ruby":
        parts += [r"#(?!\{)"]
    if group in ("c_like", "rust"):
        parts += [r"^[ \t]*#(?!include|\[)"] if language != "php" else [r"#(?!\[)"]
    if group in _SLASHED:
        parts += ["//", r"/\*"]
    if language in _TRIPLE:
        parts += ['"""'] + (["'''"] if language in ("python", "dart") else [])
    parts += ['"', "'"]
    if group in ("script", "go"):
        parts += ["`"]
    if group == "script":
        parts += ["/", r"[{}]"]
    return re.compile("|".join(parts), re.M)


def mask(source: str, language: str, group: str) -> tuple[str, str]:
    """(text, code) of one file, both as long as the source."""
    tokens, size, i = _tokens(language, group), len(source), 0
    text: list[str] = []
    code: list[str] = []
    depths: list[int] = []  # open braces in each template expression

    def keep(piece: str) -> None:
        text.append(piece)
        code.append(piece)

    def hide(end: int) -> int:
        keep(_blank(source[start:end]))
        return end

    def quoted(begin: int, end: int, stop: int) -> int:
        """A string from ``start`` to ``stop`` with its content in begin..end."""
        whole = source[start:stop]
        cut = whole.find("\n")
        text.append(whole if cut < 0 else whole[:cut] + _blank(whole[cut:]))
        code.append(source[start:begin] + _blank(source[begin:end]) + source[end:stop])
        return stop

    def fragment(begin: int) -> int:
        """The rest of a template, up to its end or its next expression."""
        end = _FRAGMENT.match(source, begin).end()
        if source.startswith("${", end):
            depths.append(0)
            quoted(begin, end, end)
            text.append("${")
            code.append("  ")
            return end + 2
        return quoted(begin, end, min(size, end + 1))

    while i < size:
        found = tokens.search(source, i)
        if not found:
            keep(source[i:])
            break
        start, token = found.start(), found.group()
        keep(source[i:start])
        i = found.end()
        if token in "{}":
            if depths and token == "}" and depths[-1] == 0:
                depths.pop()
                text.append(token)
                code.append(" ")
                start = i
                i = fragment(i)
            else:
                if depths:
                    depths[-1] += 1 if token == "{" else -1
                keep(token)
        elif token == "/*":
            depth, end = 1, i
            while depth:
                close = source.find("*/", end)
                again = source.find("/*", end, close) if close >= 0 and language in _NESTED else -1
                if close < 0:
                    end, depth = size, 0
                elif again >= 0:
                    end, depth = again + 2, depth + 1
                else:
                    end, depth = close + 2, depth - 1
            i = hide(end)
        elif token.endswith("[") and token[0] in "-[":
            close = source.find("]" + "=" * token.count("=") + "]", i)
            stop = size if close < 0 else close + 2 + token.count("=")
            i = hide(stop) if token[0] == "-" else quoted(i, stop if close < 0 else close, stop)
        elif token.startswith("="):
            last = re.compile(r"^=(?:end|cut)\b[^\n]*", re.M).search(source, i)
            i = hide(last.end() if last else size)
        elif token == "//" or token == "--" or token.endswith("#"):
            end = source.find("\n", i)
            i = hide(size if end < 0 else end)
        elif token == "/":
            literal = _BEFORE_REGEX.search(source[max(0, start - 80):start]) and _REGEX.match(source, start)
            if literal:
                i = quoted(i, source.rfind(token, i, literal.end()), literal.end())
            else:
                keep(token)
        elif token == "`" and group == "script":
            keep(token)
            start = i
            i = fragment(i)
        elif token == "`":
            close = source.find("`", i)
            i = quoted(i, size if close < 0 else close, size if close < 0 else close + 1)
        elif len(token) == 3:
            close = source.find(token, i)
            i = quoted(i, size if close < 0 else close, size if close < 0 else close + 3)
        elif token == "'" and group in ("c_like", "go", "rust") and language not in _QUOTING:
            one = _CHARACTER.match(source, start)
            if one:
                i = quoted(i, one.end() - 1, one.end())
            else:
                keep(token)
        else:
            end = _body(token, language in _OVER_LINES).match(source, i).end()
            i = quoted(i, end, end + 1 if source.startswith(token, end) else end)
    return "".join(text), "".join(code)


MODIFIERS = ("only", "skip", "each", "todo", "concurrent", "failing")
_RUNNER = re.compile(rf"(?<![\w$.])({'|'.join(S.TEST_RUNNER_NAMES)})(?:\.(?:{'|'.join(MODIFIERS)}))*\s*(?=[(`])")
_TEST_PATH = re.compile("|".join(S.TEST_FILE_PATTERNS))
_DECLARED = re.compile(r"\bfunction\s*\*?\s*$")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def brackets(code: str) -> dict[int, int]:
    """Where each bracket closes; brackets without a partner are left out."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for hit in re.finditer(r"[()\[\]{}]", code):
        at, sign = hit.start(), hit.group()
        if sign not in _PAIRS:
            stack.append(at)
        elif stack and code[stack[-1]] == _PAIRS[sign]:
            out[stack.pop()] = at
        elif any(code[p] == _PAIRS[sign] for p in stack[-8:]):
            while code[stack[-1]] != _PAIRS[sign]:
                stack.pop()
            out[stack.pop()] = at
    return out


def _described(source: str, code: str, opened: int) -> str | None:
    """The string that a call starts with, white space reduced."""
    first = re.compile(r"""\s*(["'`])""").match(code, opened + 1)
    if not first:
        return None
    close = code.find(first.group(1), first.end())
    inner = source[first.end():close if close >= 0 else len(source)]
    return re.sub(r"\s+", " ", inner).strip()


def runner_calls(source: str, code: str) -> list[tuple[str, int, int, int]]:
    """Calls of test runners: (name, first offset, last offset, column).

    ``it.each(rows)("name", body)`` reaches to the end of its last bracket and is named by it.
    """
    closes = brackets(code)
    out = []
    for hit in _RUNNER.finditer(code):
        at, end, described = hit.end(), hit.end(), None
        while code[at:at + 1] in ("(", "`"):
            end = closes.get(at, len(code) - 1) if code[at] == "(" else max(at, code.find("`", at + 1))
            described = _described(source, code, at) if code[at] == "(" else described
            at = end + 1
        declared = _DECLARED.search(code[max(0, hit.start() - 40):hit.start()]) or re.compile(r"\s*\{").match(code, end + 1)
        if declared or (code[hit.end()] == "`" and described is None):
            continue
        name = hit.group(1) if not described else f"{hit.group(1)}:{described}"
        out.append((name, hit.start(), end, hit.start() - code.rfind("\n", 0, hit.start()) - 1))
    return out


def code_lines(files: DataFrame) -> DataFrame:
    """Lines of (file_path, group, language, text) with ``text``, ``code`` and the runner calls that start there.

    Null texts are empty; a text has at least one line. Lines of blanks alone hold nothing to find and are left
    out, but for the last, whose number is the length of the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path, group, language, source in zip(*(batch.column(c).to_pylist() for c in ("file_path", "group", "language", "text"))):
                source = (source or "").replace("\r\n", "\n").replace("\r", "\n")
                text, code = mask(source, language, group)
                calls: dict[int, list] = {}
                if group == "script" and language != "vue" and _TEST_PATH.search(path):
                    breaks, open_calls = [b.start() for b in re.finditer("\n", code)], []
                    for name, first, last, column in runner_calls(source, code):
                        line = bisect_left(breaks, first) + 1
                        while open_calls and open_calls[-1][0] < first:
                            open_calls.pop()
                        around = open_calls[-1][2] if open_calls and open_calls[-1][1] == line else None
                        open_calls.append((last, line, f"{name}@L{line}"))
                        calls.setdefault(line, []).append(
                            {"name": f"{name}@L{line}", "last": bisect_left(breaks, last) + 1, "column": column, "around": around}
                        )
                last_line = text.count("\n") + 1
                for n, (shown, kept) in enumerate(zip(text.split("\n"), code.split("\n")), 1):
                    if n < last_line and n not in calls and not shown.strip() and not kept.strip():
                        continue
                    rows.append((path, group, language, n, shown, kept, calls.get(n)))
                    size += len(shown) + len(kept)
                    if len(rows) >= BATCH_LINES or size >= BATCH_CHARS:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    return files.select("file_path", "group", "language", "text").mapInArrow(run, LINES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(zip(*rows), _ARROW)], schema=_ARROW
    )
