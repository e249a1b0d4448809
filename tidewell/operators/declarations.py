"""K8: TypeScript and JavaScript files cut at their declarations, large classes at their methods.

A file is scanned once: strings, template texts and comments are blanked out at their length, and the depth of braces, parentheses and brackets at every place is a running
sum over what is left, so a declaration is one that begins at depth 0, a member one that begins at depth 1 of its class. Each file is cut by itself; Arrow batches of files go to Python, as no
expression of Spark's walks a text's nesting.

Regular expression literals that hold quotes or braces are taken for code; a statement without a semicolon ends with its line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters over which a class with several methods is cut.
LARGE = 3000
_HIDDEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`", re.DOTALL)
_DECLARED = re.compile(r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?P<kind>class|interface|enum|function|type|const|let|var)\b\s*\*?\s*(?P<name>[\w$]+)?")
_MEMBER = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|override|readonly|async)\s+)*)(?P<acc>(?:get|set)\s+(?=[\w$#]))?\*?\s*(?P<name>[#\w$]+)\s*(?:<[^(){}]*>)?\s*\(")
_FIELD = re.compile(r"(?:(?:public|private|protected|static|override|readonly|declare)\s+)*[#\w$]+\s*[?!]?\s*(?=[:=;])")
_IMPORT = re.compile(r"import\s+(?:[^'\";]*?from\s+)?['\"]([^'\"]+)['\"]")
_HEAD = re.compile(r"class\b\s*[\w$]*\s*(?:<[^{}]*?>)?\s*(?P<rest>(?:extends|implements)\b[^{]*)?\{")
_WORD = re.compile(r"(?<![\w$.])(?:export|default|declare|abstract|async|class|interface|enum|function|type|const|let|var)\b")
_EXPORT, _OPENED, _ENDED, _GAP = re.compile(r"export\b"), re.compile(r"[{;]"), re.compile(r"[;\n]"), re.compile(r"[ \t\r\n;]*")
_BEFORE, _AFTER, _VALUE, _INLINE = (*"=|&,+(<?:", "=>"), re.compile(r"\s*(?:[|&.?:=+]|=>)"), re.compile(r"\s*=(?!>).*$", re.DOTALL), re.compile(r"[^\n]")
#: What a character adds to the depth, by its code.
_STEPS = np.zeros(128, np.int8)
_STEPS[[ord(c) for c in "{(["]], _STEPS[[ord(c) for c in "})]"]] = 1, -1
_BODIED = ("class", "interface", "enum", "function")
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "function", "new", "constructor"}
SCHEMA = "path string, chunk int, kind string, symbols array<string>, start_line int, end_line int, content string, imports array<string>"


def blanked(text: str) -> str:
    """The text with comments as spaces, and strings and template texts as a character that no code holds; line ends stay."""

    def blank(m: re.Match) -> str:
        part = m[0]
        fill = " " if part[0] == "/" else "\x01"
        return _INLINE.sub(fill, part) if "\n" in part else fill * len(part)

    return _HIDDEN.sub(blank, text)


class _Code:
    """A text with its blanked twin and the depths before each character."""

    def __init__(self, text: str):
        self.text, self.plain = text, blanked(text)
        codes = np.frombuffer(self.plain.encode("utf-32-le"), np.uint32)
        step = np.zeros(len(codes) + 1, np.int32)
        step[1:] = _STEPS[np.minimum(codes, 127)]
        self.depth = np.cumsum(step)
        self.breaks = np.flatnonzero(codes == 10)

    def line(self, at: int) -> int:
        return int(np.searchsorted(self.breaks, at)) + 1

    def close(self, at: int) -> int:
        """The place after the bracket that closes the one at ``at``."""
        low, size, depth = at + 1, 256, self.depth[at]
        while low < len(self.depth):  # parts of twice the length each, so that a short body costs little in a long text
            back = self.depth[low : low + size] <= depth
            first = int(back.argmax())
            if back[first]:
                return low + first
            low, size = low + size, 2 * size
        return len(self.text)

    def body(self, at: int, high: int) -> int | None:
        """The brace that opens a declaration's body, at its own depth; None if a semicolon comes first."""
        for m in _OPENED.finditer(self.plain, at, high):
            if self.depth[m.start()] == self.depth[at]:
                return m.start() if m[0] == "{" else None
        return None

    def statement(self, at: int) -> int:
        """The end of a statement that begins at ``at``: its semicolon, or a line end at its depth after which nothing goes on."""
        for m in _ENDED.finditer(self.plain, at):
            if self.depth[m.start()] == self.depth[at]:
                if m[0] == ";":
                    return m.end()
                if not self.plain[at : m.start()].rstrip().endswith(_BEFORE) and not _AFTER.match(self.plain, m.end()):
                    return m.start()
        return len(self.text)

    def full_start(self, at: int, low: int) -> int:
        """Where the white space and comments in front of ``at`` begin: after the last code before it."""
        return max(low, low + len(self.plain[low:at].rstrip()))


def _members(code: _Code, low: int, high: int) -> tuple[list[tuple], list[str]]:
    """(name, signature, start, end) of a class body's methods, and its fields' declarations."""
    methods, fields, at, depth = [], [], low, code.depth[low]
    while at < high:
        at = _GAP.match(code.plain, at, high).end()
        if at >= high:
            break
        m = _MEMBER.match(code.plain, at, high)
        if m and m["name"] not in _KEYWORDS - {"constructor"}:
            close = code.close(m.end() - 1)
            brace = code.body(close, high)
            end = code.close(brace) if brace is not None else code.statement(at)
            if m["name"] != "constructor" and not m["acc"]:
                methods.append((m["name"], " ".join(code.text[at : brace if brace is not None else end].split()).rstrip(";"), at, end))
            at = end
            continue
        f = _FIELD.match(code.plain, at, high)
        end = code.statement(at)
        if f:
            fields.append(_VALUE.sub("", code.text[at:end].rstrip().rstrip(";")))
        at = max(end, at + 1) if code.depth[min(end, high)] == depth else high
    return methods, fields


def cut_file(text: str, large: int = LARGE) -> list[tuple]:
    """(kind, symbols, start line, end line, content) of a file's declarations, in order; see declarations()."""
    code, out, at, last = _Code(text), [], 0, 0
    while (w := _WORD.search(code.plain, at)) is not None:
        start = w.start()
        m = _DECLARED.match(code.plain, start)
        if code.depth[start] or m is None:
            at = w.end()
            continue
        kind, name = m["kind"], m["name"] or "anonymous"
        brace = code.body(m.end(), len(text)) if kind in _BODIED else None
        end = code.close(brace) if brace is not None else code.statement(start)
        whole = text[code.full_start(start, last) : end]
        lines = (code.line(start), code.line(max(start, end - 1)))
        if kind == "class" and brace is not None:
            methods, fields = _members(code, brace + 1, end - 1)
            names = [x[0] for x in methods]
            if len(whole) > large and len(methods) > 1:
                head = _HEAD.search(code.plain, start, brace + 1)
                rest = " ".join(code.text[head.start("rest") : head.end("rest")].split()) if head and head["rest"] else ""
                lead = ("export " if _EXPORT.match(code.plain, start) else "") + f"class {name}" + (f" {rest}" if rest else "") + " {"
                summary = [lead, *[f"  {x};" for x in fields], *([""] if fields else []), *[f"  {x[1]};" for x in methods], "}"]
                out.append(("class-summary", [name, *names], *lines, "\n".join(summary)))
                for method, _, a, b in methods:
                    out.append(("method", [f"{name}.{method}"], code.line(a), code.line(b - 1), text[code.full_start(a, brace + 1) : b]))
            else:
                out.append(("class", [name, *names], *lines, whole))
        elif kind in ("const", "let", "var"):
            value = code.text[start:end].partition("=")[2].strip()
            if value and ("=>" in value or "function" in value or len(value) > 100):
                out.append(("variable", [name], *lines, whole))
        else:
            out.append((kind, [name], *lines, whole))
        at = last = max(end, w.end())
    return out


def declarations(files: DataFrame, large: int = LARGE) -> DataFrame:
    """K8: chunks of files (path, content): classes, functions, interfaces, types, enums, and variables that hold a function or over 100 characters.

    A class of over ``large`` characters with several methods is a summary (its head, fields and signatures) and a chunk for each method. Contents begin with the comments in front.
    The first chunk has the file's imports. A null or empty text, or one without declarations, gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, chunk in enumerate(cut_file(text or "", large)):
                    rows.append((path, n, *chunk, list(dict.fromkeys(_IMPORT.findall(text))) if n == 0 else None))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, SCHEMA)
