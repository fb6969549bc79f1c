"""Program analysis: tests, imports, calls, fixtures, annotations, mocks and bodies from source text.

What a regular expression can find is found by built-in functions; Python sources are parsed with the standard
library's ast, and bodies are cut by a scanner, both over Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import extract as E

CALL = r"(\w+)\.(\w+)\s*\("
DECORATOR = r"@([\w.]+)"
MOCK = r"(?:jest|vi)\.(mock|spyOn|fn)\("
REFLECTION = r"Class\.forName\(\"([\w.]+)\"\)"
INJECTED = r"@(Autowired|Inject|Mock|InjectMocks)\s+(?:private\s+)?\w+\s+\w+"
ASYNC = r"async\s+(?:def|function|\()|await\s"


def tests(sources: DataFrame) -> DataFrame:
    """file_id, ordinal (from 0), test_name."""
    return E.declared_tests(sources).drop("language")


def imports(sources: DataFrame) -> DataFrame:
    """file_id, module, production."""
    rows = E.declared_imports(sources).distinct()
    return rows.select("file_id", "module", E.is_production(F.col("module"), F.col("language")).alias("production"))


def calls(sources: DataFrame) -> DataFrame:
    """file_id, object, function."""
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(CALL), 1).alias("object"), F.regexp_extract_all("body", F.lit(CALL), 2).alias("function"))
    return sources.select("file_id", F.explode(pairs).alias("c")).select("file_id", "c.object", "c.function").distinct()


def flags(sources: DataFrame) -> DataFrame:
    """file_id with counts of decorators or annotations, mocks, reflection, injected fields, and whether it is async."""
    n = lambda rx: F.regexp_count("body", F.lit(rx)).cast("long")
    return sources.select("file_id", n(DECORATOR).alias("n_decorators"), n(MOCK).alias("n_mocks"), n(REFLECTION).alias("n_reflection"), n(INJECTED).alias("n_injected"), F.col("body").rlike(ASYNC).alias("is_async"))


def parse_python(body: str) -> list[tuple[str, str, int, str]]:
    """(name, kind, line, description) of classes, functions and fixtures; nothing of a source that doesn't parse."""
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.ClassDef):
            out.append((node.name, "class", node.lineno, ast.get_docstring(node) or ""))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            fixture = any("fixture" in ast.unparse(d) for d in node.decorator_list)
            kind = "fixture" if fixture else "test" if node.name.startswith("test_") else "function"
            out.append((node.name, kind, node.lineno, ast.get_docstring(node) or ""))
    return sorted(out, key=lambda x: (x[2], x[0]))


def declared(body: str, language: str) -> list[re.Match]:
    """Declarations of tests by a language's patterns, each name once, in order of their places."""
    every = [m for p in E.TESTS.get(language, ()) for m in re.finditer(p, body)]
    first = {m.group(1): m for m in sorted(every, key=lambda m: m.end(), reverse=True)}
    return sorted(first.values(), key=lambda m: m.end())


def cut_body(body: str, start: int) -> str:
    """From a declaration to the end of its braces, or of its indented block."""
    end = body.find("\n", start)
    head = body[start : end if end >= 0 else len(body)]
    if head.rstrip().endswith(":"):
        lines = body[start:].split("\n")
        first = body[body.rfind("\n", 0, start) + 1 :]
        indent = len(first) - len(first.lstrip(" \t"))
        kept = [lines[0]]
        for line in lines[1:]:
            if line.strip() and len(line) - len(line.lstrip()) <= indent:
                break
            kept.append(line)
        return "\n".join(kept).rstrip()
    depth = 0
    for m in _BRACES.finditer(body, start):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth == 0:
                return body[start : m.end()]
    return body[start:]


#: Braces, and strings, whose braces don't count (an open string goes on to the end).
_BRACES = re.compile(r"""[{}]|'(?:\\.|[^'\\])*'?|"(?:\\.|[^"\\])*"?|`(?:\\.|[^`\\])*`?""", re.DOTALL)


def _rows(cols: list[str], types: list[pa.DataType], found: list[tuple]) -> pa.RecordBatch:
    values = list(zip(*found, strict=True)) or [()] * len(cols)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=cols)


def parse_sources(sources: DataFrame) -> DataFrame:
    """file_id, name, kind, line, description: by ast for Python, by pattern for the rest."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for f, lang, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body = body or ""
                got = parse_python(body) if lang == "python" else []
                if not got:
                    got = [(m.group(1), "test", body.count("\n", 0, m.end()) + 1, "") for m in declared(body, lang)]
                rows += [(f, *g) for g in got]
            yield _rows(["file_id", "name", "kind", "line", "description"], [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()], rows)

    return sources.select("file_id", "language", "body").mapInArrow(run, "file_id long, name string, kind string, line long, description string")


def bodies(sources: DataFrame) -> DataFrame:
    """file_id, test_name, body_text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for f, lang, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows += [(f, m.group(1), cut_body(body, m.end() - len(m.group().lstrip()))) for m in declared(body or "", lang)]
            yield _rows(["file_id", "test_name", "body_text"], [pa.int64(), pa.string(), pa.string()], rows)

    return sources.select("file_id", "language", "body").mapInArrow(run, "file_id long, test_name string, body_text string")


_METHOD = re.compile(r"(?:\bdef\s+(\w+)|\bfunction\s+(\w+)|(?:public|private|protected|static)[\w<>\[\] ]*?\s(\w+)\s*\(|^\s*(\w+)\s*\([^)]*\)\s*\{|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>)")
_CLASS = re.compile(r"\b(?:class|interface|enum)\s+(\w+)")
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else"}


def with_headers(text: str, files: list[str]) -> str:
    """A diff of bare hunks with a header before each file's share: hunks are dealt evenly in order, the rest to the last
    file; with fewer hunks than files all go to the first."""
    lines = text.split("\n")
    at = [i for i, line in enumerate(lines) if re.match(r"@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@", line)]
    share = len(at) // len(files)
    starts = {0: [files[0]]} if share else {0: files[:1], len(lines): files[1:]}
    for i, f in enumerate(files[1:] if share else [], 1):
        starts.setdefault(at[i * share], []).append(f)
    out = []
    for i in range(len(lines) + 1):
        for f in starts.get(i, []):
            out.append(f"diff --git a/{f} b/{f}")
        out += lines[i : i + 1]
    return "\n".join(out)


def parse_diff(text: str, files: list[str] | None = None) -> list[dict]:
    """One entry for each file: file, status, additions, deletions, changed_lines (new numbers for +, old for -), classes, methods.

    files names the files of a diff that has hunks without headers; their lines have no numbers.

    A hunk header's context names the method unless a changed or context line of the hunk names another one first;
    it is dropped where a hunk only adds other methods.
    """
    files = [f for f in files or [] if f.strip()]
    bare = bool(files) and "@@" in text[:100] and not text.strip().startswith(("diff --git", "--- "))
    if bare:
        text = with_headers(text, files)
    out: list[dict] = []
    at: dict | None = None
    context, named, deleted = "", [], False

    def method(line: str) -> str:
        m = _METHOD.search(line)
        name = next((g for g in m.groups() if g), "") if m else ""
        return "" if name in _NOT_NAMES else name

    def close() -> None:
        if at is not None:
            if context and not named and (deleted or at["touched"]):
                at["methods"].append(context)
            at["methods"] += named

    for line in text.split("\n"):
        header = re.match(r"diff --git a/(\S+) b/(\S+)", line)
        pair = re.match(r"\+\+\+ (?:b/)?(\S+)", line)
        if header or (pair and (at is None or at["hunks"])):
            close()
            context, named, deleted = "", [], False
            at = {"file": header.group(2) if header else pair.group(1), "status": "modified", "additions": 0, "deletions": 0, "changed_lines": [], "classes": [], "methods": [], "hunks": 0, "touched": False}
            out.append(at)
        elif at is None or line.startswith(("---", "+++")):
            continue
        elif line.startswith(("new file", "deleted file")):
            at["status"] = "added" if line.startswith("new") else "deleted"
        elif hunk := re.match(r"@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@ ?(.*)", line):
            close()
            old, new = int(hunk.group(1)), int(hunk.group(2))
            context, named, deleted = method(hunk.group(3)), [], False
            at["hunks"] += 1
            at["touched"] = False
        elif not at["hunks"]:
            continue
        elif line[:1] in ("+", "-"):
            plus = line[0] == "+"
            at["additions" if plus else "deletions"] += 1
            if not bare:
                at["changed_lines"].append(new if plus else old)
            deleted |= not plus
            at["classes"] += _CLASS.findall(line[1:])
            if name := method(line[1:]):
                named.append(name)
            else:
                at["touched"] = True
            old, new = old + (not plus), new + plus
        else:
            if name := method(line[1:]):
                context = name
            old, new = old + 1, new + 1
    close()
    for x in out:
        x["classes"], x["methods"] = sorted(set(x["classes"])), list(dict.fromkeys(x["methods"]))
    return out


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """diffs(diff_id, body) -> a row for each file of each diff."""

    cols = ["file", "status", "additions", "deletions", "changed_lines", "classes", "methods"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = [(i, *[x[c] for c in cols]) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in parse_diff(t or "")]
            yield _rows(["diff_id", *cols], types, rows)

    return diffs.select("diff_id", "body").mapInArrow(run, "diff_id long, file string, status string, additions long, deletions long, changed_lines array<long>, classes array<string>, methods array<string>")
