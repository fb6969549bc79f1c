"""One change, as stated by its diff: what it touches, and the terms by which an index is searched for it.

A diff is a small, stated thing; everything here is plain Python on the driver. What comes out of it, a Bundle, is a
handful of terms for the set-based lookups.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import PurePosixPath

from ..functions.text import TEST_NAMES
from .programs import parse_diff

# Extensions of production files, of files with a module name, of code in a co-change.
PRODUCTION = (".py", ".java", ".js", ".ts", ".jsx", ".tsx", ".kt", ".go", ".rb", ".cs")
WITH_MODULE = (".py", ".js", ".jsx", ".java", ".ts", ".tsx")
CODE = (".js", ".ts", ".tsx", ".jsx", ".java", ".py", ".go", ".c", ".cpp", ".h", ".hpp")
SOURCE = (".py", ".java", ".js", ".ts", ".tsx", ".jsx", ".c", ".cpp", ".cc", ".h", ".hpp", ".go", ".rb", ".cs", ".kt")
# Parts of paths that hold no production code.
SKIPPED = ("mlartifacts", "artifacts", "data/", "chromadb_data", "node_modules", "__pycache__", ".git", "venv", "env", "static", "templates", "build", "dist", "target", "bin", "obj")
# Folder names that are too general to search for.
GENERIC_FOLDERS = (
    "reducer", "reducers", "actions", "action",
    "store", "stores", "state",
    "service", "services",
    "hooks", "hook", "context", "contexts",
    "middleware", "middlewares",
    "saga", "sagas", "epic", "epics", "selectors", "selector",
    "components", "containers", "controllers", "models", "routes", "views", "pages",
)
# What a line of a diff declares, in the order in which it is looked for; and a property or call.
_NAME = r"([A-Za-z_][A-Za-z0-9_]*)"
DECLARATIONS = (
    rf"[+-]\s*export\s+const\s+{_NAME}",
    rf"[+-]\s*export\s+function\s+{_NAME}",
    rf"[+-]\s*export\s+(?:let|var)\s+{_NAME}",
    rf"[+-]\s*export\s*\{{\s*{_NAME}",
    rf"[+-]\s*class\s+{_NAME}",
    rf"[+-]\s*def\s+{_NAME}",
    rf"[+-]\s*function\s+{_NAME}",
)
PROPERTY = rf"^[+-]\s*{_NAME}\s*[:\(]"
# Added lines that declare something in a new file.
DEFINED = {".py": r"^\+.*def\s+(\w+)", ".java": r"^\+.*(?:public|private|protected)?\s*\w*\s*(\w+)\s*\("}
# Words that stand before the name of a class or a function, whatever the language.
NAMED = tuple(rf"{word}[\s\x0B]+(\w+)" for word in ("def", "function", "class"))
_TEST_PATH = re.compile(r"(\.test\.|\.spec\.|/__tests__/|/tests?/|test_repository[/\\]|\.feature\.test\.)", re.IGNORECASE)
#: Below this line number, changes without symbols are taken for changed imports.
IMPORT_LINES = 50


def with_status(rows: list[dict]) -> dict:
    """One diff of the rows that a hosting service gives: {new_path, old_path, status, diff, added_lines, removed_lines}.

    -> diff (with a header for each file, made from its status), changed_files, additions, deletions. Lines are counted
    where the rows don't say how many there are.
    """
    parts, files = [], []
    for r in rows:
        new, old = r.get("new_path") or r.get("old_path") or "", r.get("old_path") or r.get("new_path") or ""
        files += [new] if new else []
        if not r.get("diff"):
            continue
        status = r.get("status") or "modified"
        mode = {"added": ["new file mode 100644"], "removed": ["deleted file mode 100644"], "deleted": ["deleted file mode 100644"], "renamed": [f"rename from {old}", f"rename to {new}"]}.get(status, [])
        headed = r["diff"].startswith("diff --git")
        a, b = ("/dev/null" if status == "added" else f"a/{old}"), ("/dev/null" if status in ("removed", "deleted") else f"b/{new}")
        parts.append("\n".join(([] if headed else [f"diff --git a/{old} b/{new}", *mode, f"--- {a}", f"+++ {b}"]) + [r["diff"]]))
    text = "\n".join(parts)
    plus, minus = (sum(r.get(c) or 0 for r in rows) for c in ("added_lines", "removed_lines"))
    if not plus and not minus:
        lines = text.split("\n")
        plus, minus = (sum(x.startswith(s) and not x.startswith(s * 3) for x in lines) for s in "+-")
    return {"diff": text, "changed_files": files, "additions": plus, "deletions": minus}


def kind(status: str, symbols: bool, additions: int, lines: list[int]) -> str:
    """deleted, added, comment_only, import_only or code."""
    if status in ("deleted", "added"):
        return status
    if not symbols and additions <= 0:
        return "comment_only"
    return "import_only" if lines and not symbols and max(lines) <= IMPORT_LINES else "code"


def is_test(path: str) -> bool:
    return bool(_TEST_PATH.search(path.replace("\\", "/"))) or path.lower().endswith((".test.js", ".spec.ts"))


def is_production(path: str) -> bool:
    low = path.lower()
    return path.endswith(PRODUCTION) and not low.endswith("test.py") and not any(s in low for s in SKIPPED)


def is_cochanged(paths: list[str]) -> bool:
    """Whether a change holds a test file and a production file."""
    return any(map(is_test, paths)) and any(p and not is_test(p) and PurePosixPath(p).suffix.lower() in CODE for p in paths)


def modules(path: str) -> list[str]:
    """Names by which tests may know a file, the whole dotted one first: then its first part, and for scripts its last."""
    p = PurePosixPath(path.replace("\\", "/"))
    if not is_production(path) or p.suffix.lower() not in WITH_MODULE:
        return []
    dotted = str(p.with_suffix("")).replace("/", ".")
    for prefix in ("backend.", "client.", "src."):
        dotted = dotted.removeprefix(prefix)
    parts = dotted.split(".")
    more = [parts[0], *(parts[-1:] if p.suffix.lower() != ".py" and p.suffix.lower() != ".java" else [])] if len(parts) > 1 else []
    return list(dict.fromkeys([dotted, *more]))


def test_names(path: str) -> list[str]:
    """Sorted names that a file's tests may have: after its stem, and after its folder and stem."""
    p = PurePosixPath(path.replace("\\", "/"))
    stems = [p.stem, *([f"{p.parts[-2]}_{p.stem}"] if len(p.parts) > 1 else [])]
    return sorted({pattern.replace("*", s) for pattern in TEST_NAMES.get(p.suffix.lower(), ()) for s in stems})


#: All declarations in one expression: its first group that matched tells the name.
_DECLARED = re.compile("|".join(DECLARATIONS))
_PROPERTY, _CONSTANT = re.compile(PROPERTY), re.compile(DECLARATIONS[0])
#: How far below an exported constant that goes its new name may stand.
REACH = 4


def _first_kind(line: str) -> str | None:
    """The name of a line's declaration; of several, the kind that stands first in DECLARATIONS."""
    found = [(m.lastindex, m.start(), m[m.lastindex]) for m in _DECLARED.finditer(line)]
    return min(found)[2] if found else None


def _side(line: str) -> str:
    """+ or - for a changed line, @ for what lies between changes (headers of hunks, empty lines), else a blank."""
    if line[:3] in ("+++", "---"):
        return "+" if line[0] == "+" else " "
    return line[0] if line[:1] in ("+", "-", "@") else " " if line.strip() else "@"


def symbol_delta(text: str) -> tuple[list[str], list[str], list[tuple[str, str]]]:
    """Deleted and added names (sorted), and renames.

    One pass: names are tallied by side; an exported constant that goes waits, and the next one that comes within REACH
    lines takes its place, unless a line of context comes first.
    """
    tally: dict[str, set[str]] = {"+": set(), "-": set()}
    renamed, waiting = [], []  # waiting: (name, last line that may hold its new name)
    for number, line in enumerate(text.split("\n")):
        side, header = _side(line), line[:3] in ("+++", "---")
        if side in tally and not header:
            prop = _PROPERTY.match(line)
            tally[side] |= {x for x in (_first_kind(line), prop and prop[1]) if x}
        waiting = [w for w in waiting if w[1] >= number]
        constant = _CONSTANT.search(line) if side in tally and not header else None
        if side == "+" and constant:
            renamed += [(old, constant[1]) for old, _ in waiting if old != constant[1]]
            waiting = []
        elif side == "-" and constant:
            waiting.append((constant[1], number + REACH))
        elif side == " ":
            waiting = []
    gone, come = ({pair[i] for pair in renamed} for i in (0, 1))
    return sorted(tally["-"] - tally["+"] - gone), sorted(tally["+"] - tally["-"] - come), renamed


def defined(text: str, path: str) -> list[str]:
    """Names of the functions that a new file's part of a diff adds."""
    pattern, out, mine, hunk = DEFINED.get(PurePosixPath(path).suffix, DEFINED[".py"]), [], False, False
    for line in text.split("\n"):
        if line.startswith("diff --git"):
            mine, hunk = path in line, False
        elif mine and line.startswith("@@"):
            hunk = True
        elif mine and hunk and line.startswith("+") and not line.startswith("+++") and (m := re.search(pattern, line)):
            out.append(m.group(1))
    return list(dict.fromkeys(out))


def words(name: str, least: int = 4) -> set[str]:
    """Lower-cased words of a camelCase, acronym or snake_case name."""
    split = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", name))
    return {p.lower() for p in re.split(r"[^a-zA-Z0-9]+", split) if len(p) >= least}


@dataclass(frozen=True)
class Bundle:
    """What an index is searched for; all lists are sorted and distinct."""

    files: tuple[str, ...]
    exact: tuple[str, ...]  # symbols and modules that are looked up as such
    module_exact: tuple[str, ...]  # those of them that are names of files or folders
    modules: tuple[str, ...]  # patterns of modules: name, or name.*
    stems: tuple[str, ...]
    test_files: tuple[str, ...]
    functions: tuple[tuple[str, str], ...]  # module, function
    deleted: tuple[str, ...]
    added: tuple[str, ...]
    renamed: tuple[tuple[str, str], ...]
    classes: tuple[str, ...]
    methods: tuple[str, ...]

    def tokens(self, wide: bool = True) -> list[str]:
        """Words of everything that changed; wide: symbols that came or went, too."""
        names = [*self.exact, *(m.rstrip(".*") for m in self.modules), *self.classes, *self.methods]
        names += [*self.added, *self.deleted] if wide else []
        return sorted(set().union(*map(words, names)))

    def runs_modules(self) -> bool:
        """Module patterns are left out where constants are looked up as symbols, unless their modules were demoted."""
        constants = any(c[0].isupper() and c.upper() == c for c in self.exact)
        return bool(self.modules) and (not constants or not self.module_exact)


def bundle(text: str, files: list[str] | None = None) -> Bundle:
    """The terms of a diff. Imports alone change no behaviour and give none. A file of which only SCREAMING constants
    changed is looked up by those, and by its module only as a pattern."""
    changes = parse_diff(text, files)
    deleted, added, renamed = symbol_delta(text)
    exact, module_exact, patterns, stems, names, functions = [], [], [], [], [], []
    for c in changes:
        path, symbols = c["file"], bool(c["classes"] or c["methods"])
        what, found = kind(c["status"], symbols, c["additions"], c["changed_lines"]), modules(path)
        if what == "import_only" or not found:
            continue
        constants = [x for x in c["classes"] if x[0].isupper() and x.upper() == x]
        demoted = bool(constants) and not c["methods"]
        for m in found:
            if m in GENERIC_FOLDERS:
                continue
            (patterns if demoted else module_exact).append(m)
            if "." in m and (root := m.split(".")[0]) not in GENERIC_FOLDERS:
                patterns.append(f"{root}.*")
        exact += [*c["classes"], *c["methods"]]
        stems.append(PurePosixPath(path).stem)
        names += test_names(path)
        own = (defined(text, path) if c["status"] == "added" else []) or c["methods"]
        functions += [(found[0], f) for f in own]
    every = lambda xs: tuple(sorted(set(xs)))
    return Bundle(
        every(c["file"] for c in changes), every([*exact, *module_exact, *deleted]), every(module_exact), every(patterns), every(stems), every(names), every(functions),
        tuple(deleted), tuple(added), tuple(renamed), every(x for c in changes for x in c["classes"]), every(x for c in changes for x in c["methods"]),
    )
