"""Source text to entities, on executors, one output schema for all languages.

Python goes through its own parser; the other languages through a scanner that
knows each one's declaration forms, ends a declaration by braces, ``end`` or
indentation, and reads calls as names before a parenthesis.  A file that can't
be read yields one row with ``error`` and no entity.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ENTITY, LISTS, conform

SCHEMA = "file_path string, entity_type string, name string, content string, start_line long, end_line long, docstring string, module_path string, visibility string, parameters array<string>, calls array<string>, is_a array<string>, contains array<string>, language string, error string"

CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*[!?]?)\s*\(")
TAG = re.compile(r"<([A-Z]\w*(?:\.\w+)*)")
NEW = re.compile(r"\bnew\s+([A-Z]\w*)")
WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "def", "fn", "func", "fun", "class", "match", "when", "case", "do", "end", "else", "elif", "except", "with", "sizeof", "super", "init", "defp", "defmodule", "defmacro", "unless", "cond", "guard", "let", "var", "val", "and", "or", "not", "in", "print"}

#: Declarations by language: (entity type, pattern with the groups name, and params or supers).
FORMS: dict[str, list[tuple[str, str]]] = {
    "elixir": [("module", r"^\s*defmodule\s+(?P<name>[\w.]+)"), ("macro", r"^\s*defmacrop?\s+(?P<name>\w+[!?]?)(?:\((?P<params>[^)]*)\))?"), ("function", r"^\s*(?P<private>defp)\s+(?P<name>\w+[!?]?)(?:\((?P<params>[^)]*)\))?"), ("function", r"^\s*def\s+(?P<name>\w+[!?]?)(?:\((?P<params>[^)]*)\))?"), ("struct", r"^\s*(?P<name>defstruct)\b")],
    "go": [("method", r"^func\s*\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*\((?P<params>[^)]*)\)"), ("function", r"^func\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)"), ("struct", r"^type\s+(?P<name>\w+)\s+struct\b"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b")],
    "rust": [("struct", r"^\s*(?P<public>pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("enum", r"^\s*(?P<public>pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("interface", r"^\s*(?P<public>pub(?:\([^)]*\))?\s+)?trait\s+(?P<name>\w+)(?:\s*:\s*(?P<supers>[^{]+))?"), ("module", r"^\s*(?P<public>pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"), ("function", r"^\s*(?P<public>pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)[^(]*\((?P<params>[^)]*)\)")],
    "java": [("class", r"^\s*(?P<mods>(?:public|private|protected|static|final|abstract|sealed)\s+)*(?:class|record)\s+(?P<name>\w+)[^{]*?(?:extends\s+(?P<supers>[\w.<>]+))?\s*(?:implements\s+(?P<ports>[\w.,<>\s]+))?\s*\{"), ("interface", r"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<supers>[\w.,<>\s]+))?"), ("enum", r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(?P<name>\w+)"), ("method", r"^\s+(?P<mods>(?:public|private|protected|static|final|abstract|synchronized)\s+)*(?!return|new|else|throw)[\w<>\[\],.]+\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w.,\s]+)?\{")],
    "javascript": [("class", r"^\s*(?P<public>export\s+(?:default\s+)?)?(?:abstract\s+)?class\s+(?P<name>\w+)(?:\s+extends\s+(?P<supers>[\w.]+))?(?:\s+implements\s+(?P<ports>[\w.,\s]+))?"), ("interface", r"^\s*(?P<public>export\s+)?interface\s+(?P<name>\w+)(?:\s+extends\s+(?P<supers>[\w.,\s]+))?"), ("struct", r"^\s*(?P<public>export\s+)?type\s+(?P<name>\w+)\s*(?:<[^>]*>)?\s*="), ("function", r"^\s*(?P<public>export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>\w+)\s*\((?P<params>[^)]*)\)"), ("function", r"^\s*(?P<public>export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\((?P<params>[^)]*)\)[^=]*|\w+\s*)=>"), ("variable", r"^(?P<public>export\s+)?(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?="), ("method", r"^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!if|for|while|switch|catch|return|function)(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?::[^{]+)?\{")],
    "ruby": [("module", r"^\s*module\s+(?P<name>[\w:]+)"), ("class", r"^\s*class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<supers>[\w:]+))?"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[!?=]?)(?:\((?P<params>[^)]*)\))?")],
    "kotlin": [("class", r"^\s*(?:(?:public|private|internal|open|data|abstract|sealed)\s+)*(?:class|object)\s+(?P<name>\w+)(?:\([^)]*\))?(?:\s*:\s*(?P<supers>[\w.,()\s]+))?"), ("interface", r"^\s*interface\s+(?P<name>\w+)"), ("function", r"^\s*(?:(?:public|private|internal|override|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)")],
    "swift": [("class", r"^\s*(?:(?:public|private|open|final)\s+)*(?:class|actor)\s+(?P<name>\w+)(?:\s*:\s*(?P<supers>[\w.,\s]+))?"), ("struct", r"^\s*(?:(?:public|private)\s+)*(?:struct|enum)\s+(?P<name>\w+)(?:\s*:\s*(?P<supers>[\w.,\s]+))?"), ("interface", r"^\s*(?:public\s+)?protocol\s+(?P<name>\w+)"), ("function", r"^\s*(?:(?:public|private|static|override|final|mutating)\s+)*func\s+(?P<name>\w+)[^(]*\((?P<params>[^)]*)\)")],
}
FORMS["typescript"] = FORMS["tsx"] = FORMS["javascript"]
IMPORTS = {
    "elixir": r"^\s*(?:use|import|require|alias)\s+([\w.]+)", "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "javascript": r"(?:from\s+|require\(\s*|^\s*import\s+)['\"]([^'\"]+)['\"]", "ruby": r"^\s*(?:require|require_relative|include|extend)\s+['\"]?([\w:/.]+)", "kotlin": r"^\s*import\s+([\w.]+)", "swift": r"^\s*import\s+(\w+)",
}
IMPORTS["typescript"] = IMPORTS["tsx"] = IMPORTS["javascript"]
#: Composite literals of Go: the type, and the key type of a map.
LITERAL = re.compile(r"(?<![\w.])(?:(?:map\[(?P<key>[\w.*]+)\]|\[\d*\])[&*]*)*[&*]*(?:\w+\.)?(?P<type>[A-Za-z_]\w*)(?:\[[\w.*, ]*\])?\{")
PLAIN_TYPES = {"struct", "interface", "string", "int", "bool", "byte", "rune", "float64", "float32", "int64", "int32", "uint", "error", "any"}
#: An import with the names it binds, over any lines; a return type; the type of a constant.
BOUND = re.compile(r"^[ \t]*import\s+(?:type\s+)?([^'\";()]{1,2000}?)\s+from\s+['\"]", re.M)
RETURNS = re.compile(r"\)\s*:\s*([A-Za-z_]\w*)")
TYPED = re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+\w+\s*:\s*([A-Za-z_]\w*)")
WEB = ("javascript", "typescript", "tsx")
#: Files of one frame on its way back from the parser.
FRAME = 256
#: Kinds that own the declarations within their lines.
OWNERS = {"module", "class", "struct", "interface", "enum"}


def _unique(items: Iterator[str] | list[str]) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))


def _row(path: str, kind: str, name: str, lines: list[str], start: int, end: int, language: str, **more: object) -> dict:
    out = {"file_path": path, "entity_type": kind, "name": name, "content": "\n".join(lines[start - 1 : end]), "start_line": start, "end_line": end, "docstring": None, "module_path": None, "visibility": "public", "language": language, "error": None}
    return out | {k: [] for k in LISTS} | more


def bound_names(source: str) -> list[str]:
    """Names that the imports of a script bind."""
    out = []
    for m in BOUND.finditer(source):
        braces = re.search(r"\{([^}]*)\}", m[1])
        out += [x.strip().split(" as ")[-1].strip().removeprefix("type ") for x in (braces[1].split(",") if braces else [])]
        out += [x.strip().removeprefix("* as ").strip() for x in re.sub(r"\{[^}]*\}", "", m[1]).split(",")]
    return _unique(x for x in out if re.fullmatch(r"\w+", x))


def enriched(rows: list[dict], known: dict[str, str]) -> list[dict]:
    """Functions also call what their text names as a whole word: known is word -> call."""
    for r in rows:
        if known and r["entity_type"] in ("function", "method") and r["content"]:
            words = set(re.findall(r"\w+", r["content"]))
            r["calls"] = _unique(r["calls"] + [call for word, call in known.items() if word in words])
    return rows


def implemented(line: str, body: str) -> list[str]:
    """The type that a function returns or a constant has: what it implements where there are no classes."""
    whole = line.count("(") <= line.count(")")  # else the parameters go on in the next lines
    head = re.split(r"\{|=>", line if whole else body, maxsplit=1)[0]
    return _unique(TYPED.findall(line)[:1] + RETURNS.findall(head)[-1:])


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return ""


def python_entities(path: str, source: str) -> list[dict]:
    tree, lines, out = ast.parse(source), source.splitlines(), []
    imports, symbols, taken = [], {}, {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                imports.append(a.name)
                symbols[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            imports.append(base)
            taken |= {a.asname or a.name: f"{base}.{a.name}" for a in node.names if a.name != "*"}
            symbols |= taken

    def called(node: ast.AST) -> list[str]:
        found = []
        for x in ast.walk(node):
            if isinstance(x, ast.Call) and (name := _dotted(x.func)):
                head, _, rest = name.partition(".")
                found.append(f"{symbols[head]}{'.' + rest if rest else ''}" if head in symbols else name)
        return _unique(found)

    def visit(body: list[ast.stmt], owner: str | None) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                methods = [x.name for x in node.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef)]
                bases = _unique([_dotted(b) for b in node.bases] + [_dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list])
                out.append(_row(path, "class", node.name, lines, node.lineno, node.end_lineno, "python", docstring=ast.get_docstring(node), visibility="private" if node.name.startswith("_") else "public", is_a=bases, contains=methods))
                visit(node.body, node.name)
            elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                a = node.args
                params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                marks = _unique(_dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list)
                name = f"{owner}.{node.name}" if owner else node.name
                out.append(_row(path, "method" if owner else "function", name, lines, node.lineno, node.end_lineno, "python", docstring=ast.get_docstring(node), module_path=owner, visibility="private" if node.name.startswith("_") else "public", parameters=params, calls=called(node), is_a=marks))
                visit(node.body, None)

    visit(tree.body, None)
    enriched(out, taken)
    stem = path.rsplit("/", 1)[-1].removesuffix(".py")
    name = path.rsplit("/", 2)[-2] if stem == "__init__" and "/" in path else stem
    top = [x.name for x in tree.body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
    out.append(_row(path, "module", name, lines, 1, max(1, len(lines)), "python", content=ast.get_docstring(tree) or "", is_a=_unique(imports), contains=top))
    return out


def _end(lines: list[str], start: int, language: str) -> int:
    """The last line of a declaration that begins at ``start``."""
    indent = len(lines[start - 1]) - len(lines[start - 1].lstrip())
    if language in ("elixir", "ruby"):
        if language == "elixir" and not re.search(r"\bdo\s*$", lines[start - 1]):
            return start
        for i in range(start, len(lines)):
            if re.match(rf"\s{{{indent}}}end\b", lines[i]):
                return i + 1
        return len(lines)
    depth, opened = 0, False
    for i in range(start - 1, len(lines)):
        plain = re.sub(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"|//.*", "", lines[i])
        depth += plain.count("{") - plain.count("}")
        opened |= "{" in plain
        if opened and depth <= 0 or not opened and (";" in plain or i > start + 2):
            return i + 1 if opened or ";" in plain else start
    return len(lines)


def _hidden(m: re.Match, name: str, language: str) -> bool:
    groups = m.groupdict()
    if language == "go":
        return not name[:1].isupper()
    if language == "rust":
        return not groups.get("public")
    head = m.group(0)
    return bool(groups.get("private")) or bool(re.search(r"\b(?:private|protected)\b", head))


def scanned_entities(path: str, source: str, language: str) -> list[dict]:
    lines, out = source.splitlines(), []
    forms = [(kind, re.compile(p)) for kind, p in FORMS[language]]
    owner_at: list[tuple[int, str]] = []  # (last line, impl type) of Rust impl blocks
    imports = _unique(m[1].replace("::", ".") for line in lines for m in [re.search(IMPORTS[language], line)] if m)
    for i, line in enumerate(lines, 1):
        if language == "rust" and (m := re.match(r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<port>[\w:]+)(?:<[^>]*>)?\s+for\s+)?(?P<type>\w+)", line)):
            owner_at.append((_end(lines, i, language), m["type"]))
        for kind, form in forms:
            if not (m := form.match(line)) or m["name"] in WORDS - {"init", "print"}:
                continue
            groups = m.groupdict()
            name, end = m["name"], _end(lines, i, language)
            owner = groups.get("owner") or next((t for last, t in reversed(owner_at) if last >= i), None)
            if kind == "struct" and name == "defstruct":
                name = next((r["name"] for r in reversed(out) if r["entity_type"] == "module"), "struct")
            if language == "java" and kind == "method":
                owner = next((r["name"] for r in reversed(out) if r["entity_type"] in OWNERS and r["end_line"] >= i), None)
            if owner and kind in ("function", "method"):
                kind, name = "method", f"{owner}.{name}"
            params = _unique(re.split(r"[\s:=]+", p.strip().lstrip("&*").removeprefix("mut "))[-1 if language == "java" else 0] for p in (groups.get("params") or "").split(","))
            supers = _unique(re.sub(r"[<(].*", "", s).strip() for g in ("supers", "ports") for s in re.split(r"[,+]", groups.get(g) or ""))
            body = "\n".join(lines[i - 1 : end])
            own = m["name"]
            calls = [c[1] for c in CALL.finditer(body) if c[1] not in WORDS and c[1] != own] if kind in ("function", "method", "macro", "variable") else []
            if language in WEB and kind in ("function", "method", "variable"):
                calls += TAG.findall(body) + NEW.findall(body)
                supers += implemented(line, body)
            if language == "go" and kind in ("function", "method"):
                calls += [x for c in LITERAL.finditer(body.split("{", 1)[-1]) for x in ((c["key"] or "").lstrip("*").rsplit(".", 1)[-1], c["type"]) if x and x not in PLAIN_TYPES and x not in WORDS]
            if language == "java":
                calls += [f"new {t}" for t in NEW.findall(body)] if kind == "method" else []
            if language == "rust" and kind in ("function", "method"):
                calls += [x + "!" for x in re.findall(r"\b(\w+)!\s*[(\[{]", body)]
            out.append(_row(path, kind, name, lines, i, end, language, module_path=owner, visibility="private" if _hidden(m, own, language) else "public", parameters=params, calls=_unique(calls), is_a=supers))
            break
    for r in out:
        if r["entity_type"] in OWNERS:
            inner = [x["name"].rsplit(".", 1)[-1] for x in out if x is not r and r["start_line"] < x["start_line"] and x["end_line"] <= r["end_line"]]
            r["contains"] = _unique(inner + [x["name"].rsplit(".", 1)[-1] for x in out if x["module_path"] == r["name"]])
    if language in WEB:
        enriched(out, {x: x for x in bound_names(source)})
    exported = _unique(n for line in lines for m in [re.search(r"^\s*export\s*(?:default\s+(\w+)|\{([^}]*)\})", line)] if m for n in re.split(r"\s*,\s*", (m[1] or m[2]).strip())) if language in WEB else []
    for r in out:
        if r["name"] in exported:
            r["visibility"] = "public"
    base = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    name = path.rsplit("/", 2)[-2] if base in ("index", "mod") and "/" in path else base
    head = "\n".join(x for x in lines[:5] if re.match(r"\s*['\"]use \w+['\"]", x))
    if language == "elixir":
        for r in out:
            if r["entity_type"] == "module":
                r["is_a"] = _unique(r["is_a"] + imports)
    else:
        out.append(_row(path, "module", name, lines, 1, max(1, len(lines)), language, content=head, is_a=imports, contains=[r["name"] for r in out if not r["module_path"]]))
    return out


def parse(path: str, language: str, source: str | None) -> list[dict]:
    """Entities of one file; an unreadable file is one row that says why."""
    try:
        rows = python_entities(path, source or "") if language == "python" else scanned_entities(path, source or "", language)
    except (SyntaxError, ValueError, RecursionError, KeyError) as e:
        return [{f.name: None for f in ENTITY.fields if f.name != "id"} | {"file_path": path, "language": language, "error": f"{type(e).__name__}: {e}"}]
    return rows


def extract(files: DataFrame) -> DataFrame:
    """files: (path, language, content).  Entity columns without id, and ``error``."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), FRAME):
                rows = [r for file in batch.iloc[at : at + FRAME].itertuples(index=False) for r in parse(*file)]
                yield pd.DataFrame(rows, columns=names)

    return files.filter(F.col("language").isNotNull()).select("path", "language", "content").mapInPandas(run, SCHEMA)


def entities(files: DataFrame) -> DataFrame:
    """Entities of the files that could be read, conformed, with ids."""
    return conform(extract(files).filter(F.col("error").isNull()).drop("error"))
