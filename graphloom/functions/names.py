"""Names, paths and the predicates over them, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str

#: Words of the syntax that extractors report as calls.
SYNTAX_NOISE = [
    "__block__", "__aliases__", "->", "=", "::", "<<", ">>", "&", "|>", "fn", "{}", "%{}", ".", "@", '\\\\', "|", "<-", "<<>>", "==", "!=", "||", "+",
    "-", "*", "/", ">", "<", ">=", "<=", "in", "not", "and", "or", "sigil_r", "sigil_H", "is_list", "length", "use", "require", "import", "alias",
    "moduledoc", "doc", "shortdoc", "defstruct", "defdelegate", "behaviour", "callback", "impl",
]
#: Names that say nothing in rankings.
GRAPH_NOISE = [
    "cn", "clsx", "cva", "classnames", "twMerge", "cx", "Comp", "Slot", "forwardRef", "createContext", "useContext", "createElement", "createPortal",
    "createRef", "memo", "Fragment", "Children", "React",
]
#: Further names that the node-link view leaves out.
VIEW_NOISE = [
    "i", "j", "k", "e", "x", "err", "key", "idx", "tmp", "val", "acc", "el", "ref", "ctx", "ev",
]
#: Layers by path segment, in the order in which the first match wins.
LAYERS = {
    "ports": ["ports", "port", "contracts"],
    "adapters": ["adapters", "adapter", "infrastructure", "infra"],
    "domain": ["entities", "entity", "domain", "core", "models", "model"],
    "application": ["services", "service", "usecases", "use-cases", "application", "app-services"],
    "repositories": ["repositories", "repository", "repos", "repo"],
    "api": ["api", "routes", "route", "controllers", "controller"],
    "presentation": ["components", "component", "pages", "page", "views", "view", "ui", "hooks", "app"],
    "lib": ["lib", "utils", "util", "helpers", "helper", "shared", "common"],
}
#: Folders of temporary files.
TEMP = ["/var/", "/tmp/", "/private/var/", "/private/tmp/"]
#: Languages by file extension.
LANGUAGES = {
    "elixir": [".ex", ".exs"], "javascript": [".js", ".jsx", ".mjs"], "typescript": [".ts"], "tsx": [".tsx"], "python": [".py"], "go": [".go"],
    "rust": [".rs"], "java": [".java"], "ruby": [".rb"], "kotlin": [".kt", ".kts"], "swift": [".swift"],
}


def _c(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def matches(a: Name, b: Name) -> Column:
    """Equal without case, or one ends with a dot and the other."""
    x, y = F.lower(_c(a)), F.lower(_c(b))
    return (x == y) | F.endswith(x, F.concat(F.lit("."), y)) | F.endswith(y, F.concat(F.lit("."), x))


def suffixes(name: Name) -> Column:
    """All dotted suffixes of the lower-cased name, itself first: a.b.c, b.c, c."""
    parts = F.split(F.lower(_c(name)), "[.]")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def last_segment(name: Name) -> Column:
    return F.substring_index(F.lower(_c(name)), ".", -1)


def without_noise(names: Name) -> Column:
    """The array without syntax words, repeats kept."""
    return F.filter(_c(names), lambda x: ~x.isin(SYNTAX_NOISE))


def is_binding(name: Name) -> Column:
    """A destructuring pattern rather than a name; null counts as one."""
    n = _c(name)
    return n.isNull() | n.startswith("[") | n.startswith("{") | n.contains(",") | n.contains(" ")


def is_noise(name: Name) -> Column:
    """Names that say nothing in statistics."""
    n = _c(name)
    return n.isin(GRAPH_NOISE) | n.rlike("^[A-Z][a-z]{0,3}$") | is_binding(n)


def is_view_noise(name: Name) -> Column:
    """Names that the node-link view leaves out."""
    n = F.coalesce(_c(name), F.lit(""))
    return (F.length(n) <= 2) | n.isin(GRAPH_NOISE + VIEW_NOISE) | n.rlike("^[A-Z][a-z]{0,3}$") | n.startswith("[") | n.startswith("{") | n.contains(",")


def references(content: Name, name: Name) -> Column:
    """The content has the name as a whole word."""
    return F.regexp_like(_c(content), F.concat(F.lit(r"\b\Q"), F.replace(_c(name), F.lit(r"\E"), F.lit("")), F.lit(r"\E\b")))


def is_test_file(path: Name) -> Column:
    return _c(path).rlike(r"[._](test|spec)\.[^./]+$|/__tests__/")


def is_test_collection(name: Name) -> Column:
    return _c(name).rlike("_test$|_test_")


def is_temporary(path: Name) -> Column:
    out = F.lit(False)
    for t in TEMP:
        out = out | _c(path).startswith(t)
    return out


def layer(path: Name, globs: dict[str, str] | None = None) -> Column:
    """A configured glob first, then the first layer with a path segment of its list, else other."""
    p = _c(path)
    folders = F.split(F.lower(p), "/")
    out = None
    for name, pattern in (globs or {}).items():
        hit = p.rlike(glob_regex(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    for name, some in LAYERS.items():
        hit = F.arrays_overlap(folders, F.array(*map(F.lit, some)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def glob_regex(glob: str) -> str:
    """A path glob as an anchored regular expression: ** any folders, * and ? within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def import_stem(target: Name) -> Column:
    """What an import path asks a file path to end with; null without a slash, as for packages."""
    t = _c(target)
    for prefix in ("^@/", r"^\.\./", r"^\./"):
        t = F.regexp_replace(t, prefix, "")
    return F.when(F.contains(_c(target), F.lit("/")), t)


def without_extension(path: Name) -> Column:
    """The path as imports write it."""
    return F.regexp_replace(_c(path), r"\.(ts|tsx|js|jsx)$", "")


def import_matches(path: Name, target: Name) -> Column:
    """An import path names this file."""
    return F.coalesce(F.endswith(without_extension(path), import_stem(target)), F.lit(False))


def endings(text: Name) -> Column:
    """All suffixes of a text, itself first: the keys of an equi-join on "ends with"."""
    return F.transform(F.sequence(F.lit(1), F.length(_c(text)) + 1), lambda i: F.substr(_c(text), i))


def stem(path: Name) -> Column:
    """File name without folders, extension, - and _, lower-cased."""
    base = F.regexp_replace(F.substring_index(_c(path), "/", -1), r"\.[^.]+$", "")
    return F.lower(F.regexp_replace(base, "[-_]", ""))


def language(path: Name) -> Column:
    ext = F.lower(F.regexp_extract(_c(path), r"(\.[^./]+)$", 1))
    out = None
    for name, some in LANGUAGES.items():
        out = F.when(ext.isin(some), name) if out is None else out.when(ext.isin(some), name)
    return out


def folder_group(path: Name) -> Column:
    """The last two folders of a path; one folder alone; none: empty."""
    parts = F.split(_c(path), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_join(F.when(F.size(folders) > 2, F.slice(folders, -2, 2)).otherwise(folders), "/")


def package(path: Name) -> Column:
    """The last folder of a path, . without one."""
    folder = F.substring_index(folder_group(path), "/", -1)
    return F.when(folder == "", ".").otherwise(folder)


def percent(part: Name, whole: Name) -> Column:
    """Rounded percent of a whole, at most 100; 0 of nothing."""
    return F.when(_c(whole) == 0, 0).otherwise(F.least(F.round(_c(part) / _c(whole) * 100).cast("int"), F.lit(100)))


def collection_name(name: Name) -> Column:
    """Lower case, other characters than letters, digits and _ as _, no leading _, at most 60."""
    return F.substring(F.ltrim(F.regexp_replace(F.lower(_c(name)), "[^a-z0-9_]", "_"), F.lit("_")), 1, 60)


def as_int(value: Name, default: int) -> Column:
    """A leading integer of a text, or the default."""
    return F.coalesce(F.regexp_extract(_c(value).cast("string"), r"^([+-]?\d+)", 1).try_cast("int"), F.lit(default))


def relative(path: Name, root: str) -> Column:
    root = root.rstrip("/") + "/"
    p = _c(path)
    return F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p)
