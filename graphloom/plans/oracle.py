"""DuckDB twins of the queries, written by hand from the operators' definitions.

Dotted-boundary matches are compared pair by pair here, and reached nodes by a
recursive query, so nothing of the Spark plans is repeated.
"""

from __future__ import annotations

import hashlib

from ..functions.names import GRAPH_NOISE, LAYERS, SYNTAX_NOISE, TEMP, VIEW_NOISE
from ..operators.graph import CALLBACKS, EXPORTS, FILES, GO_TESTS, WEB
from .adapters import GROUP, TEMPLATES
from .queries import BOUNDS, CUT, FILE, KNOWN, PAGE, REFS, ROOT, SEARCH, STORE, TREE


def quoted(text: str | int) -> str:
    return str(text) if isinstance(text, int) else "'" + text.replace("'", "''") + "'"


def among(words: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def filled(column: str) -> str:
    return f"replace(replace(replace({column}, '{{n}}', n_name), '{{l}}', lower(n_name)), '{{long}}', repeat('ü', 2500))"


def listed(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN e ELSE string_split({filled(column)}, '|') END"


ENTITIES = f"""
parts AS (SELECT *, replace(p_name, ' ', '_') || '_' || CAST(p_partkey // 10 AS VARCHAR) AS pname FROM part),
home AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
sellers AS (SELECT s_suppkey, s_name, n_name, r_name, n_name || '_' || CAST(s_suppkey // {GROUP} AS VARCHAR) AS module, 'src/core/' || r_name || '/' || n_name || '_' || CAST(s_suppkey // {GROUP} AS VARCHAR) || '.ex' AS path FROM supplier JOIN home ON s_nationkey = n_nationkey),
sells AS (SELECT DISTINCT l_suppkey, 'Lib.' || pname AS call FROM lineitem JOIN parts ON l_partkey = p_partkey),
next_event AS (SELECT user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS callee FROM events),
followed AS (SELECT user_id, callee, count(*) AS n FROM next_event WHERE callee IS NOT NULL AND callee <> user_id GROUP BY ALL),
templates(t_path, t_type, t_name, t_content, t_start, t_end, t_visibility, t_calls, t_is_a, t_contains, t_language) AS (VALUES {", ".join("(" + ", ".join(map(quoted, t)) + ")" for t in TEMPLATES)}),
nothing AS (SELECT CAST([] AS VARCHAR[]) AS e),
raw_entities AS (
  SELECT 'src/ports/' || r_name || '.go' AS file_path, 'interface' AS entity_type, r_name AS name, 'interface ' || r_name || ' of all nations' AS content,
    CAST(1 AS BIGINT) AS start_line, CAST(9 AS BIGINT) AS end_line, 'public' AS visibility, e AS parameters, e AS calls, e AS is_a, e AS contains, 'go' AS language FROM region, nothing
  UNION ALL SELECT path, 'module', module, 'module ' || module || ' of ' || r_name, 1, 1000000000, 'public', e, coalesce(any_value(c.calls), e), [r_name], list_sort(list(DISTINCT s_name)), 'elixir'
    FROM sellers LEFT JOIN (SELECT module AS k, list_sort(list(DISTINCT call)) AS calls FROM sellers JOIN sells ON s_suppkey = l_suppkey GROUP BY 1) c ON k = module, nothing GROUP BY path, module, r_name, e
  UNION ALL SELECT path, CASE WHEN s_suppkey % 11 = 0 THEN 'macro' ELSE 'method' END, s_name, 'method ' || s_name || ' of ' || n_name, s_suppkey * 10 + 2, s_suppkey * 10 + 10, CASE WHEN s_suppkey % 7 <> 0 THEN 'public' END, e, coalesce(c.calls, e), e, e, 'elixir'
    FROM sellers LEFT JOIN (SELECT l_suppkey, list_sort(list(DISTINCT call)) AS calls FROM sells GROUP BY 1) c ON l_suppkey = s_suppkey, nothing
  UNION ALL SELECT 'src/services/' || lower(c_mktsegment) || '/' || n_name || '.py', 'function', n_name || '.' || c_name, 'def ' || c_name || '(): # ' || c_mktsegment, c_custkey * 10 + 1, c_custkey * 10 + 9,
    CASE WHEN c_acctbal < 0 THEN 'private' ELSE 'public' END, [lower(c_mktsegment)], coalesce(b.calls, e), CASE WHEN c_custkey % 5 = 0 THEN [n_name, r_name] ELSE [n_name] END, e, 'python'
    FROM customer JOIN home ON c_nationkey = n_nationkey LEFT JOIN (
      SELECT o_custkey, list_sort(list(DISTINCT module || '.' || s_name)) AS calls FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN sellers ON l_suppkey = s_suppkey GROUP BY o_custkey) b ON c_custkey = o_custkey, nothing
  UNION ALL SELECT 'src/lib/' || replace(p_brand, '#', '_') || '/' || lower(p_type) || '.js', 'variable', pname, 'const ' || pname || ' = make(''' || p_type || ''', ' || CAST(p_size AS VARCHAR) || ')', p_partkey + 1, p_partkey + 1, 'public', e, e, e, e, 'javascript' FROM parts, nothing
  UNION ALL SELECT 'src/web/handlers/group_' || CAST(user_id % 10 AS VARCHAR) || '.rb', 'function', 'Events.user_' || CAST(user_id AS VARCHAR), 'def user_' || CAST(user_id AS VARCHAR) || ' -- handles the events of one user', user_id * 10 + 1, user_id * 10 + 8, 'public', e, coalesce(f.calls, e), e, e, 'ruby'
    FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id AS k, list(CASE WHEN callee % 2 = 0 THEN 'user_' ELSE 'Events.user_' END || CAST(callee AS VARCHAR) ORDER BY n DESC, callee) AS calls FROM followed GROUP BY 1) f ON k = user_id, nothing
  UNION ALL SELECT {filled("t_path")}, t_type, {filled("t_name")}, {filled("t_content")}, t_start, t_end, nullif(t_visibility, ''), e, {listed("t_calls")}, {listed("t_is_a")}, {listed("t_contains")}, t_language FROM templates, home, nothing),
entities AS MATERIALIZED (SELECT sha256(file_path || ':' || entity_type || ':' || name || ':' || CAST(start_line AS VARCHAR)) AS id, * FROM raw_entities),
edges AS MATERIALIZED (
  SELECT id AS src_id, 'calls' AS kind, i - 1 AS pos, calls[i] AS target FROM entities, unnest(range(1, len(calls) + 1)) AS t(i)
  UNION ALL SELECT id, 'is_a', i - 1, is_a[i] FROM entities, unnest(range(1, len(is_a) + 1)) AS t(i)
  UNION ALL SELECT id, 'contains', i - 1, contains[i] FROM entities, unnest(range(1, len(contains) + 1)) AS t(i))"""


def m(a: str, b: str) -> str:
    """Dotted-boundary match of two expressions."""
    return f"(lower({a}) = lower({b}) OR ends_with(lower({a}), '.' || lower({b})) OR ends_with(lower({b}), '.' || lower({a})))"


def last(a: str) -> str:
    return f"list_last(string_split(lower({a}), '.'))"


FUNCTION = "entity_type IN ('function', 'method')"

RESOLVED = f"""
wanted AS (SELECT DISTINCT lower(target) AS k FROM edges WHERE kind = 'calls'),
direct AS (SELECT k, e.id, e.name, e.file_path, e.start_line, 1 AS strategy FROM wanted JOIN entities e ON {m("k", "e.name")}),
retry AS (SELECT k, e.id, e.name, e.file_path, e.start_line, 2 AS strategy FROM wanted JOIN entities e ON {m(last("k"), "e.name")} WHERE k NOT IN (SELECT k FROM direct)),
candidates AS (SELECT * FROM direct UNION ALL SELECT * FROM retry),
resolved AS (
  SELECT src_id, pos, g.target, c.id AS dst_id, c.name AS dst_name, c.file_path AS dst_file, c.strategy
  FROM edges g JOIN entities s ON s.id = src_id LEFT JOIN candidates c ON c.k = lower(g.target) WHERE kind = 'calls'
  QUALIFY row_number() OVER (PARTITION BY src_id, pos ORDER BY (c.file_path = s.file_path) DESC NULLS LAST, c.file_path, c.start_line, c.id) = 1)"""

DEGREES = f"""
refs AS (SELECT lower(target) AS ref, count(*) AS n FROM edges GROUP BY 1),
exact AS (SELECT ref, n, id AS dst FROM refs JOIN entities ON lower(name) = ref QUALIFY row_number() OVER (PARTITION BY ref ORDER BY file_path, start_line, id) = 1),
near AS (SELECT ref, n, id AS dst FROM refs JOIN entities ON {m("name", "ref")} WHERE length(ref) > 2 AND ref NOT IN (SELECT ref FROM exact) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY file_path, start_line, id) = 1),
degrees AS (
  SELECT e.*, coalesce(i.n, 0) AS incoming_count, CAST(len(calls) + len(is_a) + len(contains) AS BIGINT) AS outgoing_degree
  FROM entities e LEFT JOIN (SELECT dst, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM exact UNION ALL SELECT * FROM near) GROUP BY dst) i ON e.id = dst)"""

NOISE_WORDS = among(SYNTAX_NOISE)
BINDING = "(name IS NULL OR name LIKE '[%' OR name LIKE '{%' OR name LIKE '%,%' OR name LIKE '% %')"
NOISE = f"(name IN {among(GRAPH_NOISE)} OR regexp_matches(name, '^[A-Z][a-z]{{0,3}}$') OR {BINDING})"
HIDDEN = f"(length(name) <= 2 OR name IN {among(GRAPH_NOISE + VIEW_NOISE)} OR regexp_matches(name, '^[A-Z][a-z]{{0,3}}$') OR name LIKE '[%' OR name LIKE '{{%' OR name LIKE '%,%')"
TEMPORARY = "(" + " OR ".join(f"starts_with(file_path, {quoted(t)})" for t in TEMP) + ")"
TESTED = "regexp_matches(file_path, '[._](test|spec)\\.[^./]+$|/__tests__/')"
ENTRY = "regexp_matches(file_path, '^src/jobs/.*$')"
BASE = "regexp_replace(list_last(string_split(file_path, '/')), '\\.[^.]+$', '')"
FOLDERS = "array_to_string(string_split(file_path, '/')[-3:-2], '/')"
PACKAGE = "coalesce(string_split(file_path, '/')[-2], '.')"
CONVENTION = f"""({TESTED} OR (language = 'elixir' AND (ends_with(file_path, '_controller.ex') OR name IN {among(CALLBACKS)})) OR (language = 'go' AND regexp_matches(name, '^({"|".join(GO_TESTS)})'))
  OR (language IN {among(WEB)} AND (name IN {among(EXPORTS)} OR contains(file_path, '/components/ui/') OR ({BASE} IN {among(FILES)} AND (name = {BASE} OR regexp_matches(name, '^[A-Z]|^(get|fetch|load|generate)[A-Z]'))))))"""

DEAD = f"""
used AS (SELECT lower(target) AS u FROM edges WHERE kind = 'calls' UNION SELECT {last("target")} FROM edges WHERE kind = 'calls'),
unused AS (
  SELECT * FROM entities x WHERE {FUNCTION} AND coalesce(visibility, 'public') = 'public' AND NOT {CONVENTION} AND lower(name) NOT IN (SELECT u FROM used)
  AND NOT EXISTS (SELECT 1 FROM edges g JOIN entities p ON p.entity_type IN ('interface', 'struct') AND lower(g.target) = lower(p.name) WHERE g.kind = 'is_a' AND g.src_id = x.id)),
dead AS (SELECT * FROM unused WHERE NOT {ENTRY})"""


def impact(root: str, depth: int) -> tuple[str, ...]:
    """Paths of dependents: callers count once by name and file and become functions of their files."""
    return (
        f"""lnk AS (SELECT DISTINCT kind, src_id, lower(target) AS t FROM edges WHERE kind IN ('calls', 'is_a')),
ats AS (SELECT DISTINCT name AS at_name FROM entities UNION SELECT {quoted(root)}),
meeting AS (SELECT at_name, t FROM ats JOIN (SELECT DISTINCT t FROM lnk) ON {m("t", "at_name")}),
met AS MATERIALIZED (SELECT at_name, kind, x.id, x.name, x.file_path, x.entity_type, x.start_line, x.end_line FROM meeting JOIN lnk USING (t) JOIN entities x ON x.id = src_id),
firsts AS (SELECT DISTINCT ON (at_name, name, file_path) * FROM met ORDER BY at_name, name, file_path, start_line, id),
fns AS (SELECT DISTINCT at_name, id, name, file_path, start_line, end_line FROM met WHERE kind = 'calls' AND {FUNCTION}),
rel AS MATERIALIZED (
  SELECT f.at_name, f.name, f.file_path, coalesce(g.name, f.name) AS n_name FROM firsts f LEFT JOIN fns g ON f.entity_type NOT IN ('function', 'method') AND g.at_name = f.at_name AND g.file_path = f.file_path
  QUALIFY row_number() OVER (PARTITION BY f.at_name, f.id ORDER BY (f.end_line > f.start_line AND g.start_line >= f.start_line AND g.end_line <= f.end_line) DESC NULLS LAST, g.start_line, g.id) = 1),
walk AS (
  SELECT 1 AS depth, [n_name || '|' || file_path] AS p, n_name AS name, file_path FROM rel WHERE at_name = {quoted(root)}
  UNION ALL SELECT depth + 1, list_append(p, r.n_name || '|' || r.file_path), r.n_name, r.file_path FROM walk w JOIN rel r ON r.at_name = w.name
  WHERE depth < {depth} AND NOT list_contains(p, r.name || '|' || r.file_path))""",
    )


def stem(x: str) -> str:
    """What an import path asks a file path to end with."""
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '^@/', ''), '^\\.\\./', ''), '^\\./', '')"


def named(imported: str, path: str) -> str:
    return f"(contains({imported}, '/') AND ends_with(regexp_replace({path}, '\\.(ts|tsx|js|jsx)$', ''), {stem(imported)}))"


COUPLED = f"""
own AS (SELECT * FROM entities WHERE file_path = '{FILE}'),
others AS (SELECT * FROM entities WHERE file_path <> '{FILE}'),
own_names AS (SELECT DISTINCT name AS own_name FROM own),
own_calls AS (SELECT caller, start_line, id, call, NOT EXISTS (SELECT 1 FROM own_names WHERE {m("call", "own_name")}) AS outside FROM (SELECT name AS caller, start_line, id, unnest(calls) AS call FROM own)),
made AS (SELECT file_path, name, unnest(calls) AS call FROM others),
coupled AS (
  SELECT DISTINCT file_path, name AS from_name, to_name, 'incoming' AS direction FROM (SELECT file_path, made.name, call, min(own_name) AS to_name FROM made JOIN own_names ON {m("call", "own_name")} GROUP BY ALL)
  UNION ALL SELECT file_path, arg_min(caller, (start_line, id)), name, 'outgoing' FROM (SELECT DISTINCT file_path, name FROM others) JOIN own_calls ON {m("call", "name")} GROUP BY file_path, name HAVING bool_or(outside)
  UNION ALL SELECT file_path, min(name), 'page.tsx', 'imports' FROM (SELECT file_path, name, unnest(is_a) AS imp FROM others) WHERE {named("imp", quoted(FILE))} GROUP BY file_path
  UNION ALL SELECT file_path, 'page.tsx', min(name), 'imported_by' FROM others WHERE EXISTS (SELECT 1 FROM (SELECT unnest(is_a) AS imp FROM own) WHERE {named("imp", "file_path")}) GROUP BY file_path),
counted AS (SELECT *, direction IN ('imports', 'imported_by') OR NOT ({BINDING.replace("name", "from_name")} OR {BINDING.replace("name", "to_name")}) AS counts FROM coupled)"""


def meanings(refs: str) -> str:
    """resolutions of refs(ref): a dotted match, a file by alias or relative path, a file of that base name."""
    return f"""
way1 AS (SELECT ref, x.*, 1 AS way FROM {refs} JOIN entities x ON {m("ref", "x.name")} QUALIFY row_number() OVER (PARTITION BY ref ORDER BY file_path, start_line, id) = 1),
rest AS (SELECT ref FROM {refs} WHERE ref NOT IN (SELECT ref FROM way1) AND regexp_matches(ref, '^[@~].*/|^\\.\\.?/')),
asked AS (SELECT ref, 0 AS nth, 'src/' || substr(ref, 3) AS imp FROM rest WHERE starts_with(ref, '@/') UNION ALL SELECT ref, 1, ref FROM rest),
way2 AS (SELECT ref, x.*, 2 AS way FROM asked JOIN entities x ON {named("imp", "x.file_path")} QUALIFY row_number() OVER (PARTITION BY ref ORDER BY nth, file_path, start_line, id) = 1),
way3 AS (
  SELECT ref, x.*, 3 AS way FROM rest JOIN entities x ON lower(regexp_replace({BASE}, '[-_]', '', 'g')) = lower(regexp_replace(list_last(string_split(ref, '/')), '[-_]', '', 'g')) WHERE ref NOT IN (SELECT ref FROM way2)
  QUALIFY row_number() OVER (PARTITION BY ref ORDER BY file_path, start_line, id) = 1),
meaning AS (SELECT r.ref, x.name, x.file_path, x.way FROM {refs} r LEFT JOIN (SELECT * FROM way1 UNION ALL SELECT * FROM way2 UNION ALL SELECT * FROM way3) x ON x.ref = r.ref)"""


def view(top: int) -> tuple[str, ...]:
    return (
        DEGREES,
        f"""shown AS (SELECT * FROM degrees WHERE NOT {HIDDEN} ORDER BY incoming_count DESC, file_path, start_line, id LIMIT {top}),
asks AS (SELECT DISTINCT src_id, kind, lower(target) AS t FROM edges WHERE src_id IN (SELECT id FROM shown) UNION SELECT src_id, kind, lower(s.name) || '.' || lower(target) FROM edges JOIN shown s ON s.id = src_id WHERE kind = 'contains'),
bare AS (
  SELECT t, x.id AS dst_id, {PACKAGE} = string_split(t, '.')[-2] AS same, bool_or(same) OVER (PARTITION BY t) AS any_same, count(*) OVER (PARTITION BY t) AS n
  FROM (SELECT DISTINCT t FROM asks WHERE kind = 'calls' AND contains(t, '.') AND t NOT IN (SELECT lower(name) FROM entities)) JOIN entities x ON lower(x.name) = {last("t")}),
links AS (
  SELECT DISTINCT src_id, dst_id, kind FROM (
    SELECT src_id, kind, x.id AS dst_id FROM asks JOIN entities x ON lower(x.name) = t
    UNION ALL SELECT src_id, kind, dst_id FROM asks JOIN bare USING (t) WHERE kind = 'calls' AND CASE WHEN any_same THEN same ELSE n = 1 END)
  WHERE dst_id IN (SELECT id FROM shown) AND (kind <> 'calls' OR src_id <> dst_id))""",
    )


CRITICAL = """
cn AS MATERIALIZED (SELECT lower(name) AS node, file_path, list_transform(calls, lambda x: lower(x)) AS calls FROM entities QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY file_path DESC, start_line DESC, id DESC) = 1),
co AS MATERIALIZED (SELECT a, b, min(pos) AS pos FROM (SELECT node AS a, unnest(calls) AS b, generate_subscripts(calls, 1) AS pos FROM cn) WHERE b IN (SELECT node FROM cn) GROUP BY ALL),
cs AS (SELECT node AS source FROM cn ORDER BY len(calls) DESC, node LIMIT (SELECT least(greatest(50, count(*) // 10), count(*)) FROM cn)),
tree(source, node, path, nodes) USING KEY (source, node) AS (
  SELECT source, source, CAST([] AS BIGINT[]), [source] FROM cs
  UNION SELECT source, node, path, nodes FROM (
    SELECT t.source, co.b AS node, list_append(t.path, co.pos) AS path, list_append(t.nodes, co.b) AS nodes, row_number() OVER (PARTITION BY t.source, co.b ORDER BY list_append(t.path, co.pos)) AS rn
    FROM tree t JOIN co ON co.a = t.node WHERE NOT EXISTS (SELECT 1 FROM recurring.tree r WHERE r.source = t.source AND r.node = co.b)) WHERE rn = 1),
critical AS (
  SELECT file_path, count(*) AS score FROM (SELECT unnest(nodes[2:-2]) AS v FROM tree WHERE len(nodes) > 2) JOIN cn ON cn.node = v GROUP BY file_path ORDER BY score DESC, file_path LIMIT 10)"""

TOKENS = """
total AS (SELECT count(*) AS n_docs FROM documents),
words AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS n FROM words WHERE length(term) >= 2 GROUP BY ALL),
idf AS (SELECT term, count(*) AS df, round(ln((any_value(n_docs) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM tf, total GROUP BY term),
weighted AS (SELECT id, term, round((1 + ln(n)) * idf, 6) AS w FROM tf JOIN idf USING (term))"""


def bucket(term: str) -> str:
    return f"(CAST('0x' || substr(md5({term}), 1, 8) AS BIGINT) % 768)"


def sign(term: str) -> str:
    return f"(CASE WHEN CAST('0x' || substr(md5({term}), 9, 8) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"


ARMS = f"""
q0 AS (SELECT unnest(regexp_split_to_array('{" ".join([SEARCH] * 3)}', '[^a-z0-9_]+')) AS term),
q AS (SELECT term, count(*) AS n FROM q0 WHERE length(term) >= 2 GROUP BY term),
qb AS (SELECT {bucket("term")} AS b, sum(round((1 + ln(q.n)) * coalesce(idf, 1), 6)) AS qw FROM q LEFT JOIN idf USING (term) GROUP BY 1),
db AS (SELECT id, {bucket("term")} AS b, sum(w) AS w FROM weighted WHERE term IN (SELECT term FROM q) GROUP BY ALL),
lexical AS (SELECT id, round(sum(round(w * qw, 6)), 4) AS score FROM db JOIN qb USING (b) GROUP BY id),
probe AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 7),
semantic AS (SELECT vec_id AS id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(v, v))), 6) AS score FROM embeddings, probe),
lexical_90 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM lexical QUALIFY r <= 90),
semantic_90 AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM semantic QUALIFY r <= 90),
fused AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM lexical_90 UNION ALL SELECT * FROM semantic_90) GROUP BY id)"""

HITS = "hits AS (SELECT id, name, entity_type, file_path, calls, round(1.0::DOUBLE / (1 + start_line % 97), 6) AS score FROM entities)"

TEXTS = """
texts AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 13 = 0 THEN 'Unknown' WHEN doc_id % 4 = 0 THEN 'Events.user_' || CAST(1 + doc_id % 40 AS VARCHAR) WHEN doc_id % 4 = 1 THEN 'format_NATION_' || CAST(doc_id % 25 AS VARCHAR) ELSE 'doc_' || CAST(doc_id AS VARCHAR) END AS name,
    CASE WHEN doc_id % 11 = 0 THEN '/tmp/' || CAST(doc_id AS VARCHAR) ELSE source || '/' || CAST(doc_id AS VARCHAR) END AS file_path,
    CASE WHEN doc_id % 5 = 0 THEN 'variable' WHEN doc_id % 5 = 1 THEN 'constant' ELSE 'function' END AS entity_type, text AS content FROM documents)"""

def versions(name: str, before: str | None) -> str:
    cut = f"WHERE ts < TIMESTAMP '{before}'" if before else ""
    half = "CAST(sum(CAST('0x' || substr(line, {0}, 12) AS HUGEINT)) AS VARCHAR)"
    return f"{name} AS (SELECT 'users/' || CAST(user_id AS VARCHAR) AS path, upper(sha256(CAST(count(*) AS VARCHAR) || ':' || {half.format(1)} || ':' || {half.format(13)})) AS sha256 FROM (SELECT user_id, md5(CAST(event_id AS VARCHAR) || ':' || event_type) AS line FROM events {cut}) GROUP BY user_id)"


LAYER = "CASE " + " ".join(f"WHEN list_has_any(string_split(lower(file_path), '/'), {some!r}) THEN '{name}'" for name, some in LAYERS.items()) + " ELSE 'other' END"


def e(body: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([ENTITIES, *more])} {body}"


#: What becomes of the files of the trees: language and why they are skipped.
FATES = {
    "one/src/{n}.py": ("python", None), "two/src/{n}.py": ("python", None), "one/node_modules/lib/{n}.js": ("javascript", "default"), "one/lib/{n}.min.js": ("javascript", "default"), "one/.hidden/{n}.py": ("python", "dot_folder"), "one/docs/{n}.txt": (None, "extension"),
    "one/gen/{n}.py": ("python", "gitignore"), "one/src/skip_{n}.py": ("python", "project_ignore"), "one/src/{n}.tmp.py": ("python", "gitignore"), "one/attic/deep/{n}.go": ("go", "project_ignore"), "two/src/a b+c/{n}.ts": ("typescript", None),
}
assert list(FATES) == TREE


def _or_null(text: str | None) -> str:
    return "NULL" if text is None else quoted(text)


def described(name: str, title: str, column: str, rows: str) -> str:
    """A table of names and counts as text, most first."""
    return f"{name} AS (SELECT '## {title}' || chr(10) || chr(10) || '| {column} | Count |' || chr(10) || '|---|---|' || chr(10) || coalesce(string_agg('| ' || k || ' | ' || CAST(n AS VARCHAR) || ' |', chr(10) ORDER BY n DESC, k), '') AS body FROM ({rows}))"


ORACLE: dict[str, str] = {
    "entity_filter": e("SELECT id, name, file_path FROM entities WHERE entity_type = 'method'"),
    "path_prefix": e("SELECT name, file_path FROM entities WHERE starts_with(file_path, 'src/services/building/')"),
    "keyword_contains": e(f"SELECT id, name, file_path, 1.0::DOUBLE AS score FROM entities WHERE (contains(lower(name), 'widget') OR contains(lower(content), 'widget')) AND NOT {TEMPORARY} ORDER BY file_path, id LIMIT 40"),
    "point_lookup": e(f"SELECT id, name, array_to_string(is_a, ',') AS is_a FROM entities WHERE id = '{hashlib.sha256(KNOWN.encode()).hexdigest()}'"),
    "keyset_page": e("SELECT id, name FROM entities WHERE id > '8' ORDER BY id LIMIT 25"),
    "chunk_ids": e("SELECT id, CAST(CAST('0x' || substr(id, 1, 16) AS UBIGINT) AS VARCHAR) AS number, CAST(strlen(content) AS BIGINT) AS bytes FROM entities WHERE strlen(content) >= 30 OR entity_type = 'module'"),
    "noise_filter": e(f"SELECT {NOISE} AS noise, {BINDING} AS binding, {HIDDEN} AS hidden, count(*) AS n FROM entities GROUP BY ALL"),
    "glob_match": e("SELECT file_path, count(*) AS n FROM entities WHERE file_path SIMILAR TO 'src/(.*/)?NATION_1[^/]_[^/]\\.[^/]*' OR file_path SIMILAR TO 'src/lib/[^/]*/econ[^/]*\\.js' GROUP BY file_path"),
    "import_paths": e("SELECT name, file_path FROM entities WHERE ends_with(regexp_replace(file_path, '\\.(ts|tsx|js|jsx)$', ''), 'lib/Brand_7/economy')"),
    "file_stems": e("SELECT lower(regexp_replace(regexp_replace(list_last(string_split(file_path, '/')), '\\.[^.]+$', ''), '[-_]', '', 'g')) AS stem, array_to_string(string_split(file_path, '/')[-3:-2], '/') AS folder, count(*) AS n FROM entities GROUP BY ALL"),
    "collection_names": e("SELECT DISTINCT substr(ltrim(regexp_replace(lower(file_path), '[^a-z0-9_]', '_', 'g'), '_'), 1, 60) AS collection, regexp_matches(file_path, '_test$|_test_') AS test FROM entities"),
    "entity_types": e("SELECT entity_type, count(*) AS n FROM entities GROUP BY 1"),
    "languages": e("SELECT language, count(*) AS n FROM entities GROUP BY 1"),
    "file_languages": e("SELECT CASE list_last(string_split(file_path, '.')) WHEN 'ex' THEN 'elixir' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'tsx' WHEN 'rb' THEN 'ruby' ELSE 'unknown' END AS language, count(DISTINCT file_path) AS n FROM entities GROUP BY 1"),
    "layer_counts": e(f"SELECT {LAYER} AS layer, count(*) AS n FROM entities GROUP BY 1"),
    "edge_totals": e("SELECT kind, count(*) AS n FROM edges GROUP BY kind"),
    "fan_in": e(f"SELECT {last('target')} AS callee, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1 ORDER BY n DESC, callee LIMIT 15"),
    "fan_in_exact": e("SELECT target AS callee, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1 ORDER BY n DESC, callee LIMIT 15"),
    "fan_out": e("SELECT id, name, CAST(len(calls) AS BIGINT) AS n FROM entities ORDER BY n DESC, name, id LIMIT 15"),
    "top_connected": e(f"SELECT name, CAST(max(len(calls) + len(contains) + coalesce(fan, 0)) AS BIGINT) AS degree FROM entities LEFT JOIN (SELECT {last('target')} AS callee, count(*) AS fan FROM edges WHERE kind = 'calls' GROUP BY 1) ON lower(name) = callee WHERE NOT {NOISE} AND length(name) > 2 GROUP BY name ORDER BY degree DESC, name LIMIT 10"),
    "degrees": e("SELECT id, name, outgoing_degree, incoming_count FROM degrees", DEGREES),
    "dashboard_top": e("SELECT id, name, outgoing_degree + incoming_count AS total FROM degrees ORDER BY total DESC, id LIMIT 5", DEGREES),
    "type_page": e("SELECT entity_type, count(*) AS n FROM (SELECT * FROM entities ORDER BY id LIMIT 200) GROUP BY 1"),
    "module_table": e("SELECT name, file_path, CAST(len(calls) AS BIGINT) AS n_calls, CAST(len(contains) AS BIGINT) AS n_children, CAST(len(calls) + len(contains) AS BIGINT) AS n FROM entities WHERE entity_type = 'module' ORDER BY n DESC, name, file_path LIMIT 20"),
    "index_status": e("SELECT count(*) AS chunks, count(DISTINCT file_path) AS files, count(DISTINCT language) AS languages, count(*) > 0 AS ready FROM entities"),
    "latency_histogram": "SELECT CAST(CASE " + " ".join(f"WHEN value <= {b} THEN {k}" for k, b in enumerate(BOUNDS)) + f" ELSE {len(BOUNDS)} END AS INTEGER) AS bucket, count(*) AS n FROM events GROUP BY 1",
    "latency_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, min(value) FILTER (k >= ceil(0.5 * n)) AS p50, min(value) FILTER (k >= ceil(0.95 * n)) AS p95, min(value) FILTER (k >= ceil(0.99 * n)) AS p99 FROM r GROUP BY event_type",
    "resolve_calls": e("SELECT src_id, pos, target, dst_id, CAST(strategy AS BIGINT) AS strategy FROM resolved", RESOLVED),
    "importers": e("SELECT id, name, file_path FROM entities WHERE len(list_filter(is_a, lambda x: contains(lower(x), 'ation_1'))) > 0"),
    "callees": e(f"SELECT pos, target, dst_name, dst_file, dst_id IS NOT NULL AS resolved FROM resolved WHERE src_id = (SELECT id FROM entities WHERE {m('name', repr(ROOT))} ORDER BY file_path, start_line, id LIMIT 1) AND pos < 20", RESOLVED),
    "dead_entities": e("SELECT id, name, file_path FROM dead", DEAD),
    "dead_by_suffix": e(f"SELECT id, name, file_path FROM dead WHERE {last('name')} NOT IN (SELECT u FROM used)", DEAD),
    "dead_summary": e(f"SELECT (SELECT count(*) FROM dead WHERE starts_with(file_path, 'src/services/')) AS dead_count, count(*) FILTER ({FUNCTION} AND coalesce(visibility, 'public') = 'public') AS total_public, bool_or(language IN {among(WEB)}) AS unsure FROM entities", DEAD),
    "port_implementors": e("SELECT DISTINCT p.name AS port, x.name, x.file_path FROM entities p JOIN edges ON kind = 'is_a' AND lower(target) = lower(p.name) JOIN entities x ON x.id = src_id WHERE p.entity_type IN ('interface', 'struct')"),
    "hotspots": e(f"SELECT count(*) AS dead, count(DISTINCT file_path) AS files FROM entities WHERE {FUNCTION} AND name NOT IN (SELECT target FROM edges WHERE kind = 'calls') AND list_last(string_split(name, '.')) NOT IN (SELECT target FROM edges WHERE kind = 'calls')"),
    "snapshot_diff": f"WITH {versions('a', CUT)}, {versions('b', None)} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.sha256 IS DISTINCT FROM b.sha256",
    "changed_files": f"WITH {versions('a', '2024-01-01 06:00:00')}, {versions('b', '2024-01-01 12:00:00')} SELECT b.path FROM b LEFT JOIN a USING (path) WHERE a.sha256 IS DISTINCT FROM b.sha256",
    "stale_files": f"WITH {versions('a', None)}, {versions('b', '2024-01-01 06:00:00')} SELECT path FROM a WHERE path NOT IN (SELECT path FROM b)",
    **{f"impact_d{d}": e("SELECT CAST(depth AS BIGINT) AS depth, array_to_string(p, ' > ') AS path, name, file_path FROM walk", *impact(ROOT, d), recursive=True) for d in (1, 2, 3)},
    "impact_files": e("SELECT file_path, count(*) AS n_paths, CAST(min(depth) AS BIGINT) AS nearest FROM walk GROUP BY 1", *impact(ROOT, 3), recursive=True),
    "impact_refined": e("SELECT CAST(depth AS BIGINT) AS depth, array_to_string(p, ' > ') AS path, name, file_path FROM walk", *impact("Lib.red_widget_0", 2), recursive=True),
    "community": e("SELECT file_path, CAST(count(*) FILTER (counts) AS BIGINT) AS coupling_score, count(DISTINCT direction) FILTER (counts) AS n_directions FROM counted GROUP BY 1 ORDER BY coupling_score DESC, file_path LIMIT 10", COUPLED),
    "community_connections": e("SELECT * FROM counted", COUPLED),
    "community_grouped": e("SELECT file_path, direction, array_to_string(list(from_name || ' -> ' || to_name ORDER BY from_name, to_name)[1:3], '; ') AS shown, greatest(count(*) - 3, 0) AS more FROM counted WHERE counts GROUP BY 1, 2", COUPLED),
    "hierarchy_parents": e("SELECT ref, name, file_path, CAST(way AS BIGINT) AS way FROM meaning", f"refs AS (SELECT DISTINCT unnest(is_a) AS ref FROM entities WHERE id = '{hashlib.sha256(KNOWN.encode()).hexdigest()}')", meanings("refs")),
    "hierarchy_children": e(
        """SELECT coalesce(name, ref) AS name, coalesce(file_path, '') AS file_path, way IS NOT NULL AS resolved FROM meaning JOIN refs USING (ref) WHERE NOT tag OR way IS NOT NULL
UNION SELECT y.name, y.file_path, true FROM entities y JOIN one ON y.file_path = one.file_path AND y.entity_type IN ('function', 'method') AND y.start_line > one.start_line AND y.end_line <= one.end_line AND y.name <> one.name""",
        f"one AS (SELECT * FROM entities WHERE name = '{PAGE}')", "refs AS (SELECT DISTINCT unnest(contains) AS ref, false AS tag FROM one UNION SELECT DISTINCT c, true FROM (SELECT unnest(calls) AS c FROM one) WHERE regexp_matches(c, '^[A-Z][^.]*$'))", meanings("refs"),
    ),
    "nested_ranges": e("SELECT a.id AS parent_id, b.id AS child_id FROM entities a JOIN entities b ON a.file_path = b.file_path AND b.start_line > a.start_line AND b.end_line <= a.end_line AND a.name <> b.name"),
    "view_links": e("SELECT * FROM links", *view(2000)),
    "term_frequencies": f"WITH {TOKENS} SELECT * FROM tf",
    "idf": f"WITH {TOKENS} SELECT * FROM idf",
    "sparse_vectors": f"WITH {TOKENS} SELECT id, {bucket('term')} AS bucket, round(round(sum(w), 6), 3) AS w FROM weighted GROUP BY ALL",
    "dense_hash": f"WITH {TOKENS}, s AS (SELECT id, {bucket('term')} AS bucket, round(sum(w * {sign('term')}), 6) AS s FROM weighted GROUP BY ALL) SELECT id, bucket, round(CASE WHEN norm > 0 THEN s / norm ELSE 0 END, 3) + 0.0::DOUBLE AS x FROM (SELECT *, sqrt(sum(round(s * s, 6)) OVER (PARTITION BY id)) AS norm FROM s)",
    "text_prepare": e("SELECT id, md5(CASE WHEN strlen(whole) <= 4000 THEN whole ELSE substr(whole, 1, length(head) + (4000 - length(head)) // 2) END) AS embed, md5(name || ' ' || name || ' ' || name || ' ' || array_to_string(parameters, ' ') || ' ' || array_to_string(calls, ' ') || ' ' || content) AS keywords FROM (SELECT *, 'File: ' || file_path || chr(10) || 'Type: ' || entity_type || chr(10) || 'Name: ' || name || chr(10) AS head, head || content AS whole FROM entities)"),
    "sparse_topk": f"WITH {TOKENS}, {ARMS} SELECT id, score FROM lexical ORDER BY score DESC, id LIMIT 20",
    "dense_topk": f"WITH {TOKENS}, {ARMS} SELECT id, score FROM semantic ORDER BY score DESC, id LIMIT 20",
    "filtered_dense": f"WITH {TOKENS}, {ARMS} SELECT id, score FROM semantic WHERE label = 3 ORDER BY score DESC, id LIMIT 10",
    "rrf": f"WITH {TOKENS}, {ARMS} SELECT id, score FROM fused",
    "dedup_best": e("SELECT id, name, entity_type, score FROM hits QUALIFY row_number() OVER (PARTITION BY name, entity_type ORDER BY score DESC, id) = 1", HITS),
    "graph_boost": e(
        "SELECT id, h.name, boost, round(score + boost, 6) AS score FROM (SELECT h.*, round(CASE WHEN list_contains(seeds, h.name) THEN 0.1::DOUBLE WHEN incoming > 0 THEN least(0.02::DOUBLE * incoming, 0.1::DOUBLE) ELSE least(0.03::DOUBLE * len(list_filter(coalesce(c, []), lambda x: list_contains(seeds, x))), 0.1::DOUBLE) END, 6) AS boost FROM f h LEFT JOIN (SELECT name, max(incoming_count) AS incoming, first(calls ORDER BY len(calls) DESC, calls DESC) AS c FROM degrees GROUP BY name) g ON g.name = h.name, seeds) h",
        DEGREES, HITS, "f AS (SELECT * FROM hits WHERE entity_type = 'function')", "seeds AS (SELECT list(DISTINCT name) AS seeds FROM (SELECT name FROM f ORDER BY score DESC, id LIMIT 5))",
    ),
    "type_boost": e("SELECT id, round(CASE WHEN entity_type IN ('variable', 'constant') THEN score * 1.15::DOUBLE ELSE score END, 6) AS score FROM hits", HITS),
    "rerank": e(
        f"SELECT id, relevance, round(score * (1 + 0.3::DOUBLE * least(relevance / 10.0::DOUBLE, 1)), 6) AS score FROM (SELECT h.id, h.score, CAST(CASE WHEN {last('h.name')} IN ('user_2', 'user_7') THEN 100 ELSE 5 * len(list_filter(c, lambda x: {last('x')} IN ('user_2', 'user_7'))) + 2 * incoming END AS BIGINT) AS relevance FROM hits h JOIN (SELECT name, max(incoming_count) AS incoming, first(calls ORDER BY len(calls) DESC, calls DESC) AS c FROM degrees GROUP BY name) g ON g.name = h.name)",
        DEGREES, HITS,
    ),
    "hybrid_search": e(
        "SELECT id, name, round(CASE WHEN entity_type IN ('variable', 'constant') THEN boosted * 1.15::DOUBLE ELSE boosted END, 6) AS score FROM boosted WHERE NOT starts_with(file_path, '/tmp/') ORDER BY score DESC, id LIMIT 10",
        DEGREES, TOKENS, ARMS, TEXTS, """top30 AS (SELECT id, score FROM fused ORDER BY score DESC, id LIMIT 30),
one_each AS (SELECT id, name, file_path, entity_type, score FROM top30 JOIN texts USING (id) WHERE name <> 'Unknown' QUALIFY row_number() OVER (PARTITION BY name, entity_type ORDER BY score DESC, id) = 1),
seeds AS (SELECT list(DISTINCT name) AS seeds FROM (SELECT name FROM one_each ORDER BY score DESC, id LIMIT 5)),
by_name AS (SELECT name AS g_name, max(incoming_count) AS incoming, first(calls ORDER BY len(calls) DESC, calls DESC) AS c FROM degrees GROUP BY name),
boosted AS (
  SELECT id, name, file_path, entity_type, round(score + round(CASE WHEN list_contains(seeds, name) THEN 0.1::DOUBLE WHEN incoming > 0 THEN least(0.02::DOUBLE * incoming, 0.1::DOUBLE)
    ELSE least(0.03::DOUBLE * len(list_filter(coalesce(c, []), lambda x: list_contains(seeds, x))), 0.1::DOUBLE) END, 6), 6) AS boosted FROM one_each LEFT JOIN by_name ON g_name = name, seeds)""",
    ),
    "vocab_rebuild": f"WITH {TOKENS.replace('FROM documents', 'FROM left_docs').replace('total AS', 'left_docs AS (SELECT * FROM documents WHERE doc_id % 3 <> 0), total AS', 1)} SELECT * FROM idf",
    "ranking_reasons": e(
        f"SELECT id, relevance, CASE WHEN relevance >= 100 THEN 'named' WHEN relevance > 0 THEN 'related' ELSE 'text' END AS reason FROM (SELECT h.id, CAST(CASE WHEN {last('h.name')} = 'user_3' THEN 100 ELSE 5 * len(list_filter(c, lambda x: {last('x')} = 'user_3')) + 2 * incoming END AS BIGINT) AS relevance FROM hits h JOIN (SELECT name, max(incoming_count) AS incoming, first(calls ORDER BY len(calls) DESC, calls DESC) AS c FROM degrees GROUP BY name) g ON g.name = h.name WHERE entity_type = 'function')",
        DEGREES, HITS,
    ),
    "startup_project": e("SELECT string_split(file_path, '/')[2] AS project, count(*) AS n FROM entities GROUP BY 1 ORDER BY n DESC, project LIMIT 1"),
    "late_data": """WITH rows AS (SELECT ts, event_id % 10 = 0 AS late, unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS start FROM events WHERE event_type = 'error'),
marks AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 1 HOUR AS first_mark, max(ts) - INTERVAL 1 HOUR AS last_mark FROM rows)
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM rows, marks WHERE (NOT late OR start + INTERVAL 12 HOURS > first_mark) AND start + INTERVAL 12 HOURS <= last_mark GROUP BY 1""",
    "reply_rows": e("SELECT id, CAST(to_json({'name': name, 'file_path': file_path, 'entity_type': entity_type, 'start_line': start_line, 'calls': calls[1:10]}) AS VARCHAR) AS json FROM entities"),
    "relations": e(
        "SELECT src_id, kind, pos, target, dst_id FROM related",
        RESOLVED.replace("kind = 'calls'", "kind IN ('is_a', 'contains')").replace("resolved AS", "related AS").replace("SELECT src_id, pos,", "SELECT src_id, kind, pos,").replace("PARTITION BY src_id, pos", "PARTITION BY src_id, kind, pos"),
    ),
    "syntax_noise": f"SELECT doc_id AS id, CAST(len(w) AS BIGINT) AS n, CAST(len(list_filter(w, lambda x: x NOT IN {NOISE_WORDS})) AS BIGINT) AS kept FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)",
    "upsert_state": e("SELECT id, CASE WHEN ends_with(file_path, '.ex') THEN upper(name) ELSE name END AS name, file_path FROM entities"),
    "purge_state": e("SELECT file_path, count(*) AS n FROM entities WHERE NOT starts_with(file_path, 'src/lib/') GROUP BY 1"),
    "debounce_sessions": "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k",
    "stream_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL",
    "dedup_stream": "SELECT DISTINCT user_id, event_type FROM events",
    "callers": e(
        f"""SELECT id, name, file_path, kind FROM refined r WHERE kind <> 'module' OR file_path NOT IN (SELECT file_path FROM refined WHERE kind IN ('function', 'method'))""",
        f"""asked AS (SELECT 'Lib.red_widget_0' AS q),
calling AS (SELECT DISTINCT src_id FROM edges, asked WHERE kind = 'calls' AND {m('target', 'q')}),
importing AS (SELECT DISTINCT src_id FROM edges, asked WHERE kind = 'is_a' AND contains(lower(target), lower(q))),
both_ AS (SELECT x.*, CASE WHEN id IN (SELECT src_id FROM calling) THEN 1 ELSE 2 END AS rank FROM entities x WHERE id IN (SELECT src_id FROM calling UNION SELECT src_id FROM importing) ORDER BY rank, file_path, start_line, id LIMIT 20),
inner_ AS (
  SELECT b.id AS b_id, y.id, y.name, y.entity_type FROM both_ b JOIN entities y ON y.file_path = b.file_path AND y.entity_type IN ('function', 'method') AND y.id IN (SELECT src_id FROM calling) WHERE b.entity_type NOT IN ('function', 'method')
  QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY (b.end_line > b.start_line AND y.start_line >= b.start_line AND y.end_line <= b.end_line) DESC, y.start_line, y.id) = 1),
refined AS (SELECT DISTINCT coalesce(i.id, b.id) AS id, coalesce(i.name, b.name) AS name, b.file_path, coalesce(i.entity_type, b.entity_type) AS kind FROM both_ b LEFT JOIN inner_ i ON b_id = b.id)""",
    ),
    "entity_resolution": e(
        "SELECT wanted, CAST(strategy AS BIGINT) AS strategy, id, name FROM tried WHERE strategy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY wanted ORDER BY strategy, file_path, start_line, id) = 1",
        f"tried AS (SELECT wanted, x.*, CASE WHEN {m('name', 'wanted')} THEN 1 WHEN lower(regexp_replace(regexp_replace(list_last(string_split(file_path, '/')), '\\.[^.]+$', ''), '[-_]', '', 'g')) = replace(replace(lower(wanted), '_', ''), '-', '') THEN 2 WHEN contains(lower(name), lower(wanted)) OR contains(lower(wanted), lower(name)) THEN 3 END AS strategy FROM entities x, (SELECT unnest(['user_5', 'economy', 'plier#00000000', 'no such thing']) AS wanted))",
    ),
    "definition": e("SELECT id, name, file_path FROM entities WHERE name = 'Start' ORDER BY file_path, start_line, id LIMIT 1"),
    "path_rules": e(f"SELECT DISTINCT file_path, {TEMPORARY} AS temporary, {TESTED} AS test, {PACKAGE} AS package, CASE WHEN starts_with(file_path, 'src/web/') THEN substr(file_path, 9) ELSE file_path END AS within FROM entities"),
    "conventions": e(f"SELECT id, name, file_path FROM entities WHERE {CONVENTION}"),
    "entry_points": e(f"SELECT id, name, file_path FROM entities WHERE {ENTRY}"),
    "word_references": e("SELECT id, name FROM entities WHERE regexp_matches(content, '\\b' || regexp_escape(list_last(string_split(name, '.'))) || '\\b')"),
    "integers": "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS a, coalesce(TRY_CAST(nullif(regexp_extract(p_name, '^([+-]?[0-9]+)', 1), '') AS BIGINT), 5) AS b, -CAST(p_size AS BIGINT) AS c FROM part",
    "filtered_count": e("SELECT count(*) AS n FROM entities WHERE entity_type = 'method'"),
    "type_shares": e("SELECT entity_type, count(*) AS n, CAST(least(round(count(*) / (SELECT count(*) FROM entities) * 100), 100) AS BIGINT) AS percent FROM entities GROUP BY 1"),
    "graph_stats": e(
        f"""SELECT 'total' AS section, 'entities' AS name, count(*) AS n FROM entities UNION ALL SELECT 'type', entity_type, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM entities GROUP BY 2
UNION ALL SELECT 'edges', kind, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'layer', {LAYER}, count(*) FROM entities GROUP BY 2 UNION ALL SELECT 'critical', file_path, score FROM critical
UNION ALL SELECT 'connected', name, degree FROM (SELECT name, CAST(max(len(calls) + len(contains) + coalesce(fan, 0)) AS BIGINT) AS degree FROM entities LEFT JOIN (SELECT {last('target')} AS callee, count(*) AS fan FROM edges WHERE kind = 'calls' GROUP BY 1) ON lower(name) = callee WHERE NOT {NOISE} AND length(name) > 2 GROUP BY name ORDER BY degree DESC, name LIMIT 10)""",
        CRITICAL, recursive=True,
    ),
    "overview_documents": e(
        """SELECT 'overview' AS document, head || chr(10) || chr(10) || (SELECT body FROM t1) || chr(10) || chr(10) || (SELECT body FROM t2) AS body FROM heading
UNION ALL SELECT 'architecture', (SELECT body FROM t3) || chr(10) || chr(10) || (SELECT body FROM t4) UNION ALL SELECT 'hotspots', (SELECT body FROM t5) || chr(10) || chr(10) || (SELECT body FROM t6) || chr(10) || chr(10) || (SELECT body FROM t7)""",
        DEAD, "heading AS (SELECT '# Project Overview' || chr(10) || chr(10) || '**Project:** tables' || chr(10) || '**Files indexed:** ' || CAST(count(DISTINCT file_path) AS VARCHAR) || chr(10) || '**Total chunks:** ' || CAST(count(*) AS VARCHAR) AS head FROM entities)",
        described("t1", "Language Breakdown", "Language", "SELECT language AS k, count(*) AS n FROM entities GROUP BY 1"), described("t2", "Entity Types", "Type", "SELECT entity_type AS k, count(*) AS n FROM entities GROUP BY 1"),
        described("t3", "Modules", "Module", "SELECT name AS k, len(calls) + len(contains) AS n FROM entities WHERE entity_type = 'module' ORDER BY n DESC, name, file_path LIMIT 20"), described("t4", "Layers", "Layer", f"SELECT {LAYER} AS k, count(*) AS n FROM entities GROUP BY 1"),
        described("t5", "Fan-in", "Callee", "SELECT target AS k, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1 ORDER BY n DESC, k LIMIT 15"),
        described("t6", "Fan-out", "Entity", "SELECT k, max(n) AS n FROM (SELECT name AS k, len(calls) AS n, id FROM entities ORDER BY n DESC, name, id LIMIT 15) GROUP BY k"),
        described("t7", "Dead code", "File", "SELECT file_path AS k, count(*) AS n FROM unused GROUP BY 1 ORDER BY n DESC, k LIMIT 15"),
    ),
    "metrics_export": "WITH g AS (SELECT event_type AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS VARCHAR) AS s FROM events GROUP BY 1) " + " UNION ALL ".join(
        [f"SELECT 'event_duration_ms_bucket{{event_type=\"' || event_type || '\",le=\"{b}\"}} ' || CAST(count(*) FILTER (value <= {b}) AS VARCHAR) AS line FROM events GROUP BY event_type" for b in BOUNDS]
        + ["SELECT 'event_duration_ms_bucket{event_type=\"' || k || '\",le=\"+Inf\"} ' || CAST(n AS VARCHAR) FROM g", "SELECT 'event_duration_ms_sum{event_type=\"' || k || '\"} ' || s FROM g", "SELECT 'event_duration_ms_count{event_type=\"' || k || '\"} ' || CAST(n AS VARCHAR) FROM g"]
    ),
    "implementors_of": e(f"SELECT DISTINCT '{STORE}' AS port, x.name, x.file_path FROM edges JOIN entities x ON x.id = src_id WHERE kind = 'is_a' AND lower(target) = lower('{STORE}')"),
    "hierarchy_members": e("SELECT DISTINCT coalesce(name, ref) AS name, coalesce(file_path, '') AS file_path, way IS NOT NULL AS resolved FROM meaning", f"refs AS (SELECT DISTINCT unnest(contains) AS ref FROM entities WHERE name = '{STORE}')", meanings("refs")),
    "name_resolution": e("SELECT ref, name, file_path, CAST(way AS BIGINT) AS way FROM meaning", f"refs(ref) AS (VALUES {', '.join('(' + quoted(r) + ')' for r in REFS)})", meanings("refs")),
    "view_nodes": e(f"SELECT id, name, incoming_count, {FOLDERS} AS package FROM shown", *view(500)),
    "view_filtered": e(f"SELECT src_id, dst_id, kind FROM links WHERE kind = 'calls' AND src_id IN (SELECT id FROM kept) AND dst_id IN (SELECT id FROM kept) AND (src_id IN (SELECT id FROM kept WHERE {FOLDERS} = 'web/handlers') OR dst_id IN (SELECT id FROM kept WHERE {FOLDERS} = 'web/handlers'))", *view(2000), "kept AS (SELECT * FROM shown WHERE incoming_count + len(calls) >= 3 AND entity_type <> 'module')"),
    "critical_files": e("SELECT * FROM critical", CRITICAL, recursive=True),
    "dense_fallback": f"WITH {TOKENS}, {ARMS} SELECT id, score FROM semantic ORDER BY score DESC, id LIMIT 20",
    "keyword_fallback": f"WITH {TEXTS}, found AS (SELECT * FROM texts WHERE (contains(lower(name), 'ormat_nation_1') OR contains(lower(coalesce(content, '')), 'ormat_nation_1')) AND NOT starts_with(file_path, '/tmp/') ORDER BY file_path, id LIMIT 10) SELECT id, name, entity_type, 1.0::DOUBLE AS score FROM found QUALIFY row_number() OVER (PARTITION BY name, entity_type ORDER BY id) = 1",
    "embed_texts": f"WITH {TOKENS} SELECT doc_id AS id, CASE WHEN length(coalesce(text, '')) % 3 = 0 THEN 'tfidf' ELSE 'model' END AS way, CASE WHEN length(coalesce(text, '')) % 3 <> 0 OR doc_id IN (SELECT id FROM tf) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm FROM documents",
    "query_vectors": f"WITH {TOKENS}, {ARMS} SELECT * FROM (VALUES ('model', 1, 1.0::DOUBLE), ('tfidf', (SELECT count(DISTINCT b) FROM qb), 1.0::DOUBLE), ('zeros', 0, 0.0::DOUBLE)) AS t(way, n, square)",
    "change_stream": """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 2 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WHERE event_type <> 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, 'reindex' AS change, strftime(max(ts) + INTERVAL 2 HOURS, '%Y-%m-%d %H:%M:%S') AS moment FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type <> 'error')
UNION ALL SELECT user_id, 'delete', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM events WHERE event_type = 'error'""",
    "delete_state": e("SELECT id, name, file_path FROM entities WHERE NOT contains(name, '7')"),
    "extract_sources": f"""WITH k AS (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier), rows AS (
  SELECT k, 'class' AS entity_type, 'Shop' || k AS name, 3 AS start_line, 5 AS end_line, 'public' AS visibility, '' AS calls, 'Base' AS is_a, 'sell' AS contains, '' AS parameters FROM k
  UNION ALL SELECT k, 'method', 'Shop' || k || '.sell', 4, 5, 'public', 'os.path.join,helper,str', '', '', 'self,item' FROM k UNION ALL SELECT k, 'function', '_make_' || k, 7, 8, 'private', 'Shop' || k, '', '', 'n' FROM k
  UNION ALL SELECT k, 'module', 'shop_' || k, 1, 8, 'public', '', 'os', 'Shop' || k || ',_make_' || k, '' FROM k)
SELECT sha256('shops/shop_' || k || '.py:' || entity_type || ':' || name || ':' || CAST(start_line AS VARCHAR)) AS id, 'shops/shop_' || k || '.py' AS file_path, entity_type, name, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line, visibility, calls, is_a, contains, parameters FROM rows""",
    "ingest_job": """WITH k AS (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey AS n FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0), rows AS (
  SELECT k, 'class' AS entity_type, 'Shop' || k AS name, 3 AS line FROM k UNION ALL SELECT k, 'method', 'Shop' || k || '.sell', 4 FROM k UNION ALL SELECT k, 'function', '_make_' || k, 7 FROM k
  UNION ALL SELECT k, 'module', 'shop_' || k, 1 FROM k UNION ALL SELECT k, 'function', 'extra', 10 FROM k WHERE n % 2 = 0)
SELECT sha256('shops/shop_' || k || '.py:' || entity_type || ':' || name || ':' || CAST(line AS VARCHAR)) AS id, name, 'shops/shop_' || k || '.py' AS file_path, entity_type, 1.0::DOUBLE AS square, CAST(2 AS BIGINT) AS version FROM rows""",
    "workspace_projects": "SELECT p AS project, CASE WHEN p = 'few' THEN 0 ELSE 4 * (SELECT count(*) FROM supplier) END AS n, p = 'shops__all_' AS current FROM (VALUES ('few'), ('shops__all_'), ('some_test_shops')) AS t(p)",
    "scan_trees": "SELECT replace(p, '{n}', n_name) AS path, lang AS language, skip, CASE WHEN skip IS NULL THEN upper(sha256('def f(): return ' || chr(39) || n_name || chr(39) || chr(10))) END AS sha256 FROM nation, (VALUES " + ", ".join(f"({quoted(p)}, {_or_null(lang)}, {_or_null(skip)})" for p, (lang, skip) in FATES.items()) + """) AS t(p, lang, skip)
UNION ALL VALUES ('one/.gitignore', NULL, 'extension', NULL), ('one/.indexignore', NULL, 'extension', NULL), ('one/src/__init__.py', 'python', NULL, upper(sha256('A = 1' || chr(10)))), ('two/src/_private/x.py', 'python', NULL, upper(sha256('B = 2' || chr(10))))""",
    "scan_counts": "SELECT reason, a * (SELECT count(*) FROM nation) + b AS n, c * (SELECT count(*) FROM nation) + d AS entries FROM (VALUES ('indexed', 3, 2, 3, 2), ('default', 2, 0, 1, 1), ('dot_folder', 1, 0, 0, 1), ('extension', 1, 2, 1, 2), ('gitignore', 2, 0, 1, 1), ('project_ignore', 2, 0, 1, 1)) AS t(reason, a, b, c, d)",
    "source_folders": "SELECT * FROM (VALUES ('all', ''), ('curated', '/one/lib'), ('curated', '/one/src'), ('below', '/one/lib'), ('below', '/one/src'), ('below', '/two/src')) AS t(way, folder)",
}
