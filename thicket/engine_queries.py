"""Queries that go through the engine, and one for each smaller operator; the
SQL says the same by other means. Importing this registers them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket import catalogs as cat
from thicket.functions import paths, text
from thicket.model import FindRequest, OverviewRequest, ReferencesRequest, SafeError, Scope, ValidationError, ambiguous, internal_error, no_match, path_error, unsupported_extension
from thicket.operators import combine, references, tree
from thicket.plans.adapters import ADAPTERS
from thicket.plans.engine import TIMED_OUT, WARMING_UP, Engine, duration
from thicket.queries import SYM, _sym, progress_events, query
from thicket.sources import cache, parsers, workspace
from thicket.storage import scratch_path
from thicket.streaming import progress

_EXT = "CASE CAST(regexp_extract(file, '#(\\d+)\\.', 1) AS INT) % 7 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(cat.SUFFIXES)) + " END"
WS = f"{SYM},\nws AS (SELECT * REPLACE (replace(file, '.sym', '') || {_EXT} AS file) FROM sym)"
_RANGE = "CASE WHEN first_line = last_line THEN first_line::VARCHAR ELSE first_line || '-' || last_line END"
_NONE = "NULL::VARCHAR"


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- find -----------------------------------------------------------------------


@query("engine_find_all_adapters", f"WITH {WS} SELECT kind, {_NONE} AS body, {_NONE} AS info, name_path, file, first_line, last_line FROM ws WHERE name IN ('1-URGENT') AND kind = 6")
def engine_find(spark, sf):
    return Engine(cat.workspace_catalog(spark, sf)).find(FindRequest("1-URGENT", include_kinds=(6,)))


@query("engine_find_scope_descendants", f"WITH {WS} SELECT kind, {_NONE} AS body, {_NONE} AS info, name_path, file, first_line, last_line FROM ws WHERE file LIKE 'ASIA/%' AND kind = 8 AND split_part(split_part(name_path, '/', 2), '@', 1) = '5-LOW'")
def engine_find_scope(spark, sf):
    found = Engine(cat.workspace_catalog(spark, sf)).find(FindRequest("Customer#", Scope("ASIA"), depth=2, substring=True))
    return found.where("kind = 8 AND split(get(split(name_path, '/'), 1), '@')[0] = '5-LOW'")


_FIND_ITEM = f"""'{{"kind":' || kind || ',"path":"' || name_path || '","file":"' || file || '","range":"' || {_RANGE} || '"}}'"""


@query("engine_find_json", f"""WITH {WS}, it AS (SELECT {_FIND_ITEM} AS j, row_number() OVER (ORDER BY file, first_line, last_line, name_path, kind) AS k FROM ws WHERE name = '3-MEDIUM'),
    fit AS (SELECT *, 14 + sum(strlen(j) + CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS size FROM it), t AS (SELECT count(*) AS n FROM it), p AS (SELECT count(*) AS k FROM fit WHERE size <= 32768)
    SELECT '{{"symbols":[' || (SELECT string_agg(j, ',' ORDER BY k) FROM fit WHERE size <= 32768) || ']' || CASE WHEN p.k < t.n THEN ',"returned_percent":' || least(99, greatest(1, 100 * p.k // t.n)) ELSE '' END || '}}' AS json FROM t, p""")  # fmt: skip
def engine_find_json(spark, sf):
    return _rows(spark, [(Engine(cat.workspace_catalog(spark, sf)).find_json(FindRequest("3-MEDIUM")),)], "json string")


@query("engine_overview_json", f"""WITH {WS}, f AS (SELECT * FROM ws WHERE file = (SELECT min(file) FROM ws WHERE file LIKE '%.py')),
    g AS (SELECT kind, min(pre) AS p, string_agg('{{"path":"' || name_path || '","range":"' || {_RANGE} || '"}}', ',' ORDER BY pre) AS s FROM f WHERE depth <= 2 GROUP BY kind)
    SELECT '{{"groups":[' || string_agg('{{"kind":' || kind || ',"symbols":[' || s || ']}}', ',' ORDER BY p) || ']}}' AS json FROM g""")  # fmt: skip
def engine_overview_json(spark, sf):
    symbols = cat.workspace_catalog(spark, sf)
    first = symbols.where(F.col("file").endswith(".py")).agg(F.min("file")).first()[0]
    return _rows(spark, [(Engine(symbols).overview_json(OverviewRequest(first, 2)),)], "json string")


@query("engine_overview_php_sorted", "SELECT 'src/p1.php' AS file, * FROM (VALUES (5, 'A', 0, 5, 1), (7, 'A/prop', 1, 1, 2), (6, 'A/use', 2, 4, 3), (14, 'LAST', 7, 7, 4)) t(kind, name_path, first_line, last_line, rank)")
def engine_overview_php(spark, sf):
    files = cat.code_files(spark, sf, ".php").select("file", F.concat("content", F.lit("\n\nconst LAST = 3;")).alias("content"))
    return Engine(cat.code_catalog(spark, sf, ".php"), constants=parsers.constants(files)).overview(OverviewRequest("src/p1.php", 1))


def _impl_payload(name):
    at = lambda a, b: f'{{"start":{{"line":{a},"character":0}},"end":{{"line":{b},"character":1}}}}'
    child = lambda n, a: f'{{"kind":6,"name":"{n}","range":{at(a, a)},"selectionRange":{at(a, a)}}}'
    kids = ",".join(child(n, a) for n, a in (("new", 1), ("get", 2), ("new", 3)))
    return F.concat(F.lit('{"kind":19,"name":"impl '), name, F.lit(f'","range":{at(0, 5)},"selectionRange":{at(0, 0)},"children":[{kids}]}}'))


@query("engine_rust_fallback", f"""SELECT 6 AS kind, {_NONE} AS body, {_NONE} AS info, 'Brand#13/new@' || l || ':0' AS name_path, 'src/p' || p_partkey || '.rs' AS file, CAST(l AS INT) AS first_line, CAST(l AS INT) AS last_line
    FROM part, (VALUES (1), (3)) x(l) WHERE p_brand = 'Brand#13'""")  # fmt: skip
def engine_rust(spark, sf):
    part = cat.table(spark, sf, "part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".rs")).alias("file"), F.lit(0).alias("seq"), _impl_payload(F.col("p_brand")).alias("payload"))
    return Engine(tree.flatten(part)).find(FindRequest("Brand#13/new"))


def _go_symbols(spark, sf):
    at = '{"start":{"line":1,"character":5},"end":{"line":2,"character":0}}'
    item = lambda kind, name: F.concat(F.lit(f'{{"kind":{kind},"name":"'), name, F.lit(f'","range":{at},"selectionRange":{at}}}'))
    names = F.array(
        F.struct(F.lit(0).alias("seq"), item(6, F.concat(F.lit("(*"), "p_brand", F.lit("[K.V]).Get"))).alias("payload")),
        F.struct(F.lit(1).alias("seq"), item(12, F.col("p_type")).alias("payload")),
        F.struct(F.lit(2).alias("seq"), item(12, F.lit("fmt.Print")).alias("payload")),
    )
    part = cat.table(spark, sf, "part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".go")).alias("file"), F.explode(names).alias("s"))
    return tree.flatten(part.select("file", "s.seq", "s.payload"), "go")


@query("go_receiver_paths", """SELECT 'src/p' || p_partkey || '.go' AS file, kind, CASE k WHEN 0 THEN p_brand || '/Get' WHEN 1 THEN p_type ELSE 'fmt.Print' END AS name_path, 1 AS last_line
    FROM part, (VALUES (0, 6), (1, 12), (2, 12)) x(k, kind)""")  # fmt: skip
def go_receivers(spark, sf):
    return _go_symbols(spark, sf).select("file", "kind", "name_path", "last_line")


@query("engine_go_qualified_query", "SELECT 'src/p' || p_partkey || '.go' AS file, p_type AS name_path FROM part WHERE p_type = 'ECONOMY' UNION ALL SELECT 'src/p' || p_partkey || '.go', p_brand || '/Get' FROM part WHERE p_brand = 'Brand#13'")
def engine_go(spark, sf):
    engine = Engine(_go_symbols(spark, sf))
    found = [engine.find(FindRequest(q)).select("file", "name_path") for q in ("mypkg.ECONOMY", "my_pkg/Brand#13/Get")]
    return found[0].unionByName(found[1])


@query("engine_php_constants", f"""SELECT 14 AS kind, {_NONE} AS body, 'const LAST = 3;' AS info, 'LAST' AS name_path, 'src/p' || p_partkey || '.php' AS file, 7 AS first_line, 7 AS last_line FROM part""")
def engine_constants(spark, sf):
    files = cat.code_files(spark, sf, ".php").select("file", F.concat("content", F.lit("\n\n  const LAST = 3;\n")).alias("content"))
    return Engine(cat.code_catalog(spark, sf, ".php"), files, constants=parsers.constants(files)).find(FindRequest("LAST", include_info=True))


@query("engine_php_info_fallback", """SELECT 'src/p' || p_partkey || '.php' AS file, name_path, CASE WHEN p_partkey % 3 = 0 THEN 'told ' || p_partkey ELSE line END AS info
    FROM part, (VALUES ('A', 'class A {'), ('A/prop', 'prop;'), ('A/use', 'function use() {')) x(name_path, line)""")  # fmt: skip
def engine_info(spark, sf):
    symbols, files = cat.code_catalog(spark, sf, ".php"), cat.code_files(spark, sf, ".php")
    told = F.when(F.col("k") % 3 == 0, F.concat(F.lit(" told "), "k")).when(F.col("k") % 3 == 1, F.lit("Could not find source with x"))
    hover = symbols.select("file", F.col("sel_line").alias("line"), F.col("sel_char").alias("character")).join(files.select("file", told.alias("text")), "file").where("text IS NOT NULL")
    return Engine(symbols, files, hover=hover).find(FindRequest("A", depth=1, include_info=True)).select("file", "name_path", "info")


_STATEMENT = "export { default as A"


@query("engine_alias_found", """SELECT 12 AS kind, 'export { default as A' || p_partkey || ' } from "./m";' AS body, CASE WHEN p_partkey % 2 = 0 THEN 'alias ' || p_partkey END AS info,
    'A' || p_partkey AS name_path, 'src/p' || p_partkey || '.ts' AS file, 1 AS first_line, 1 AS last_line FROM part WHERE contains('a' || p_partkey, 'a1')""")  # fmt: skip
def engine_alias(spark, sf):
    files = cat.code_files(spark, sf, ".ts").select("k", "file", F.concat(F.lit("// é\n"), F.lit(_STATEMENT), "k", F.lit(' } from "./m";\n')).alias("content"))
    aliases = parsers.reexports(files.select("file", "content")).withColumn("source_kind", F.lit(12))
    hover = files.where("k % 2 = 0").select("file", F.lit(1).alias("line"), F.lit(len("export { default as ")).alias("character"), F.concat(F.lit(" alias "), "k").alias("text"))
    return Engine(cat.code_catalog(spark, sf, ".ts").where("kind = 5"), files, hover=hover, aliases=aliases).find(FindRequest("a1", substring=True, include_body=True, include_info=True))


# -- references -------------------------------------------------------------------


def _raw_references(spark, sf):
    """Every class refers to the first one's method, by a use of two lines and
    one of a single line that starts on the same line."""
    files = cat.code_files(spark, sf, ".cpp")
    uses = F.array(F.struct(F.lit(2).alias("char"), F.lit(4).alias("end_line")), F.struct(F.lit(4).alias("char"), F.lit(3).alias("end_line")))
    at = files.select(F.col("file").alias("ref_file"), "k", F.explode(uses).alias("u"))
    return at.select(
        F.lit("src/p1.cpp").alias("target_file"), F.lit(2).alias("target_line"), F.lit(2).alias("target_char"), "ref_file", F.lit(3).alias("line"), "u.char", "u.end_line",
        (F.col("k") * 2 + (F.col("u.end_line") == 3).cast("int")).alias("seq"),
    )


def _engine_of_references(spark, sf) -> Engine:
    return Engine(cat.code_catalog(spark, sf, ".cpp"), cat.code_files(spark, sf, ".cpp").select("file", "content"), _raw_references(spark, sf), incomplete=True)


@query("engine_references", """SELECT 6 AS kind, 'A/use' AS name_path, 'src/p' || p_partkey || '.cpp' AS file, 2 AS content_start, 4 AS content_end,
    '  function use() {' || chr(10) || '    it.prop;' || chr(10) || '  }' AS content, 4 AS "char", CAST(2 AS BIGINT) AS n_refs FROM part""")  # fmt: skip
def engine_references(spark, sf):
    found = _engine_of_references(spark, sf).references(ReferencesRequest("A/use", "src/p1.cpp", (6,), (5,)))
    return found.select("kind", "name_path", "file", "content_start", "content_end", "content", "char", "n_refs")


@query("engine_references_json", """WITH it AS (SELECT '{"file":"' || f || '","symbols":[{"kind":6,"path":"A/use","range":"2-4","content":"  function use() {\\n    it.prop;\\n  }"}]}' AS j, row_number() OVER (ORDER BY f) AS k FROM (SELECT 'src/p' || p_partkey || '.cpp' AS f FROM part)),
    fit AS (SELECT *, 30 + sum(strlen(j) + CASE WHEN k > 1 THEN 1 ELSE 0 END) OVER (ORDER BY k) AS size FROM it), t AS (SELECT count(*) AS n FROM it), p AS (SELECT count(*) AS k FROM fit WHERE size <= 32768)
    SELECT '{"files":[' || (SELECT string_agg(j, ',' ORDER BY k) FROM fit WHERE size <= 32768) || '],"incomplete":true' || CASE WHEN p.k < t.n THEN ',"returned_percent":' || least(99, greatest(1, 100 * p.k // t.n)) ELSE '' END || '}' AS json FROM t, p""")  # fmt: skip
def engine_references_json(spark, sf):
    return _rows(spark, [(_engine_of_references(spark, sf).references_json(ReferencesRequest("A/use", "src/p1.cpp")),)], "json string")


@query("engine_property_references", """SELECT CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5 END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'A/use' ELSE 'A' END AS name_path, 'src/p' || p_partkey || '.php' AS file,
    CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 5 END AS content_start, CASE WHEN p_partkey % 2 = 0 THEN '    it.prop;' ELSE '}' END AS content FROM part""")  # fmt: skip
def engine_properties(spark, sf):
    files = cat.code_files(spark, sf, ".php")
    table = files.select(F.concat(F.lit("| "), "file", F.lit(" | "), F.when(F.col("k") % 2 == 0, 4).otherwise(6), F.lit(" | a | b | c |")).alias("value"))
    table = table.unionByName(_rows(spark, [("+---+",), ("| Path | LN | x | y | z |",), ("| src/p1.php | 2 | a | b | c |",)], "value string"))
    uses = parsers.reference_table(table).withColumns({"declared_file": F.lit("src/p1.php"), "property": F.lit("prop")})
    none = _raw_references(spark, sf).where("false")
    engine = Engine(cat.code_catalog(spark, sf, ".php"), files.select("file", "content"), none, property_references=uses)
    return engine.references(ReferencesRequest("A/prop", "src/p1.php", exclude_kinds=(7,))).select("kind", "name_path", "file", "content_start", "content")


@query("reference_candidate_evidence", "SELECT 'src/p' || p_partkey || '.cpp' AS file, CAST(l - 1 AS INT) AS content_start, CAST(least(l + 1, 5) AS INT) AS content_end, l * 10 + p_partkey % 3 + 1 AS col FROM part, (VALUES (1), (5)) x(l)")
def reference_evidence(spark, sf):
    files = cat.code_files(spark, sf, ".cpp")
    refs = files.select("file", (F.col("k") % 3).alias("char"), F.explode(F.array(F.lit(1), F.lit(5))).alias("line"))
    out = references.with_evidence(refs, files.select("file", "content"))
    return out.select("file", "content_start", "content_end", (F.col("line") * 10 + F.col("char") + 1).alias("col"))


@query("references_look_unfinished", "SELECT 'src/p' || p_partkey || '.ts' AS target_file, p_partkey % 4 = 1 AS suspect FROM part")
def look_unfinished(spark, sf):
    targets = cat.code_files(spark, sf, ".ts").select(F.col("file").alias("target_file"), "k")
    other = F.concat("target_file", F.lit("x"))
    workflow = targets.select("target_file", F.col("target_file").alias("file")).unionByName(targets.where("k % 4 <> 0").select("target_file", other.alias("file")))
    found = targets.where("k % 4 < 2").select("target_file", F.col("target_file").alias("file")).unionByName(targets.where("k % 4 > 1").select("target_file", other.alias("file")))
    return references.look_unfinished(found, targets.select("target_file"), workflow)


@query("references_incomplete_flag", """WITH e AS (SELECT user_id % 40 AS w, bool_or(false) AS x FROM events GROUP BY 1) SELECT 'w' || n_nationkey AS workspace, n_nationkey NOT IN (SELECT w FROM e) OR c.i AS incomplete
    FROM nation LEFT JOIN (WITH e AS (SELECT user_id % 40 AS w, user_id % 3 AS t, event_id AS s, CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'report' ELSE 'end' END AS k, value > 60 AS ix FROM events),
      le AS (SELECT w, t, max(s) FILTER (WHERE k = 'end') AS le FROM e GROUP BY w, t),
      per AS (SELECT e.w, bool_or(k <> 'end' AND ix) AS a, bool_or(k <> 'end' AND ix AND (le IS NULL OR s > le)) AS l FROM e JOIN le ON le.w = e.w AND le.t = e.t GROUP BY e.w, e.t)
      SELECT w, NOT (bool_or(a) AND NOT bool_or(l)) AS i FROM per GROUP BY w) c ON c.w = n_nationkey""")  # fmt: skip
def incomplete_flag(spark, sf):
    rows = cat.table(spark, sf, "nation").select(F.concat(F.lit("w"), "n_nationkey").alias("workspace"))
    return progress.with_incomplete(rows, progress.final_states(progress_events(spark, sf)))


# -- files and adapters --------------------------------------------------------------

_NAMES = ["a.go", "A.GO", "x/.git/b.py", "web/node_modules/c.ts", "web/d.TS", "web/e.tsx", "n.md", ".f.md", "inc/g.H", "inc/h.hpp", "cache/i.php", "j.php", "target/k.rs", "l.rs", "noext", "m.txt", "venv/o.py", "q.pyi", "go.mod", "r/compile_flags.txt"]


def _named_files(spark, sf):
    part = cat.table(spark, sf, "part").select("p_partkey")
    return part.select(F.explode(F.array(*[F.concat(F.lit("d"), "p_partkey", F.lit("/" + n)) for n in _NAMES])).alias("file"))


_FILES = "f AS (SELECT 'd' || p_partkey || '/' || n AS file, n FROM part, (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") x(n))"
_OF = {"go": ["a.go", "A.GO"], "python": ["x/.git/b.py", "venv/o.py", "q.pyi"], "typescript": ["web/node_modules/c.ts", "web/d.TS", "web/e.tsx"], "markdown": ["n.md", ".f.md"], "clangd": ["inc/g.H", "inc/h.hpp"], "php": ["cache/i.php", "j.php"], "rust": ["target/k.rs", "l.rs"]}


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query("adapter_selection", f"WITH {_FILES} SELECT file, CASE {' '.join(f'WHEN n IN ({_in(v)}) THEN {a!r}' for a, v in _OF.items())} END AS adapter, lower(regexp_extract(file, '(\\.[^./]*)$', 1)) AS ext FROM f WHERE n IN ({_in(x for v in _OF.values() for x in v)})")
def adapter_selection(spark, sf):
    registry = workspace.register({a.name: a.extensions for a in ADAPTERS.values()})
    return workspace.with_adapter(_named_files(spark, sf), registry).withColumn("ext", paths.extension(F.col("file")))


@query("adapter_file_listing", f"WITH {_FILES} SELECT file, CASE {' '.join(f'WHEN n IN ({_in(v)}) THEN {a!r}' for a, v in _OF.items())} END AS adapter FROM f WHERE n IN ('a.go', 'A.GO', 'q.pyi', 'web/e.tsx', 'n.md', '.f.md', 'inc/g.H', 'inc/h.hpp', 'j.php', 'l.rs')")
def adapter_listing(spark, sf):
    files, out = _named_files(spark, sf), None
    for a in ADAPTERS.values():
        own = files.where(a.lists(F.col("file"))).withColumn("adapter", F.lit(a.name))
        out = own if out is None else out.unionByName(own)
    return out


@query("watch_relevance", f"WITH {_FILES} SELECT file, n IN ('a.go', 'go.mod') AS go, n IN ('inc/g.H', 'inc/h.hpp', 'r/compile_flags.txt') AS clangd, n IN ('n.md', '.f.md') AS markdown FROM f")
def watch_relevance(spark, sf):
    return _named_files(spark, sf).select("file", *[ADAPTERS[a].watches(F.col("file")).alias(a) for a in ("go", "clangd", "markdown")])


@query("language_of_file", f"WITH {_FILES} SELECT file, CASE n WHEN 'web/e.tsx' THEN 'typescriptreact' ELSE 'typescript' END AS language FROM f WHERE n IN ({_in(_OF['typescript'])})")
def language_of_file(spark, sf):
    own = _named_files(spark, sf).where(paths.extension(F.col("file")).isin(".ts", ".tsx"))
    return own.select("file", ADAPTERS["typescript"].language(paths.extension(F.col("file"))).alias("language"))


def _local_workspace(spark, sf) -> tuple[str, list]:
    """A folder of small files; the listing itself is the driver's work, and
    the tables of it need storage that all see."""
    root = scratch_path(spark, "workspace").removeprefix("file://")
    nations = [r.n_name for r in cat.table(spark, sf, "nation").select("n_name").collect()]  # 25 rows
    for n in nations:
        for name in (f"{n}.py", f"_{n}.pyi", f"sub/{n}.py", f".hidden/{n}.py", f"build/{n}.py", f"{n}.txt"):
            at = os.path.join(root, name)
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at, "w", newline="") as f:
                f.write(f"{name}\r\n")
    return root, nations


_WS_FILES = "(SELECT n_name || '.py' AS file FROM nation UNION ALL SELECT '_' || n_name || '.pyi' FROM nation UNION ALL SELECT 'sub/' || n_name || '.py' FROM nation)"


@query("workspace_listing", f"SELECT file, CAST(row_number() OVER (ORDER BY encode(file)) AS INT) AS rank, sha256(file || chr(13) || chr(10)) AS content_hash FROM {_WS_FILES}")
def workspace_listing(spark, sf):
    root, _ = _local_workspace(spark, sf)
    adapter = ADAPTERS["python"]
    files = workspace.scope_files(workspace.workspace_root(root), workspace.resolve_scope(root, "."), adapter.extensions, adapter.ignores)
    rank = _rows(spark, [(f, i) for i, f in enumerate(files, 1)], "file string, rank int")
    return workspace.read_files(spark, root, files).select("file", "content_hash").join(rank, "file")


@query("workspace_scopes", "SELECT 'sub/' || n_name || '.py' AS file, 'dir' AS scope FROM nation UNION ALL SELECT 'ASIA', 'none' FROM nation WHERE false UNION ALL SELECT '_' || min(n_name) || '.pyi', 'file' FROM nation")
def workspace_scopes(spark, sf):
    root, nations = _local_workspace(spark, sf)
    adapter, rows = ADAPTERS["python"], []
    for name, scope in (("dir", "sub/../sub/"), ("file", f"_{min(nations)}.pyi"), ("none", f"{min(nations)}.txt")):
        found = workspace.scope_files(root, workspace.resolve_scope(root, scope), adapter.extensions, adapter.ignores)
        rows += [(workspace.document_path(root, f)[0], name) for f in found]
    return _rows(spark, rows, "file string, scope string")


@query("reference_workflow_files", "SELECT 'sub/' || n_name || '.py' AS file, n_name = (SELECT min(n_name) FROM nation) AS is_last FROM nation")
def workflow(spark, sf):
    root, nations = _local_workspace(spark, sf)
    found = workspace.workflow_files(root, f"sub/{min(nations)}.py", ADAPTERS["python"].extensions, ADAPTERS["python"].ignores)
    return _rows(spark, [(f, i == len(found) - 1) for i, f in enumerate(found)], "file string, is_last boolean")


# -- the cache --------------------------------------------------------------------------


@query("cache_round_trip", _sym("SELECT file, name_path, kind, depth, CAST(pre AS BIGINT) AS preorder, CAST(pend AS BIGINT) AS subtree_end, first_line, last_line FROM sym WHERE file LIKE 'ASIA/%' OR file LIKE 'EUROPE/%'"))
def cache_round_trip(spark, sf):
    symbols, path = cat.stored_orders(spark, sf), scratch_path(spark, "cache")
    for adapter, region, kind in (("go", "ASIA", 99), ("rust", "EUROPE", None), ("go", "ASIA", None)):
        own = symbols.where(F.col("file").startswith(region + "/")).withColumn("kind", F.coalesce(F.lit(kind).cast("int"), "kind"))
        files = own.select("file", F.sha2("file", 256).alias("content_hash")).distinct()
        keys = cache.entries(files, cache.CachePolicy(adapter, fingerprint="v1"), "w")
        cache.store(keys.join(cache.encode_trees(own), "file"), path)
    return cache.decode_trees(cache.load(spark, path)).select("file", "name_path", "kind", "depth", "preorder", "subtree_end", "first_line", "last_line")


@query("cache_paths", """SELECT p_partkey AS k, '/c/' || sha256('w' || p_partkey) || '/shared/v1/clangd/default/symbol_tree/' || sha256('src/' || p_name) || '.json' AS entry,
    '/c/' || sha256('w' || p_partkey) || '/adapters/clangd' AS folder, 'clangd|default|v1|srv|1.2|c' AS fingerprint FROM part""")  # fmt: skip
def cache_paths(spark, sf):
    part, ws = cat.table(spark, sf, "part"), F.concat(F.lit("w"), "p_partkey")
    entry = cache.entry_path(F.lit(cache.cache_root(" /c/ ")), ws, F.lit("clangd"), F.lit("default"), F.concat(F.lit("src/"), "p_name"))
    return part.select(F.col("p_partkey").alias("k"), entry.alias("entry"), cache.adapter_dir("/c", ws, "clangd").alias("folder"), F.lit(cache.fingerprint("clangd", "default", "v1", "srv", "1.2", "c")).alias("fingerprint"))


@query("cache_policies", "SELECT * FROM (VALUES (0, true, '.clangd,compile_commands.json'), (1, false, ''), (2, false, 'compile_flags.txt'), (3, true, '')) t(k, enabled, dependencies)")
def cache_policies(spark, sf):
    own = [{"CompileFlags": {"CompilationDatabase": ["build"]}}]
    made = [cache.clangd_policy(["compile_commands.json", ".clangd", "x"], None, False), cache.clangd_policy([], None, True), cache.clangd_policy(["compile_flags.txt"], own, False), cache.clangd_policy([], [{}], False)]
    return _rows(spark, [(i, p.enabled, ",".join(cache.distinct_in_order([*p.dependencies, *p.dependencies]))) for i, p in enumerate(made)], "k int, enabled boolean, dependencies string")


# -- scalars ------------------------------------------------------------------------------


@query("path_parts", """SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a/b/' WHEN 2 THEN p_brand ELSE 'x' END AS leaf, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'a/b' END AS parent,
    CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE 'n' END AS plain, 'a/c.d' AS clean, 'sub/f+ g.py' AS relative FROM part""")  # fmt: skip
def path_parts(spark, sf):
    part = cat.table(spark, sf, "part")
    p = F.when(F.col("p_partkey") % 4 == 0, "a/b").when(F.col("p_partkey") % 4 == 1, "a/b/").when(F.col("p_partkey") % 4 == 2, F.col("p_brand")).otherwise("/x")
    return part.select(
        F.col("p_partkey").alias("k"), paths.leaf_of(p).alias("leaf"), paths.parent_of(p).alias("parent"), paths.strip_first_mark(F.lit("n@x@1:2")).alias("plain"),
        paths.clean_path(F.lit("./a/b/../c.d")).alias("clean"), paths.relative_from_uri(F.concat(F.lit("file:///w/"), F.lit("root/sub/x/../f+%20g.py")), "/w/root/").alias("relative"),
    )


@query("physical_lines", """WITH f AS (SELECT doc_id, replace(COALESCE(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents)
    SELECT doc_id, (string_split(t, chr(10)))[2] AS line, CAST(strlen(t) AS BIGINT) AS n FROM f""")  # fmt: skip
def physical_lines(spark, sf):
    files = cat.document_files(spark, sf)
    return files.select("doc_id", text.physical_line(F.col("content"), F.lit(1)).alias("line"), F.octet_length(F.replace("content", F.lit("\r\n"), F.lit("\n"))).cast("long").alias("n"))


@query("byte_offset_positions", """WITH f AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), g AS (SELECT doc_id, t, length(t) // 2 AS h FROM f), x AS (SELECT doc_id, substr(t, 1, h) AS head FROM g)
    SELECT doc_id, CAST(length(head) - length(replace(head, chr(10), '')) AS INT) AS line, CAST(strlen(list_extract(string_split(head, chr(10)), -1)) AS INT) AS "char" FROM x""")  # fmt: skip
def byte_offsets(spark, sf):
    files = cat.document_files(spark, sf)
    half = F.octet_length(F.substring(F.col("content"), F.lit(1), F.floor(F.length("content") / 2).cast("int")))
    line, char = text.offset_position(F.col("content"), half)
    return files.select("doc_id", line.alias("line"), char.alias("char"))


@query("clamped_numbers", "SELECT event_id, CAST(greatest(0, least(4294967295, (event_id - 500) * 10000000)) AS BIGINT) AS n FROM events")
def clamped(spark, sf):
    return cat.table(spark, sf, "events").select("event_id", text.clamp_uint32((F.col("event_id") - 500) * 10_000_000).alias("n"))


@query("compile_commands", """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN '/abs' WHEN p_partkey % 3 = 0 THEN '/w' ELSE '/w/b' || p_partkey END AS directory, 'f' || p_partkey || '.c' AS file, '-O2' AS arg, 'kept' AS extra FROM part""")
def compile_commands(spark, sf):
    part = cat.table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    folder = F.when(F.col("k") % 2 == 0, "/abs").when(F.col("k") % 3 == 0, "").otherwise(F.concat(F.lit("b"), "k"))
    raw = F.concat(F.lit('[{"directory":"'), folder, F.lit('","file":"f'), "k", F.lit('.c","arguments":["cc","-O2"],"note":"kept"}]'))
    made = parsers.compile_commands(raw, "/w")
    get = lambda p: F.get_json_object(made, p)
    return part.select("k", get("$[0].directory").alias("directory"), get("$[0].file").alias("file"), get("$[0].arguments[1]").alias("arg"), get("$[0].note").alias("extra"))


@query("config_fragments", "SELECT p_partkey AS k, p_partkey % 3 = 0 OR p_partkey % 3 = 1 AS applies, p_partkey % 3 <> 1 AS other FROM part")
def config_fragments(spark, sf):
    found = parsers.config_fragments("If:\n  PathMatch: [src/.*\\.c, 'lib/.*']\n  PathExclude: .*_test\\.c\n---\nIf:\n  PathExclude:\n    - lib/.*\nCompileFlags:\n  Add: [-W]\n")
    file = F.element_at(F.array(*[F.lit(x) for x in ("src/a.c", "lib/a.h", "src/a_test.c")]), F.col("p_partkey").cast("int") % 3 + 1)
    part = cat.table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("k"), parsers.fragment_predicate(found[0], file).alias("applies"), parsers.fragment_predicate(found[1], file).alias("other"))


@query("key_value_entries", "SELECT p_partkey AS k, 'v=' || p_size AS a, '' AS b, CAST(2 AS INT) AS n, p_brand || ',x' AS trimmed FROM part")
def key_values(spark, sf):
    part = cat.table(spark, sf, "part")
    made = parsers.key_values(F.array(F.lit("A=old"), F.lit("B ="), F.concat(F.lit(" A =v="), "p_size")))
    trimmed = parsers.trimmed_entries(F.array(F.concat(F.lit(" "), "p_brand", F.lit("\t")), F.lit(" "), F.lit("x"), F.lit("")))
    return part.select(F.col("p_partkey").alias("k"), made["A"].alias("a"), made["B"].alias("b"), F.size(made).alias("n"), F.array_join(trimmed, ",").alias("trimmed"))


@query("json_values", "SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN p_partkey || '-' || (p_partkey + 1) ELSE p_partkey::VARCHAR END AS \"range\", p_brand = 'Brand#13' AS same, contains(lower(p_brand), 'brand#1') AS alias FROM part")
def json_values(spark, sf):
    part, k = cat.table(spark, sf, "part"), F.col("p_partkey")
    return part.select(
        k.alias("k"), paths.range_text(k, F.when(F.col("p_size") > 25, k + 1).otherwise(k)).alias("range"), paths.constant_pattern("/Brand#13/", F.col("p_brand")).alias("same"),
        paths.alias_pattern("bRAND#1", F.col("p_brand"), True).alias("alias"),
    )


_PUBLIC = [
    ("no_match", 'no symbol matches "a/b"'), ("ambiguous", 'multiple symbols match "a"; use a more specific symbol_path: a (f:1), a (f:2)'), ("extension", 'files with extension ".x" are not supported'),
    ("not_found", 'scope_path "q" not found'), ("is_directory", 'file_path "." points to a directory'), ("escapes", 'file_path "../q" escapes workspace root'), ("internal", "internal error"),
    ("timeout", "tool execution timed out after 6m0s"), ("warming", "request timed out, the LSP server may still be warming up"), ("request", "symbol_path is required; depth must not be negative"),
]


@query("public_errors", "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(k, v) for k, v in _PUBLIC) + ") t(name, message)")
def public_errors(spark, sf):
    try:
        FindRequest(" ", depth=-1).validate()
        told = ""
    except ValidationError as e:
        told = e.public("symbol_path")
    try:
        raise internal_error(ValueError("private"))
    except SafeError as e:
        inner = e.message
    rows = [
        ("no_match", no_match("a/b").message), ("ambiguous", ambiguous("a", ["a (f:1)", "a (f:2)"]).message), ("extension", unsupported_extension(".x").message),
        ("not_found", path_error("scope_path", " q ", "not_found").message), ("is_directory", path_error("file_path", "", "is_directory").message), ("escapes", path_error("file_path", "../q", "escapes").message),
        ("internal", inner), ("timeout", TIMED_OUT.format(duration(360))), ("warming", WARMING_UP), ("request", told),
    ]
    return _rows(spark, rows, "name string, message string")


@query("append_missing_alias", _sym("SELECT file, name_path, kind, first_line FROM sym WHERE depth = 1 UNION ALL SELECT file, 'extra', 12, first_line FROM sym WHERE depth = 0"))
def append_missing_alias(spark, sf):
    s = cat.stored_orders(spark, sf)
    base = s.where("depth = 1").select("file", "name_path", "kind", "first_line")
    same = base.withColumn("kind", F.lit(12))
    more = s.where("depth = 0").select("file", F.lit("extra").alias("name_path"), F.lit(12).alias("kind"), "first_line")
    return combine.append_aliases(base, same.unionByName(more))


@query("flat_symbol_paths", """SELECT 'src/p' || p_partkey || '.py' AS file, 'box/' || p_brand || CASE WHEN k < 2 THEN '@' || k || ':4' ELSE '' END AS name_path, 0 AS depth, k AS sel_line FROM part, (VALUES (0), (1)) x(k)
    UNION ALL SELECT 'src/p' || p_partkey || '.py', p_type, 0, 2 FROM part""")  # fmt: skip
def flat_symbols(spark, sf):
    at = lambda a: f'"location":{{"uri":"u","range":{{"start":{{"line":{a},"character":4}},"end":{{"line":{a},"character":9}}}}}}'
    item = lambda seq, name, box: F.struct(F.lit(seq).alias("seq"), F.concat(F.lit('{"kind":12,"name":"'), name, F.lit(f'","containerName":"{box}",{at(seq)}}}')).alias("payload"))
    part = cat.table(spark, sf, "part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".py")).alias("file"), F.explode(F.array(item(0, F.col("p_brand"), " box "), item(1, F.col("p_brand"), "box"), item(2, F.col("p_type"), ""))).alias("s"))
    return tree.flatten(part.select("file", "s.*")).select("file", "name_path", "depth", "sel_line")
