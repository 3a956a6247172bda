"""Queries over the driver's tables and, for each, SQL that says the same.

The SQL does not use the engine's notions: it works names, lines and paths out
of the tables by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket import catalogs as cat
from thicket.functions import paths, text
from thicket.model import FindRequest, Scope
from thicket.operators import combine, references, search, shape, tree
from thicket.sources import cache, parsers
from thicket.streaming import progress, watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SYM = """
c AS (SELECT c_custkey, c_name, r_name || '/' || n_name || '/' || c_name || '.sym' AS file
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
o AS (SELECT o_orderkey, o_orderpriority, file, c_name FROM orders JOIN c ON o_custkey = c_custkey),
li AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS name, min(l_partkey) AS part FROM lineitem GROUP BY l_orderkey, l_linenumber),
rw AS (SELECT file, c_name, NULL::BIGINT AS o, NULL::INT AS l, 0 AS depth, 5 AS kind, c_name AS name FROM c
       UNION ALL SELECT file, c_name, o_orderkey, NULL, 1, 6, o_orderpriority FROM o
       UNION ALL SELECT o.file, o.c_name, l_orderkey, l_linenumber, 2, 8, li.name FROM li JOIN o ON l_orderkey = o_orderkey),
nm AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o NULLS FIRST, l NULLS FIRST) - 1 AS pre,
       CASE depth WHEN 0 THEN count(*) OVER (PARTITION BY file) - 1 WHEN 1 THEN count(*) OVER (PARTITION BY file, o) - 1 ELSE 0 END AS below,
       count(*) OVER (PARTITION BY file, depth, CASE WHEN depth = 2 THEN o END, name) AS twins FROM rw),
cm AS (SELECT *, name || CASE WHEN twins > 1 THEN '@' || pre || ':' || (depth * 4) ELSE '' END AS comp FROM nm),
sym AS (SELECT file, depth, kind, name, comp, c_name, o, l, pre, pre + below AS pend, CAST(pre AS INT) AS first_line, CAST(pre + below AS INT) AS last_line,
        CASE depth WHEN 0 THEN comp WHEN 1 THEN c_name || '/' || comp
        ELSE c_name || '/' || max(CASE WHEN depth = 1 THEN comp END) OVER (PARTITION BY file, o) || '/' || comp END AS name_path FROM cm)"""
CONV = """
t AS (SELECT 'conv/' || conv_id AS file, role AS name, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pre FROM conversations),
cv AS (SELECT *, name || CASE WHEN count(*) OVER (PARTITION BY file, name) > 1 THEN '@' || pre || ':0' ELSE '' END AS name_path FROM t)"""
REFS = """
rf AS (SELECT l_orderkey * 8 + l_linenumber AS ref_id, part, s.file, s.o,
       CAST(CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN 100000 ELSE s.pre END AS INT) AS line
       FROM li JOIN sym s ON s.depth = 2 AND s.o = l_orderkey AND s.l = l_linenumber),
loc AS (SELECT rf.ref_id, rf.file, rf.line, p.kind, p.name_path, p.first_line, p.last_line
        FROM rf LEFT JOIN sym p ON p.depth = 1 AND p.file = rf.file AND p.o = rf.o AND rf.line <> 100000),
fall AS (SELECT ref_id, loc.file, line, COALESCE(kind, 1) AS kind, COALESCE(name_path, c_name) AS name_path,
         COALESCE(first_line, 0) AS first_line, COALESCE(loc.last_line, n.last_line) AS last_line
         FROM loc JOIN (SELECT file AS f, c_name, last_line FROM sym WHERE depth = 0) n ON n.f = loc.file)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _sym(body: str) -> str:
    return f"WITH {SYM} {body}"


_RANK = "CAST(row_number() OVER (PARTITION BY file ORDER BY first_line, last_line, name_path, kind, pre) AS INT) AS rank"


def _found_sql(where: str) -> str:
    return _sym(f"SELECT file, kind, name_path, first_line, last_line, {_RANK} FROM sym WHERE {where}")


def _found(spark: SparkSession, sf: str, **request) -> DataFrame:
    rows = search.ranked_in_file(search.find(cat.stored_orders(spark, sf), FindRequest(**request)))
    return rows.select("file", "kind", "name_path", "first_line", "last_line", "rank")


def _define_finds() -> None:
    urgent = "depth = 1 AND name = '1-URGENT'"
    finds = {
        "find_suffix": (dict(path="1-URGENT"), urgent),
        "find_absolute": (dict(path="/Customer#000000001/1-URGENT"), f"{urgent} AND c_name = 'Customer#000000001'"),
        "find_absolute_needs_full_length": (dict(path="/1-URGENT"), "false"),
        "find_nested_suffix": (dict(path="2-HIGH/NO"), "depth = 2 AND name = 'NO' AND split_part(split_part(name_path, '/', 2), '@', 1) = '2-HIGH'"),
        "find_substring_last_segment": (dict(path="RGEN", substring=True), "name LIKE '%RGEN%'"),
        "find_substring_exact_parents": (dict(path="5-LOW/N", substring=True), "depth = 2 AND name LIKE '%N%' AND split_part(split_part(name_path, '/', 2), '@', 1) = '5-LOW'"),
        "find_empty_pattern": (dict(path="//"), "false"),
        "find_kind_include": (dict(path="O", substring=True, include_kinds=(6,)), "name LIKE '%O%' AND kind = 6"),
        "find_kind_exclude": (dict(path="O", substring=True, exclude_kinds=(6,)), "name LIKE '%O%' AND kind <> 6"),
        "find_kind_both": (dict(path="O", substring=True, include_kinds=(6, 8), exclude_kinds=(8,)), "name LIKE '%O%' AND kind = 6"),
        "find_scope_dir": (dict(path="NO", scope=Scope("ASIA")), "name = 'NO' AND file LIKE 'ASIA/%'"),
    }
    for name, (request, where) in finds.items():
        query(name, _found_sql(where))(lambda s, d, r=request: _found(s, d, **r))


_define_finds()


@query("find_scope_file", _sym(f"SELECT file, kind, name_path, first_line, last_line, {_RANK} FROM sym WHERE name = 'RF' AND file = (SELECT min(file) FROM c)"))
def find_scope_file(spark, sf):
    first = cat.stored_orders(spark, sf).agg(F.min("file")).first()[0]
    return _found(spark, sf, path="RF", scope=Scope(first, False))


@query("find_depth1_descendants", _sym(f"SELECT file, kind, name_path, first_line, last_line, {_RANK} FROM sym WHERE depth > 0 AND split_part(split_part(name_path, '/', 2), '@', 1) = '3-MEDIUM'"))
def find_depth1(spark, sf):
    return _found(spark, sf, path="3-MEDIUM", depth=1)


@query("find_filtered_descendants", _found_sql("kind <> 6"))
def find_filtered(spark, sf):
    return _found(spark, sf, path="Customer#", substring=True, depth=2, exclude_kinds=(6,))


@query("find_discriminated", f"WITH {CONV} SELECT file, name_path, CAST(pre AS INT) AS first_line FROM cv WHERE name_path = 'user@2:0'")
def find_discriminated(spark, sf):
    return search.find(cat.conversation_catalog(spark, sf), FindRequest("user@2:0")).select("file", "name_path", "first_line")


@query("find_discriminated_substring", f"WITH {CONV} SELECT file, name_path, CAST(pre AS INT) AS first_line FROM cv WHERE contains(name_path, 'ser@2:0')")
def find_discriminated_substring(spark, sf):
    return search.find(cat.conversation_catalog(spark, sf), FindRequest("ser@2:0", substring=True)).select("file", "name_path", "first_line")


def _overview(depth: int):
    sql = _sym(f"SELECT file, kind, name_path, first_line, last_line, CAST(row_number() OVER (PARTITION BY file ORDER BY pre) AS INT) AS rank FROM sym WHERE depth <= {depth}")
    query(f"overview_depth{depth}", sql)(lambda spark, sf: search.overview(cat.stored_orders(spark, sf), depth))


for _d in (0, 1, 2):
    _overview(_d)


@query("overview_sorted", _sym(f"SELECT file, kind, name_path, first_line, last_line, {_RANK} FROM sym WHERE depth <= 1"))
def overview_sorted(spark, sf):
    return search.overview_sorted(cat.stored_orders(spark, sf), 1)


@query("overview_grouped_by_kind", _sym("""SELECT file, kind, CAST(dense_rank() OVER (PARTITION BY file ORDER BY f) AS INT) AS group_rank,
    CAST(row_number() OVER (PARTITION BY file, kind ORDER BY pre) AS INT) AS pos, name_path AS path,
    CASE WHEN first_line = last_line THEN first_line::VARCHAR ELSE first_line || '-' || last_line END AS "range"
    FROM (SELECT *, min(pre) OVER (PARTITION BY file, kind) AS f FROM sym)"""))
def overview_grouped(spark, sf):
    return shape.kind_groups(search.overview(cat.stored_orders(spark, sf), 2), ["file"])


@query("count_overview_entries", _sym("SELECT kind, count(*) AS n FROM sym GROUP BY kind"))
def count_entries(spark, sf):
    return search.overview(cat.stored_orders(spark, sf), 2).groupBy("kind").agg(F.count("*").alias("n"))


@query("trim_groups", _sym("""SELECT file, kind, CAST(row_number() OVER (PARTITION BY file, kind ORDER BY pre) AS INT) AS pos, name_path AS path FROM sym WHERE pre < 3"""))
def trim_groups(spark, sf):
    rows = shape.without_empty_groups(search.overview(cat.stored_orders(spark, sf), 2), 3)
    return shape.kind_groups(rows, ["file"]).select("file", "kind", "pos", "path")


@query("duplicate_sibling_paths", f"WITH {CONV} SELECT file, name_path, name AS base, CAST(pre AS INT) AS first_line FROM cv")
def duplicate_paths(spark, sf):
    return cat.conversation_catalog(spark, sf).select("file", "name_path", F.col("leaf_base").alias("base"), "first_line")


@query("resolve_unique_candidates", _sym("""SELECT file, count(*) AS n, CASE WHEN count(*) > 1 THEN
    array_to_string(list_sort(list(name_path || ' (' || file || ':' || first_line || ')')), ', ') END AS candidates FROM sym WHERE depth = 1 AND name = '1-URGENT' GROUP BY file"""))
def resolve_candidates(spark, sf):
    return search.resolve_all(cat.stored_orders(spark, sf), "1-URGENT")


_BODY = """
f AS (SELECT source || '/' || doc_id AS file, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
b AS (SELECT file, ls[4] AS l0, ls[5] AS l1, ls[6] AS l2, len(ls) AS n FROM f WHERE len(ls) > 3)"""


@query("find_include_body", f"""WITH {_BODY} SELECT file, 'B1' AS name_path, NULLIF(CASE WHEN n = 4 THEN substr(l0, 2, greatest(length(l0) - 1, 1) - 1)
    WHEN n = 5 THEN substr(l0, 2) || chr(10) || substr(l1, 1, greatest(length(l1) - 1, 1))
    ELSE substr(l0, 2) || chr(10) || l1 || chr(10) || substr(l2, 1, greatest(length(l2) - 1, 1)) END, '') AS body FROM b""")  # fmt: skip
def find_body(spark, sf):
    files = cat.document_files(spark, sf)
    return search.find(cat.document_catalog(spark, sf), FindRequest("/B1", include_body=True), files).select("file", "name_path", "body")


@query("find_include_info", _sym("SELECT file, name_path, CASE WHEN o % 2 = 0 THEN 'order ' || o END AS info FROM sym WHERE depth = 1 AND name = '4-NOT SPECIFIED'"))
def find_info(spark, sf):
    symbols = cat.stored_orders(spark, sf)
    told = symbols.where((F.col("depth") == 1) & (F.col("o") % 2 == 0))
    hover = told.select("file", F.col("sel_line").alias("line"), F.col("sel_char").alias("character"), F.concat(F.lit("  order "), "o", F.lit(" ")).alias("text"))
    return search.find(symbols, FindRequest("4-NOT SPECIFIED", include_info=True), hover=hover).select("file", "name_path", "info")


def _located(spark, sf):
    return references.innermost(cat.part_references(spark, sf), cat.stored_orders(spark, sf))


def _with_fallback(spark, sf):
    lines = cat.stored_orders(spark, sf).groupBy("file").agg(F.count("*").cast("int").alias("n_lines"))
    return references.with_file_fallback(_located(spark, sf), lines)




def _ref_sql(body: str) -> str:
    return f"WITH {SYM}, {REFS} {body}"


@query("reference_innermost_container", _ref_sql("SELECT ref_id, file, kind, name_path, first_line, last_line FROM loc"))
def reference_innermost(spark, sf):
    return _located(spark, sf).select("ref_id", "file", "kind", "name_path", "first_line", "last_line")


@query("reference_file_fallback", _ref_sql("SELECT ref_id, file, kind, name_path, first_line, last_line FROM fall WHERE kind = 1"))
def reference_fallback(spark, sf):
    return _with_fallback(spark, sf).where("kind = 1").select("ref_id", "file", "kind", "name_path", "first_line", "last_line")


@query("reference_kind_filter", _ref_sql("SELECT ref_id, kind, name_path FROM fall WHERE kind IN (1, 6) AND kind <> 1"))
def reference_kinds(spark, sf):
    return references.keep_kinds(_with_fallback(spark, sf), (1, 6), (1,)).select("ref_id", "kind", "name_path")


_GROUPED = """SELECT name_path, file, first_line, last_line, kind, line, 2 AS "char", ref_id, n_refs FROM (SELECT *, count(*) OVER w AS n_refs,
    row_number() OVER (PARTITION BY name_path, file, first_line, last_line ORDER BY line, ref_id) AS k FROM fall WINDOW w AS (PARTITION BY name_path, file, first_line, last_line)) WHERE k = 1"""


@query("references_grouped", _ref_sql(_GROUPED))
def references_grouped(spark, sf):
    return references.grouped_counts(_with_fallback(spark, sf))


@query("references_by_file", _ref_sql(f"SELECT file, name_path, kind, ref_id, CAST(row_number() OVER (PARTITION BY file ORDER BY first_line, last_line, name_path, kind) AS INT) AS rank FROM ({_GROUPED})"))
def references_by_file(spark, sf):
    return references.by_file(references.grouped(_with_fallback(spark, sf))).select("file", "name_path", "kind", "ref_id", "rank")


@query("reference_snippets", """WITH f AS (SELECT doc_id, string_split(COALESCE(text, ''), chr(10)) AS ls FROM documents),
    r AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM f)
    SELECT doc_id * 1000000 + i AS ref_id, CAST(greatest(i - 1, 0) AS INT) AS content_start, CAST(least(i + 1, len(ls) - 1) AS INT) AS content_end,
    array_to_string(ls[greatest(i - 1, 0) + 1 : least(i + 1, len(ls) - 1) + 1], chr(10)) AS content FROM r WHERE contains(ls[i + 1], 'License')""")  # fmt: skip
def reference_snippets(spark, sf):
    files = cat.document_files(spark, sf)
    lines = files.select("file", "doc_id", F.posexplode(text.lines_of(F.col("content"))).alias("line", "t")).where(F.contains("t", F.lit("License")))
    refs = lines.select((F.col("doc_id") * 1_000_000 + F.col("line")).alias("ref_id"), "file", "line")
    return references.with_evidence(refs, files).select("ref_id", "content_start", "content_end", "content")


def _points(spark, sf):
    return cat.part_references(spark, sf).where("line < 100000").select("ref_id", "file", "line")


@query("smallest_container_line", _ref_sql("SELECT ref_id, kind, name_path FROM loc WHERE line <> 100000"))
def smallest_line(spark, sf):
    return references.smallest_by_lines(_points(spark, sf), cat.stored_orders(spark, sf), (5, 6)).select("ref_id", "kind", "name_path")


@query("smallest_container_by_span", _ref_sql("SELECT ref_id, s.kind, s.name_path FROM rf JOIN sym s ON s.file = rf.file AND s.pre = rf.line WHERE rf.line <> 100000"))
def smallest_span(spark, sf):
    return references.smallest_in_overview(_points(spark, sf), cat.stored_orders(spark, sf)).select("ref_id", "kind", "name_path")


@query("merge_found_fill_gaps", _sym("""SELECT name_path, file, first_line, last_line, CASE WHEN name = '1-URGENT' THEN 6 ELSE 12 END AS kind,
    CASE WHEN name = '1-URGENT' AND o % 2 = 0 THEN 'a' || o ELSE 'b' || o END AS body, 'i' || o AS info FROM sym WHERE depth = 1"""))
def merge_found(spark, sf):
    orders = cat.stored_orders(spark, sf).where("depth = 1")
    key = ["name_path", "file", "first_line", "last_line"]
    none = F.lit(None).cast("string")
    own = orders.where("leaf_base = '1-URGENT'").select(*key, "kind", F.when(F.col("o") % 2 == 0, F.concat(F.lit("a"), "o")).otherwise("").alias("body"), none.alias("info"))
    other = orders.select(*key, F.lit(12).alias("kind"), F.concat(F.lit("b"), "o").alias("body"), F.concat(F.lit("i"), "o").alias("info"))
    return combine.merge_found([own, other])


@query("augment_anti_union", _sym("SELECT name_path, file, first_line, last_line, CASE WHEN name = '1-URGENT' THEN 6 ELSE 14 END AS kind FROM sym WHERE depth = 1 AND name IN ('1-URGENT', '2-HIGH')"))
def augment(spark, sf):
    orders = cat.stored_orders(spark, sf).where("depth = 1").select("name_path", "file", "first_line", "last_line", "kind", "leaf_base")
    more = orders.where("leaf_base IN ('1-URGENT', '2-HIGH')").drop("leaf_base").withColumn("kind", F.lit(14))
    return combine.append_constants(orders.where("leaf_base = '1-URGENT'").drop("leaf_base"), more)


@query("augment_by_path_only", _sym("SELECT name_path, file, kind FROM sym WHERE depth = 0 OR (depth = 1 AND pre > 1)"))
def augment_by_path(spark, sf):
    s = cat.stored_orders(spark, sf)
    base = s.where("depth = 0").select("name_path", "file", "kind")
    more = s.where("depth <= 1 AND preorder <> 1").select("name_path", "file", "kind")
    return combine.append_missing(base, more, ["file", "name_path"])


_ITEM = """'{"kind":' || kind || ',"path":"' || name_path || '","file":"' || file || '","range":"' || CASE WHEN first_line = last_line THEN first_line::VARCHAR ELSE first_line || '-' || last_line END || '"}'"""


@query("byte_budget_find", _sym(f"""SELECT file, name_path, CAST(rank AS INT) AS rank, CAST(size AS BIGINT) AS size FROM (SELECT *, 14 + sum(strlen({_ITEM}) + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS size
    FROM (SELECT *, row_number() OVER (ORDER BY file, first_line, last_line, name_path, kind, pre) AS rank FROM sym WHERE depth = 1 AND name = '1-URGENT')) WHERE size <= 32768"""))
def byte_budget_find(spark, sf):
    rows = search.ranked(search.find(cat.stored_orders(spark, sf), FindRequest("1-URGENT")), 32_768)
    return shape.within_budget(rows, shape.found_item(), 32_768, shape.FOUND_ENVELOPE).select("file", "name_path", "rank", "size")


_RITEM = """'{"kind":' || kind || ',"path":"' || name_path || '","range":"' || first_line || '-' || (first_line + 1) || '","content":"n \\u003c ' || n_refs || '"}'"""


@query("byte_budget_refs", _ref_sql(f"""SELECT file, name_path, CAST(rank AS INT) AS rank, CAST(size AS BIGINT) AS size FROM (SELECT *, 12 + sum(strlen({_RITEM}) + CASE WHEN fresh THEN strlen('{{"file":"","symbols":[]}}') + strlen(file) ELSE 0 END
    + CASE WHEN rank > 1 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS size FROM (SELECT *, COALESCE(lag(file) OVER (ORDER BY rank) <> file, true) AS fresh FROM (SELECT *, row_number() OVER (ORDER BY file, first_line, last_line, name_path, kind) AS rank FROM ({_GROUPED})))) WHERE size <= 32768"""))
def byte_budget_refs(spark, sf):
    rows = references.grouped_counts(_with_fallback(spark, sf))
    rows = rows.withColumns({"content_start": F.col("first_line"), "content_end": F.col("first_line") + 1, "content": F.concat(F.lit("n < "), "n_refs")})
    rows = shape.top_ranked(rows, ["file", "first_line", "last_line", "name_path", "kind"], 32_768)
    fits = shape.within_budget(rows, shape.reference_item(), 32_768, shape.FILES_ENVELOPE, "file", shape.file_frame(F.col("file")))
    return fits.select("file", "name_path", "rank", "size")


@query("returned_percent", _sym("""SELECT file, CAST(CASE WHEN k = 0 THEN 0 ELSE least(99, greatest(1, (100 * k) // n)) END AS INT) AS percent FROM (SELECT file, count(*) FILTER (WHERE name = 'NO') AS k, count(*) AS n FROM sym GROUP BY file)"""))
def percent(spark, sf):
    per = cat.stored_orders(spark, sf).groupBy("file").agg(F.count(F.when(F.col("leaf_base") == "NO", 1)).alias("k"), F.count("*").alias("n"))
    return per.select("file", shape.returned_percent(F.col("k"), F.col("n")).alias("percent"))


@query("brace_depth", """WITH f AS (SELECT doc_id, list_transform(string_split(COALESCE(text, ''), chr(10)), lambda x: CAST(length(x) % 3 AS INT) - 1) AS d FROM documents)
    SELECT doc_id, CAST(list_reduce(list_prepend(0, d[1 : len(d) - 1]), lambda a, x: greatest(0, a + x)) AS INT) AS depth_before FROM f""")  # fmt: skip
def brace_depth(spark, sf):
    files = cat.document_files(spark, sf)
    lines = files.select("doc_id", F.posexplode(text.lines_of(F.col("content"))).alias("line", "t"))
    out = parsers.clamped_depth(lines, F.length("t") % 3 - 1, ["doc_id"], "line")
    return out.groupBy("doc_id").agg(F.max_by("depth_before", "line").alias("depth_before"))


@query("top_level_constants", """SELECT 'src/' || p_partkey || '.php' AS file, 'P' || p_partkey AS name_path, 0 AS first_line FROM part
    UNION ALL SELECT 'src/' || p_partkey || '.php', 'LAST', 4 FROM part""")  # fmt: skip
def top_level_constants(spark, sf):
    part = cat.table(spark, sf, "part")
    content = F.concat(F.lit("const P"), "p_partkey", F.lit(" = 1;\r\nclass A {\r\n  const INNER = 2;\r\n}}\r\n const LAST = 3;\n"))
    found = parsers.constants(part.select(F.concat(F.lit("src/"), "p_partkey", F.lit(".php")).alias("file"), content.alias("content")))
    return found.select("file", "name_path", "first_line")


@query("reexport_parse", """SELECT 'x/' || n_name || '.ts' AS file, 'a' || n_nationkey AS name, 'default' AS original, './m' || n_nationkey AS module, 1 AS line FROM nation
    UNION ALL SELECT 'x/' || n_name || '.ts', 'b', 'b', './m' || n_nationkey, 1 FROM nation""")  # fmt: skip
def reexport_parse(spark, sf):
    n = cat.table(spark, sf, "nation")
    content = F.concat(F.lit("// é\nexport { default as a"), "n_nationkey", F.lit(", b } from \"./m"), "n_nationkey", F.lit("\";\nexport { no } from './x'\n"))
    files = n.select(F.concat(F.lit("x/"), "n_name", F.lit(".ts")).alias("file"), content.alias("content"))
    return parsers.reexports(files).select("file", "name", "original", "module", "line")


@query("default_export_position", "SELECT n_name AS file, 1 AS line, CAST(strlen(n_name) + 3 AS INT) AS \"char\" FROM nation")
def default_export(spark, sf):
    n = cat.table(spark, sf, "nation")
    return parsers.default_export(n.select(F.col("n_name").alias("file"), F.concat(F.lit("é\né"), "n_name", F.lit(" export default X;")).alias("content")))


@query("alias_resolution", """WITH a AS (SELECT c_custkey AS k, c_name, r_name || '/' || n_name || '/' || c_name || '.sym' AS f, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT 'ts/' || k || '.ts' AS file, 'A' || k AS name, CASE WHEN k % 2 = 0 THEN f WHEN k % 3 = 1 THEN 'm/' || k || '.js' END AS source_file,
    CASE WHEN k % 2 = 0 OR k % 3 = 1 THEN c_name END AS source_path, CASE WHEN k % 2 = 0 THEN 5 WHEN k % 3 = 1 THEN 12 END AS source_kind FROM a""")  # fmt: skip
def alias_resolution(spark, sf):
    symbols = cat.stored_orders(spark, sf).where("depth = 0").select("file", "name_path", "kind", "depth", "first_line", "last_line", "preorder")
    k = F.element_at(F.split("name_path", "#"), -1).cast("long")
    c = symbols.select(k.alias("k"), "file", "name_path")
    aliases = c.select(
        F.concat(F.lit("ts/"), "k", F.lit(".ts")).alias("file"), F.concat(F.lit("A"), "k").alias("name"), F.col("name_path").alias("original"),
        F.concat(F.lit("../m/./"), "k").alias("module"), F.lit(1).alias("line"), F.lit(9).alias("char"),
    )
    here = F.concat(F.lit("ts/"), "k", F.lit(".ts"))
    definitions = c.select(
        here.alias("file"), F.lit(1).alias("line"), F.lit(9).alias("character"), F.when(F.col("k") % 2 == 0, F.col("file")).otherwise(here).alias("def_file"),
        F.lit(0).alias("def_line"), F.lit(0).alias("seq"),
    )
    modules = c.where("k % 3 = 1").select(F.concat(F.lit("m/"), "k", F.lit(".js")).alias("file"), "name_path", F.lit(12).alias("kind"), F.lit(0).alias("depth"), F.lit(0).alias("first_line"), F.lit(0).alias("last_line"), F.lit(0).cast("long").alias("preorder"))
    out = combine.resolve_aliases(aliases, definitions, symbols.unionByName(modules), modules.select("file"), [".ts", ".tsx", ".js"])
    return out.select("file", "name", "source_file", "source_path", "source_kind")


@query("raw_symbol_decode", """SELECT event_id, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 12 ELSE 5 END AS kind, event_id % 2 = 0 AS is_flat,
    CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS container, CAST(event_id % 100 AS INT) AS start_line, CAST(event_id % 100 + 3 AS INT) AS end_line FROM events""")  # fmt: skip
def raw_decode(spark, sf):
    span = F.concat(F.lit('"range":{"start":{"line":'), F.col("event_id") % 100, F.lit(',"character":0},"end":{"line":'), F.col("event_id") % 100 + 3, F.lit(',"character":0}}'))
    flat = F.concat(F.lit('{"name":"'), "event_type", F.lit('","kind":12,"containerName":" u'), "user_id", F.lit(' ","location":{"uri":"x",'), span, F.lit("}}"))
    nested = F.concat(F.lit('{"name":"'), "event_type", F.lit('","kind":5,'), span, F.lit(',"selectionRange":{"start":{"line":1,"character":2},"end":{"line":1,"character":3}}}'))
    events = cat.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, flat).otherwise(nested).alias("payload"))
    return parsers.raw_symbols(events).select("event_id", "name", "kind", "is_flat", "container", "start_line", "end_line")


@query("tree_flatten", f"WITH {CONV} SELECT file, 'talk/' || name_path AS name_path, pre + 1 AS preorder, 1 AS depth, pre + 1 AS subtree_end FROM cv UNION ALL SELECT file, 'talk', 0, 0, count(*) FROM cv GROUP BY file")
def tree_flatten(spark, sf):
    c = cat.conversation_catalog(spark, sf).select("file", "leaf_base", "sel_line")
    at = lambda line: F.concat(F.lit('{"start":{"line":'), line, F.lit(',"character":0},"end":{"line":'), line + 1, F.lit(',"character":0}}'))
    child = F.concat(F.lit('{"kind":12,"name":"'), "leaf_base", F.lit('","range":'), at(F.col("sel_line")), F.lit(',"selectionRange":'), at(F.col("sel_line")), F.lit("}"))
    per = c.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sel_line", child.alias("j")))), lambda x: x["j"]), ",").alias("js"), F.count("*").alias("n"))
    whole = F.concat(F.lit('{"start":{"line":0,"character":0},"end":{"line":'), "n", F.lit(',"character":0}}'))
    payload = F.concat(F.lit('{"kind":2,"name":"talk","range":'), whole, F.lit(',"selectionRange":'), whole, F.lit(',"children":['), "js", F.lit("]}"))
    return tree.flatten(per.select("file", F.lit(0).alias("seq"), payload.alias("payload"))).select("file", "name_path", "preorder", "depth", "subtree_end")


@query("cache_invalidation", "SELECT source || '/' || doc_id AS file, sha256(COALESCE(text, '')) AS content_hash FROM documents WHERE doc_id % 10 = 0 OR doc_id % 7 = 0")
def cache_invalidation(spark, sf):
    files = cat.document_files(spark, sf).withColumn("content_hash", F.sha2("content", 256))
    policy = cache.CachePolicy("clangd", fingerprint=cache.fingerprint("a", "std", "v1"))
    now = cache.entries(files.select("file", "content_hash"), policy, "w")
    old = files.where("doc_id % 7 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 10 == 0, F.sha2(F.concat("content", F.lit("!")), 256)).otherwise(F.col("content_hash")))
    held = cache.entries(old.select("file", "content_hash"), policy, "w")
    return cache.stale(held, now).select("file", F.element_at("manifest", 1).getField("hash").alias("content_hash"))


@query("watch_apply", """WITH e AS (SELECT 'u' || user_id AS file, CASE event_type WHEN 'purchase' THEN 'created' WHEN 'signup' THEN 'deleted' WHEN 'error' THEN 'deleted' ELSE 'changed' END AS ch,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events),
    u AS (SELECT DISTINCT 'u' || user_id AS file FROM events)
    SELECT u.file, 'new' AS state FROM u JOIN e ON e.file = u.file AND k = 1 WHERE ch <> 'deleted'""")  # fmt: skip
def watch_apply(spark, sf):
    e = cat.table(spark, sf, "events")
    op = F.when(F.col("event_type") == "view", "write").when(F.col("event_type") == "click", "chmod").when(F.col("event_type") == "purchase", "create").when(F.col("event_type") == "signup", "rename").otherwise("remove")
    events = e.select(F.concat(F.lit("u"), "user_id").alias("path"), op.alias("op"), F.lit(False).alias("is_dir"), "ts", F.col("event_id").alias("seq"))
    files = events.select(F.col("path").alias("file")).distinct()
    return watch.apply_changes(files.withColumn("state", F.lit("old")), watch.file_events(events), files.withColumn("state", F.lit("new")))


_PROGRESS = """WITH e AS (SELECT user_id % 40 AS w, user_id % 3 AS t, event_id AS s, CASE event_type WHEN 'view' THEN 'begin' WHEN 'click' THEN 'report' ELSE 'end' END AS k, value > 60 AS ix FROM events),
    x AS (SELECT *, (SELECT max(p.s) FROM e p WHERE p.w = e.w AND p.t = e.t AND p.s < e.s AND p.k = 'end') AS prev FROM e),
    lastend AS (SELECT w, t, max(s) FILTER (WHERE k = 'end') AS le FROM e GROUP BY w, t),
    per AS (SELECT e.w, e.t, bool_or(k <> 'end' AND ix) AS any_, bool_or(k <> 'end' AND ix AND (le IS NULL OR s > le)) AS live FROM e JOIN lastend l ON l.w = e.w AND l.t = e.t GROUP BY e.w, e.t)
    SELECT 'w' || w AS workspace, CASE WHEN NOT bool_or(any_) THEN 'unknown' WHEN bool_or(live) THEN 'indexing' ELSE 'idle' END AS state,
    NOT (bool_or(any_) AND NOT bool_or(live)) AS incomplete FROM per GROUP BY w"""


def progress_events(spark, sf):
    e = cat.table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "click", "report").otherwise("end")
    return e.select(
        F.concat(F.lit("w"), F.col("user_id") % 40).alias("workspace"), (F.col("user_id") % 3).cast("string").alias("token"), kind.alias("kind"),
        F.when(F.col("value") > 60, "Background Index").otherwise("other").alias("title"), F.lit(None).cast("string").alias("message"), F.col("event_id").alias("seq"),
    )


@query("index_progress_state", _PROGRESS.replace("x AS (SELECT *, (SELECT max(p.s) FROM e p WHERE p.w = e.w AND p.t = e.t AND p.s < e.s AND p.k = 'end') AS prev FROM e),\n    ", ""))
def index_progress(spark, sf):
    return progress.final_states(progress_events(spark, sf))


@query("utf16_columns", "SELECT doc_id, CAST(length(COALESCE(text, '')) AS INT) AS width, substr(COALESCE(text, ''), 3, 7) AS part, strlen(COALESCE(text, '')) AS bytes FROM documents")
def utf16_columns(spark, sf):
    c = F.col("content")
    return cat.document_files(spark, sf).select("doc_id", text.utf16_width(c).alias("width"), text.slice_utf16(c, F.lit(2), F.lit(9)).alias("part"), F.octet_length(c).cast("long").alias("bytes"))


@query("rust_exported_paths", "SELECT o_orderkey, 'Bucket/' || o_orderstatus || '/impl ' || o_orderpriority AS path FROM orders")
def rust_paths(spark, sf):
    raw = F.concat(F.lit("impl Bucket/"), "o_orderstatus", F.lit("/impl "), "o_orderpriority")
    return cat.table(spark, sf, "orders").select("o_orderkey", paths.rust_export(raw).alias("path"))


@query("reference_table_rows", "SELECT DISTINCT 's' || l_suppkey AS file, CAST(l_linenumber - 1 AS INT) AS line FROM lineitem")
def reference_table(spark, sf):
    rows = F.concat(F.lit(" | s"), "l_suppkey", F.lit(" | "), "l_linenumber", F.lit(" | a | b |"))
    lines = cat.table(spark, sf, "lineitem").select(rows.alias("value"))
    heading = spark.createDataFrame([("+---+",), ("| Path | LN | x | y |",), ("",)], "value string")
    return parsers.reference_table(lines.union(heading))


@query("json_sizes", "SELECT doc_id, CAST(strlen(t) + 5 * (length(t) - length(regexp_replace(t, '[<>&]', '', 'g'))) AS BIGINT) AS bytes FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents)")
def json_sizes(spark, sf):
    return cat.document_files(spark, sf).select("doc_id", text.json_bytes(F.col("content")).cast("long").alias("bytes"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a search with its descendants, ranked within files."""
    return find_depth1(spark, sf_dir)
