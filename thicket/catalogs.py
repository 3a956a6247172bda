"""Symbol catalogs out of relational tables, which exercise the engine at any
size. A file is one customer, conversation or document, so its tree is bounded
while the number of files grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.functions.text import utf16_width
from thicket.operators.tree import mark_duplicates, with_derived, with_names
from thicket.storage import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(nodes: DataFrame) -> DataFrame:
    return with_names(nodes)


def orders_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File ``region/nation/customer.sym``: a customer (class), its orders
    (methods, named by priority) and their line items (fields, named by return
    flag and status), one line each, in the order of their keys."""
    region, nation, customer, orders, items = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name", "n_name")
    c = customer.join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), "c_name", F.lit(".sym")).alias("file"))
    o = orders.select("o_custkey", "o_orderkey", "o_orderpriority").join(c, F.col("o_custkey") == F.col("c_custkey"))
    items = items.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("name"))  # the key is not unique
    li = items.select("l_orderkey", "l_linenumber", "name").join(o.select("o_orderkey", "file", "c_name"), F.col("l_orderkey") == F.col("o_orderkey"))
    null = F.lit(None)
    rows = (
        c.select("file", "c_name", null.cast("long").alias("o"), null.cast("int").alias("l"), F.lit(0).alias("depth"), F.lit(5).alias("kind"), F.col("c_name").alias("name"))
        .union(o.select("file", "c_name", "o_orderkey", null.cast("int"), F.lit(1), F.lit(6), "o_orderpriority"))
        .union(li.select("file", "c_name", "l_orderkey", "l_linenumber", F.lit(2), F.lit(8), "name"))
    )
    in_file, in_order = Window.partitionBy("file"), Window.partitionBy("file", "o")
    walk = in_file.orderBy(F.asc_nulls_first("o"), F.asc_nulls_first("l"))
    below = F.when(F.col("depth") == 0, F.count("*").over(in_file) - 1).when(F.col("depth") == 1, F.count("*").over(in_order) - 1).otherwise(0)
    n = rows.withColumn("preorder", (F.row_number().over(walk) - 1).cast("long")).withColumn("subtree_end", F.col("preorder") + below)
    line = F.col("preorder").cast("int")
    n = n.withColumns({"start_line": line, "start_char": F.col("depth") * 4, "end_line": F.col("subtree_end").cast("int") + 1, "end_char": F.lit(0), "sel_line": line, "sel_char": F.col("depth") * 4})
    siblings = [F.col("file"), F.col("depth"), F.when(F.col("depth") == 2, F.col("o"))]
    n = n.withColumn("comp", mark_duplicates(F.col("name"), siblings, F.col("sel_line"), F.col("sel_char")))
    first = F.min(F.when(F.col("depth") == 1, F.struct("preorder", "comp"))).over(in_order)
    rank = F.when(F.col("depth") > 0, F.dense_rank().over(in_file.orderBy(F.asc_nulls_first("o"))) - 2)
    root = F.struct(F.lit(0).alias("sl"), F.lit(0).alias("sc"), (F.count("*").over(in_file)).cast("int").alias("el"), F.lit(0).alias("ec"))
    n = n.withColumns({"_order": first, "_rank": rank.cast("int"), "_root": root, "_size": F.count("*").over(in_order).cast("int")})
    order = F.struct(F.col("_order.preorder").cast("int").alias("sl"), F.lit(4).alias("sc"), (F.col("_order.preorder") + F.col("_size")).cast("int").alias("el"), F.lit(0).alias("ec"))
    at = F.col("depth")
    parts = F.when(at == 0, F.array("comp")).when(at == 1, F.array("c_name", "comp")).otherwise(F.array("c_name", F.col("_order.comp"), "comp"))
    ords = F.when(at == 0, F.array(F.lit(0))).when(at == 1, F.array(F.lit(0), "_rank")).otherwise(F.array(F.lit(0), F.col("_rank"), (F.col("preorder") - F.col("_order.preorder")).cast("int")))
    none = F.array().cast("array<struct<sl:int,sc:int,el:int,ec:int>>")
    anc = F.when(at == 0, none).when(at == 1, F.array("_root")).otherwise(F.array("_root", order))
    n = n.withColumns({"node_id": F.col("preorder"), "parent_id": F.when(at == 1, F.lit(0)).when(at == 2, F.col("_order.preorder")).cast("long"), "components": parts, "ord_path": ords, "anc": anc})
    return _named(n).drop("_order", "_rank", "_root", "_size", "comp", "c_name")


_stored: dict[tuple[str, str], str] = {}


def stored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders_catalog`` as a table: made once a session, dealt by file and
    sorted by last component, so that an exact pattern reads few row groups."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = scratch_path(spark, "orders-catalog")
        orders_catalog(spark, sf_dir).repartition("file").sortWithinPartitions("leaf_base", "file", "preorder").write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


#: One extension an adapter, dealt over the customers by their keys.
SUFFIXES = [".go", ".ts", ".md", ".py", ".cpp", ".php", ".rs"]


def workspace_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stored_orders`` with files of every adapter."""
    k = F.regexp_extract("file", r"#(\d+)\.sym$", 1).cast("int")
    ext = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), k % len(SUFFIXES) + 1)
    return stored_orders(spark, sf_dir).withColumn("file", F.concat(F.regexp_replace("file", r"\.sym$", ""), ext))


CODE = ["class A {", "  prop;", "  function use() {", "    it.prop;", "  }", "}"]


def code_files(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """A small class for every part: ``file, content, k``."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    return part.select(F.concat(F.lit("src/p"), "k", F.lit(ext)).alias("file"), F.lit("\n".join(CODE)).alias("content"), "k")


def code_catalog(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """Its symbols: a class, a property and a method."""
    rows = [("A", 5, None, 0, 0, 0, 5, 1, 2), ("A/prop", 7, 0, 1, 1, 2, 1, 7, 1), ("A/use", 6, 0, 2, 2, 2, 4, 3, 2)]
    nodes = [
        F.struct(
            F.lit(i).cast("long").alias("node_id"), F.lit(up).cast("long").alias("parent_id"), F.lit(path.count("/")).alias("depth"), F.lit(i).cast("long").alias("preorder"),
            F.lit(end).cast("long").alias("subtree_end"), F.lit(kind).alias("kind"), F.array(*map(F.lit, path.split("/"))).alias("components"),
            F.array(*map(F.lit, [0] if up is None else [0, i - 1])).alias("ord_path"), F.lit(sl).alias("start_line"), F.lit(sc).alias("start_char"), F.lit(el).alias("end_line"),
            F.lit(ec).alias("end_char"), F.lit(sl).alias("sel_line"), F.lit(sc).alias("sel_char"),
        )
        for path, kind, up, i, sl, sc, el, ec, end in rows
    ]
    return with_derived(code_files(spark, sf_dir, ext).select("file", F.explode(F.array(*nodes)).alias("n")).select("file", "n.*"))


def part_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a reference to its part: ``ref_id, file, line, char,
    part``. It stands before its own symbol on the line, inside its order's;
    every seventh item's stands beyond the file's end."""
    symbols = stored_orders(spark, sf_dir).where(F.col("depth") == 2).select("file", "o", "l", "preorder")
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    joined = symbols.join(items, (F.col("o") == F.col("l_orderkey")) & (F.col("l") == F.col("l_linenumber")))
    line = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 7 == 0, F.lit(100_000)).otherwise(F.col("preorder")).cast("int")
    return joined.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ref_id"), "file", line.alias("line"), F.lit(2).alias("char"), F.col("l_partkey").alias("part"))


def conversation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File ``conv/<id>``: its turns in order, functions named by role. Roles
    repeat, so most turns carry their position."""
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv/"), "conv_id").alias("file"), "turn", F.col("role").alias("name"), F.length("text").alias("width"))
    line = (F.row_number().over(Window.partitionBy("file").orderBy("turn")) - 1).cast("int")
    n = rows.withColumn("sel_line", line).withColumn("sel_char", F.lit(0))
    n = n.withColumn("comp", mark_duplicates(F.col("name"), [F.col("file")], F.col("sel_line"), F.col("sel_char")))
    pre = F.col("sel_line").cast("long")
    n = n.withColumns(
        {
            "node_id": pre, "parent_id": F.lit(None).cast("long"), "depth": F.lit(0), "preorder": pre, "subtree_end": pre, "ord_path": F.array("sel_line"), "kind": F.lit(12),
            "components": F.array("comp"), "start_line": F.col("sel_line"), "start_char": F.lit(0), "end_line": F.col("sel_line"), "end_char": F.col("width"),
            "anc": F.array().cast("array<struct<sl:int,sc:int,el:int,ec:int>>"),
        }
    )
    return _named(n).drop("width", "turn", "name", "comp")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")


def document_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's blocks of three lines, as strings ``B0, B1, ...``; a block
    starts at character 1 of its first line and ends within its last."""
    lines = document_files(spark, sf_dir).select("file", F.posexplode(F.split("content", "\n", -1)).alias("line", "text"))
    b = lines.withColumn("block", F.floor(F.col("line") / 3).cast("int")).groupBy("file", "block").agg(
        F.min("line").alias("start_line"), F.max(F.struct("line", F.greatest(utf16_width(F.col("text")) - 1, F.lit(1)).alias("w"))).alias("e")
    )
    pre = F.col("block").cast("long")
    n = b.withColumns(
        {
            "node_id": pre, "parent_id": F.lit(None).cast("long"), "depth": F.lit(0), "preorder": pre, "subtree_end": pre, "ord_path": F.array("block"), "kind": F.lit(15),
            "components": F.array(F.concat(F.lit("B"), "block")), "start_char": F.lit(1), "end_line": F.col("e.line"), "end_char": F.col("e.w").cast("int"),
            "sel_line": F.col("start_line"), "sel_char": F.lit(1), "anc": F.array().cast("array<struct<sl:int,sc:int,el:int,ec:int>>"),
        }
    )
    return _named(n).drop("e", "block")
