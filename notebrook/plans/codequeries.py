"""Queries over the code itself: statements, symbols, data flow, graphs, execution order, risks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notebrook.functions import code as C
from notebrook.operators import codegraph as G
from notebrook.operators import ordered
from notebrook.operators.relational import spread_join
from notebrook.plans.corpus import cells, nested, notebooks
from notebrook.session import latest, table, written


def _python_books(spark: SparkSession, d: str) -> DataFrame:
    return notebooks(spark, d, "language").where("language = 'python'").select(F.col("_id").alias("notebook_id"))


def python_cells(spark: SparkSession, d: str) -> DataFrame:
    """notebook_id, cell_id, code of the code cells of Python notebooks. They are dealt out over at least as many parts as there are cores when they
    are deduplicated, for code takes long to parse however small it is."""
    raw = table(spark, d, "cell").select("_id", "notebook_id", "cell_id", "type", F.when(F.col("type") == "code", F.array_join("content", "\n")).alias("code"), "loaded_at")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    code = latest(raw.repartition(parts, "_id"), ["_id"], "loaded_at").where("type = 'code'").select("_id", "notebook_id", "cell_id", "code")
    return spread_join(code, _python_books(spark, d), "notebook_id", "_id", rows=table(spark, d, "notebook").count()).drop("_id")


def python_places(spark: SparkSession, d: str) -> DataFrame:
    """The same cells without their code: notebook_id, cell_id, pos and segment_id by gaps. Only slim columns are read."""
    slim = spread_join(cells(spark, d, "notebook_id", "cell_id", "type"), _python_books(spark, d), "notebook_id", "_id", rows=table(spark, d, "notebook").count())
    return ordered.gap_segments(slim).select("notebook_id", "cell_id", "pos", "segment_id")


def bounded_cells(spark: SparkSession, d: str) -> DataFrame:
    """Code cells of the candidates for evaluation: at most 256 statements in at least four segments, as the reference has it."""
    few = nested(spark, d, "notebook_id", "segment_ends", "n_ast_children_of_segments").where("size(segment_ends) > 3 and n_ast_children_of_segments <= 256")
    books = notebooks(spark, d, "notebook_id", "language").where("language = 'python'").join(few.select("notebook_id"), "notebook_id", "left_semi").select(F.col("_id").alias("notebook_id"))
    code = cells(spark, d, "notebook_id", "cell_id", "type", "content").where("type = 'code'")
    return code.join(books, "notebook_id").select("notebook_id", "cell_id", F.array_join("content", "\n").alias("code"))


def t01_statements(spark: SparkSession, d: str) -> DataFrame:
    found = G.per_cell(python_cells(spark, d), C.statements, "idx int, first_line int, last_line int, kind string")
    return found.groupBy("notebook_id", "kind").agg(F.count("*").alias("n"), F.sum(F.col("last_line") - F.col("first_line") + 1).alias("lines"))


def f03_stripped_lines(spark: SparkSession, d: str) -> DataFrame:
    """Code lines left without comments and docstrings; cells that the tokenizer rejects keep theirs."""

    def rows(code):
        bare = C.strip_comments(code)
        return [(len((bare if bare is not None else code).split("\n")) if (bare or code) else 0, bare is not None)]

    found = G.per_cell(python_cells(spark, d), rows, "n int, ok boolean")
    return found.groupBy("notebook_id").agg(F.sum("n").alias("n_lines"), F.count_if(~F.col("ok")).alias("rejected"))


def t07_references(spark: SparkSession, d: str) -> DataFrame:
    return G.references(python_cells(spark, d)).groupBy("notebook_id", "name").agg(F.count("*").alias("n"), F.count_distinct("source_cell").alias("definitions"))


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    groups = written(python_places(spark, d).drop("pos"), "groups")
    return G.edges(G.references(python_cells(spark, d)), groups), groups


def a07_segment_edges(spark: SparkSession, d: str) -> DataFrame:
    links, _ = _links(spark, d)
    return links.select("notebook_id", "source", "target", F.array_join("names", ",").alias("names"))


def a09_density(spark: SparkSession, d: str) -> DataFrame:
    return G.density(*_links(spark, d))


def a22_graph_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes, links and different names on links of every notebook's data-flow graph."""
    links, groups = _links(spark, d)
    nodes = groups.groupBy("notebook_id").agg(F.count_distinct("segment_id").alias("nodes"))
    named = links.select("notebook_id", "source", "target", F.explode("names").alias("name")).groupBy("notebook_id")
    named = named.agg(F.count_distinct("source", "target").alias("links"), F.count_distinct("name").alias("names"))
    return nodes.join(named, "notebook_id", "left").fillna(0)


def s38_graph_json(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_json(*_links(spark, d))


def t38_symbols(spark: SparkSession, d: str) -> DataFrame:
    return G.symbols(python_cells(spark, d)).groupBy("notebook_id", "cell_id").agg(
        F.count_if(F.col("role") == "makes").alias("makes"), F.count_if(F.col("role") == "needs").alias("needs")
    )


def j09_not_runnable(spark: SparkSession, d: str) -> DataFrame:
    out = G.runnable_top_down(G.symbols(python_cells(spark, d)))
    return out.select("notebook_id", "cell_id", F.array_join("missing", ",").alias("missing"))


def t44_single_order(spark: SparkSession, d: str) -> DataFrame:
    """The first execution order of every Python notebook, as positions among its code cells, in pages of a thousand triggers."""
    code = written(python_cells(spark, d), "code")
    places = python_places(spark, d).drop("segment_id")
    order = G.single_order(G.symbols(code), code).join(places, ["notebook_id", "cell_id"])
    pages = order.groupBy("notebook_id", F.floor(F.col("trigger") / 1000).alias("page")).agg(F.array_sort(F.collect_list(F.struct("trigger", "step", "pos"))).alias("x"))
    cells = code.select("notebook_id").distinct().join(pages, "notebook_id", "left")  # where nothing runs, the order is empty
    listed = F.array_join(F.transform("x", lambda x: x["pos"].cast("string")), ",")
    return cells.select("notebook_id", F.lit(0).alias("path"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce(listed, F.lit("")).alias("cells"))


def t44_all_orders(spark: SparkSession, d: str) -> DataFrame:
    """How many execution orders every Python notebook has, up to the reference's cap of 200."""
    code = python_cells(spark, d)
    return G.order_counts(G.symbols(code), code, 200)


def t45_recorded_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders of every Python notebook that agree with recorded run numbers, up to the cap of 200: the number of a cell in the notebook stands for
    that of its last run, so a stretch of text between code cells is as many runs of cells that ran again later."""
    counts = python_places(spark, d).select("notebook_id", "cell_id", (F.col("cell_id") + 1).alias("count"))
    return G.recorded_order_counts(G.symbols(python_cells(spark, d)), counts, 200)


def a25_executable(spark: SparkSession, d: str) -> DataFrame:
    return G.executable(G.symbols(python_cells(spark, d)), python_places(spark, d))


def j13_full_names(spark: SparkSession, d: str) -> DataFrame:
    """Functions in use by their fully qualified names."""
    return G.api_calls(python_cells(spark, d)).groupBy("api").agg(F.count_distinct("notebook_id").alias("notebooks"), F.count("*").alias("cells"))


def t49_random_fixes(spark: SparkSession, d: str) -> DataFrame:
    return G.random_fixes(python_cells(spark, d)).select("notebook_id", "cell_id", "call", F.array_join("fix", "\n").alias("fix"))


def t48_random_risk(spark: SparkSession, d: str) -> DataFrame:
    return G.random_risk(python_cells(spark, d))


def t15_functions(spark: SparkSession, d: str) -> DataFrame:
    found = G.per_cell(python_cells(spark, d), C.functions, "name string, parameters array<string>, first_line int, last_line int")
    return found.select("notebook_id", "cell_id", "name", F.array_join("parameters", ",").alias("parameters"), "first_line", "last_line")


def t17_imports(spark: SparkSession, d: str) -> DataFrame:
    return G.per_cell(python_cells(spark, d), C.imports, "name string, full_name string").groupBy("full_name").agg(F.count_distinct("notebook_id").alias("notebooks"))


def t20_tree_shape(spark: SparkSession, d: str) -> DataFrame:
    nodes = G.per_cell(python_cells(spark, d), C.tree_nodes, "node int, parent int, depth int, ordinal int, kind string")
    return nodes.groupBy("depth", "kind").agg(F.count("*").alias("n"))


def t23_dataflow(spark: SparkSession, d: str) -> DataFrame:
    flow = G.per_cell(python_cells(spark, d), C.dataflow, "name string, line int, relation string, source string, source_line int")
    return flow.groupBy("notebook_id", "relation").agg(F.count("*").alias("n"))


def t13_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Distance between the data-flow graph of the gap segments and the one with a segment per cell, per candidate notebook, and whether it is
    certain: else it is the best found within the budget, as with the reference's time limit."""
    code = written(bounded_cells(spark, d), "bounded")
    refs = written(G.references(code), "references")
    gaps = ordered.gap_segments(code.withColumn("type", F.lit("code"))).select("notebook_id", "cell_id", "pos", "segment_id")
    graphs = []
    for name, groups in (("a", gaps.select("notebook_id", "cell_id", "segment_id")), ("b", gaps.select("notebook_id", "cell_id", F.col("pos").alias("segment_id")))):
        nodes = groups.groupBy("notebook_id").agg(F.count_distinct("segment_id").alias(f"n_{name}"))
        links = G.edges(refs, groups).groupBy("notebook_id").agg(F.collect_list(F.struct("source", "target", F.array_join("names", ",").alias("label"))).alias(f"links_{name}"))
        graphs.append(nodes.join(links, "notebook_id", "left"))

    @F.udf("struct<distance double, certain boolean>", useArrow=True)
    def distance(links_a, n_a, links_b, n_b):
        as_map = lambda x: {(e["source"], e["target"]): e["label"] for e in x or ()}
        return G.edit_distance(as_map(links_a), n_a, as_map(links_b), n_b)

    found = graphs[0].join(graphs[1], "notebook_id").select("notebook_id", "n_a", "n_b", distance("links_a", "n_a", "links_b", "n_b").alias("d"))
    return found.select("notebook_id", "n_a", "n_b", "d.distance", "d.certain")


def t34_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of the graph region → nation → customer → order, breadth first."""
    of = lambda name, parent, child: table(spark, d, name).select(F.concat(F.lit(parent[0]), parent[1]).alias("parent"), F.concat(F.lit(child[0]), child[1]).alias("child"))
    edges = of("nation", ("r", "n_regionkey"), ("n", "n_nationkey")).unionByName(of("customer", ("n", "c_nationkey"), ("c", "c_custkey"))).unionByName(of("orders", ("c", "o_custkey"), ("o", "o_orderkey")))
    region = F.concat(F.lit("r"), "r_regionkey")
    return G.layers(edges, table(spark, d, "region").select(region.alias("node"), region.alias("root"))).groupBy("root", "depth").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        t01_statements, f03_stripped_lines, t07_references, a07_segment_edges, a09_density, a22_graph_counts, s38_graph_json, t38_symbols, j09_not_runnable,
        t44_single_order, t44_all_orders, t45_recorded_orders, a25_executable, j13_full_names, t48_random_risk, t49_random_fixes, t15_functions, t17_imports, t20_tree_shape, t23_dataflow, t13_edit_distance, t34_layers,
    )
}

ORACLE_SQL = {
    "t34_layers": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders),
t AS (SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS root, 0 AS depth FROM region UNION ALL SELECT e.c, t.root, t.depth + 1 FROM t JOIN e ON t.node = e.p)
SELECT root, depth, count(*) AS n FROM t GROUP BY ALL""",
}
