"""Queries over the tokens of cells: spans, flattened trees, model features, parts of cells, identifiers and stripped code."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notebrook.functions import arrays as A
from notebrook.functions import code as C
from notebrook.functions import spans as S
from notebrook.operators import codegraph as G
from notebrook.operators import ordered
from notebrook.plans.codequeries import python_cells, python_places
from notebrook.plans.corpus import SQL, cells, nested
from notebrook.session import table


def _digest(parts) -> str:
    return hashlib.md5("\x1f".join(map(str, parts)).encode("utf-8", "replace")).hexdigest()


def t03_leaf_spans(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every Python cell by kind, strings and comments in one piece, and the letters they cover."""
    rows = lambda code: [(x.kind, len(x.text), x.end_line - x.line + 1) for x in S.leaves(code)]
    found = G.per_cell(python_cells(spark, d), rows, "kind string, letters int, lines int")
    return found.groupBy("notebook_id", "kind").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"), F.max("lines").alias("most_lines"))


def t53_leaf_spans_without_comments(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda code: [(len(S.leaves(code, comments=False)),)]
    return G.per_cell(python_cells(spark, d), rows, "n int").groupBy("notebook_id").agg(F.sum("n").alias("n"))


def t04_variable_spans(spark: SparkSession, d: str) -> DataFrame:
    """The commonest texts of tokens that the grammar does not fix, per kind: how often and in how many cells. All are counted."""
    rows = lambda code: [(x.kind, x.text) for x in S.variables(code) if x.kind != "comment"]
    found = G.per_cell(python_cells(spark, d), rows, "kind string, text string")
    return found.groupBy("kind", F.md5("text").alias("text")).agg(F.count("*").alias("n"))


def f07_span_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of each top-level statement, cut out of the cell's lines by its span, with and without line breaks."""
    found = G.per_cell(python_cells(spark, d), lambda code: [(i, a - 1, b - 1, code) for i, a, b, _ in C.statements(code)], "idx int, first int, last int, code string")
    lines = F.split("code", "\n")
    end = F.length(F.try_element_at(lines, F.col("last") + 1))
    text = lambda joint: A.span_text(lines, F.col("first"), F.lit(0), F.col("last"), end, joint)
    return found.select("notebook_id", "cell_id", "idx", F.md5(text("\n")).alias("digest"), F.length(text("")).alias("letters"))


def f09_character_spans(spark: SparkSession, d: str) -> DataFrame:
    """The first word of every document, cut out by its character span."""
    docs = table(spark, d, "documents").where("text is not null")
    first = F.instr("text", " ")
    return docs.select("doc_id", A.character_span(F.col("text"), F.lit(0), F.greatest(first - 1, F.lit(0))).alias("word"))


def t05_travelled(spark: SparkSession, d: str) -> DataFrame:
    """The flattened syntax tree of every Python cell: its length, the inner nodes in it and a digest."""
    def rows(code):
        out = S.travelled(code)
        return [(len(out), sum(x.endswith("#Left") for x in out), _digest(out))] if out else []

    return G.per_cell(python_cells(spark, d), rows, "n int, inner int, digest string")


def t31_connected_flow(spark: SparkSession, d: str) -> DataFrame:
    """Names with a data-flow connection, by token index, per cell."""
    rows = lambda code: [(name, at, relation, ",".join(map(str, sources))) for name, at, relation, sources in S.connected_flow(code)[1]]
    return G.per_cell(python_cells(spark, d), rows, "name string, token int, relation string, sources string")


def t32_features(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of the graph-guided model for every Python cell: words, nodes and a digest of ids and positions."""
    def rows(code):
        x = S.features(code)
        return [(sum(p > 1 for p in x.positions), len(x.flow_to_code), _digest([x.ids, x.positions, x.flow_to_code, x.flow_to_flow]))]

    return G.per_cell(python_cells(spark, d), rows, "words int, nodes int, digest string")


def t33_attention(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of the attention of every Python cell and the entries that they cover, one counted for each rectangle."""
    def rows(code):
        x = S.attention(S.features(code))
        return [(len(x), sum((b - a) * (e - c) for a, b, c, e in x))]

    return G.per_cell(python_cells(spark, d), rows, "rectangles int, entries int")


def t56_pair_features(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of a model of pairs: every Python cell beside the first one of its notebook, words and nodes of both."""
    found = t32_features(spark, d).drop("digest")
    first = found.groupBy("notebook_id").agg(F.min(F.struct("cell_id", "words", "nodes")).alias("f"))
    pairs = found.join(first, "notebook_id").where("cell_id != f.cell_id")
    return pairs.select("notebook_id", F.col("f.cell_id").alias("a"), F.col("cell_id").alias("b"), F.col("f.words").alias("words_a"), F.col("words").alias("words_b"), F.col("f.nodes").alias("nodes_a"), F.col("nodes").alias("nodes_b"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = G.per_cell(python_cells(spark, d), S.split_up, "part string, name string, text string, children int")
    return parts, python_places(spark, d).drop("pos")


def t18_preprocessed(spark: SparkSession, d: str) -> DataFrame:
    """Imports, functions and the rest of every segment: how many and how long."""
    parts, groups = _parts(spark, d)
    joined = parts.join(groups, ["notebook_id", "cell_id"])
    return joined.groupBy("notebook_id", "segment_id", "part").agg(F.count_if((F.col("part") != "rest") | (F.col("children") > 0)).alias("n"), F.sum(F.length("text")).alias("letters"))


def t21_tree_ends(spark: SparkSession, d: str) -> DataFrame:
    """Statements of every segment without imports and functions, and the segment's end among the notebook's statements."""
    parts, groups = _parts(spark, d)
    sizes = groups.join(parts.where("part = 'rest'").select("notebook_id", "cell_id", "children"), ["notebook_id", "cell_id"], "left")
    sizes = sizes.groupBy("notebook_id", "segment_id").agg(F.coalesce(F.sum("children"), F.lit(0)).alias("n"))
    out = ordered.running(sizes, "notebook_id", "segment_id", end=("sum", F.col("n"), True))
    return out.select("notebook_id", "segment_id", "n", (F.col("end") - 1).alias("end"))


def t36_shallow_input(spark: SparkSession, d: str) -> DataFrame:
    """Positions and labels for a segmenter: every statement of a notebook with valid ends and whether a stage ends at it."""
    books = nested(spark, d, "segment_ends", "n_ast_children_of_segments").where("segment_ends is not null and n_ast_children_of_segments > 0")
    ends = A.clean_ends(F.col("segment_ends"))
    books = books.withColumn("ends", ends).where(F.size("ends") > 0).withColumn("y", A.ends_to_binary(F.col("ends")))
    return books.select("_id", F.posexplode("y").alias("position", "y"))


def f42_renamed(spark: SparkSession, d: str) -> DataFrame:
    """Every Python cell with its first own name renamed at all its places."""
    def rows(code):
        names = S.identifiers(code)
        return [(names[0], _digest([S.renamed(code, names[0], "renamed")]))] if names else []

    return G.per_cell(python_cells(spark, d), rows, "name string, digest string")


def f43_identifiers(spark: SparkSession, d: str) -> DataFrame:
    rows = lambda code: [(i, x) for i, x in enumerate(S.identifiers(code))]
    return G.per_cell(python_cells(spark, d), rows, "ordinal int, name string").groupBy("name").agg(F.count("*").alias("cells"), F.min("ordinal").alias("first"))


def f04_without_c_comments(spark: SparkSession, d: str) -> DataFrame:
    """Texts without the comments of C-like languages; quoted strings stay."""
    docs = table(spark, d, "documents").where("text is not null")
    bare = A.without_c_comments(F.col("text"))
    return docs.select("doc_id", F.length(bare).alias("letters"), F.md5(bare).alias("digest"))


def f06_stripped_ends(spark: SparkSession, d: str) -> DataFrame:
    """Line ends of the segments once every cell is stripped of comments and docstrings."""
    def rows(text):
        bare = C.strip_comments(text)
        kept = text if bare is None else bare
        return [(len(kept.split("\n")) if kept else 0,)]

    lines = G.per_cell(python_cells(spark, d), rows, "n int")
    sizes = lines.join(python_places(spark, d), ["notebook_id", "cell_id"]).groupBy("notebook_id", "segment_id").agg(F.sum("n").alias("n"))
    out = ordered.running(sizes, "notebook_id", "segment_id", end=("sum", F.col("n"), True))
    return out.select("notebook_id", "segment_id", (F.col("end") - 1).alias("line_end"))


def p25_import_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold the words from or import anywhere."""
    found = F.filter("content", lambda x: x.contains("from") | x.contains("import"))
    n = F.when(F.col("content").isNotNull(), F.size(found)).otherwise(0)
    code = cells(spark, d, "notebook_id", "type", n.alias("n")).where("type = 'code'")
    return code.groupBy("notebook_id").agg(F.sum("n").alias("lines"))


#: What a notebook may take for granted.
INSTALLED = ("numpy", "pandas", "matplotlib", "seaborn", "sklearn", "scipy", "os", "re", "json", "datetime", "time", "warnings", "gc", "random")


def f40_missing_modules(spark: SparkSession, d: str) -> DataFrame:
    """Imported modules that are not installed, with the notebooks that need them."""
    names = F.transform("content", lambda x: F.regexp_extract(x, r"^\s*(?:import|from)\s+([A-Za-z_]\w*)", 1))
    missing = F.array_distinct(F.filter(names, lambda n: (n != "") & ~n.isin(*INSTALLED)))
    code = cells(spark, d, "notebook_id", "type", missing.alias("missing")).where("type = 'code'")
    return code.select("notebook_id", F.explode("missing").alias("module")).groupBy("module").agg(F.count_distinct("notebook_id").alias("notebooks"))


QUERIES = {
    f.__name__: f
    for f in (
        t03_leaf_spans, t53_leaf_spans_without_comments, t04_variable_spans, f07_span_texts, f09_character_spans, t05_travelled, t31_connected_flow, t32_features, t33_attention, t56_pair_features,
        t18_preprocessed, t21_tree_ends, t36_shallow_input, f42_renamed, f43_identifiers, f04_without_c_comments, f06_stripped_ends, p25_import_lines, f40_missing_modules,
    )
}

ORACLE_SQL = {
    "f09_character_spans": "SELECT doc_id, text[1:greatest(instr(text, ' ') - 1, 0)] AS word FROM documents WHERE text IS NOT NULL",
    "t36_shallow_input": SQL + """v AS (SELECT _id, list_distinct(list_filter(segment_ends, lambda e: e >= 0)) AS ends FROM nested WHERE segment_ends IS NOT NULL AND n_ast_children_of_segments > 0)
SELECT _id, i::INT AS position, list_contains(ends, i)::INT AS y FROM v, unnest(range(0, list_max(ends) + 1)) AS t(i) WHERE len(ends) > 0""",
    "p25_import_lines": SQL + "x AS (SELECT 1) SELECT notebook_id, sum(coalesce(len(list_filter(content, lambda x: contains(x, 'from') OR contains(x, 'import'))), 0))::BIGINT AS lines FROM cells WHERE type = 'code' GROUP BY 1",
    "f40_missing_modules": SQL + rf"""m AS (SELECT notebook_id, regexp_extract(unnest(content), '^\s*(?:import|from)\s+([A-Za-z_]\w*)', 1) AS module FROM cells WHERE type = 'code')
SELECT module, count(DISTINCT notebook_id) AS notebooks FROM m WHERE module <> '' AND module NOT IN {INSTALLED} GROUP BY 1""",
    "f04_without_c_comments": r"""WITH b AS (SELECT doc_id, regexp_replace(text, '("(?:\\(?:.|\n)|[^\\"])*"|''(?:\\(?:.|\n)|[^\\''])*'')|//[^\n]*|/\*(?:.|\n)*?\*/', '\1' || chr(1), 'g') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, replace(regexp_replace(t, '(["''])' || chr(1), '\1', 'g'), chr(1), ' ') AS t FROM b),
l AS (SELECT doc_id, array_to_string(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')), chr(10)) AS t FROM c)
SELECT doc_id, length(t)::INT AS letters, md5(t) AS digest FROM l""",
}
