"""Queries that build, convert and cut segments from predicted boundaries, and a few more filters and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notebrook.functions import arrays as A
from notebrook.operators import codegraph, ordered
from notebrook.plans.codequeries import python_cells, python_places
from notebrook.plans.corpus import SQL, cells, nested, notebooks
from notebrook.plans.vectors import j15_nearest
from notebrook.session import ensure_checkpoint_dir, table, written


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    """Code cells with lines and whether a predictor closes a segment after them: every third of the first ten, then all."""
    at = ordered.gap_segments(cells(spark, d, "notebook_id", "cell_id", "type", F.coalesce(F.size("content"), F.lit(0)).alias("lines")), "lines")
    return at.withColumn("closes", ((F.col("pos") >= 10) | (F.col("pos") % 3 == 2)).cast("int"))


def w13_built_from_cell_ends(spark: SparkSession, d: str) -> DataFrame:
    """Segments by the predicted cell ends; cells beyond the prediction close themselves."""
    out = ordered.running(_predicted(spark, d), "notebook_id", "cell_id", part=("sum", F.col("closes"), False))
    return out.groupBy("notebook_id", "part").agg(F.count("*").alias("n_cells"), F.sum("lines").alias("lines"))


def w14_closed_segments(spark: SparkSession, d: str) -> DataFrame:
    """As w13, but what no end closes is dropped."""
    out = ordered.running(_predicted(spark, d), "notebook_id", "cell_id", part=("sum", F.col("closes"), False))
    return out.groupBy("notebook_id", "part").agg(F.sum("lines").alias("lines"), F.max("closes").alias("closed")).where("closed = 1").select("notebook_id", "part", "lines")


def w15_line_ends(spark: SparkSession, d: str) -> DataFrame:
    """Line number at each predicted end: lines of all parts up to it but the first, which the reference leaves out too."""
    out = ordered.running(_predicted(spark, d), "notebook_id", "cell_id", line_end=("sum", F.when(F.col("pos") > 0, F.col("lines")).otherwise(0), True))
    return out.where("closes = 1").select("notebook_id", "pos", F.col("line_end").cast("bigint"))


def w22_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a hundred notebooks of a source in the order of their numbers."""
    books = nested(spark, d, "notebook_id", "dataset").select("dataset", "notebook_id").distinct()
    out = ordered.running(books, "dataset", "notebook_id", block=None, rank=("sum", F.lit(1), False))
    return out.groupBy("dataset", F.floor(F.coalesce("rank", F.lit(0)) / 100).alias("chunk")).agg(F.count("*").alias("n"), F.min("notebook_id").alias("first"), F.max("notebook_id").alias("last"))


def w24_line_ranges(spark: SparkSession, d: str) -> DataFrame:
    """[start, stop) of each part that the ends cut, the tail included."""
    books = nested(spark, d, "segment_ends", "n_ast_children_of_segments").where("segment_ends is not null and n_ast_children_of_segments > 0")
    n = F.col("n_ast_children_of_segments")
    sizes = A.segment_sizes(F.filter(A.clean_ends(F.col("segment_ends")), lambda e: e < n), n)
    ends = A.sizes_to_ends(sizes)
    ranges = F.transform(ends, lambda e, i: F.struct(F.when(i > 0, F.try_element_at(ends, i) + 1).otherwise(0).alias("start"), (e + 1).alias("stop")))
    return books.select("_id", F.inline(ranges))


def p12_many_ends(spark: SparkSession, d: str) -> DataFrame:
    books = nested(spark, d, "segment_ends").where("segment_ends is not null").withColumn("v", A.ends_to_binary(F.col("segment_ends")))
    return books.where(F.size(F.filter("v", lambda x: x > 0)) > 5).select("_id", F.size("v").cast("bigint").alias("length"))


def p15_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Code lines of the segments without blank ones and trailing spaces, and cleaned ends."""
    code = F.flatten(F.transform("segments", lambda s: F.flatten(F.transform(F.filter(s["cells"], lambda c: c["type"] == "code"), lambda c: c["content"]))))
    lines = F.filter(F.transform(code, lambda x: F.rtrim(x)), lambda x: x != "")
    books = table(spark, d, "notebooksegments").where("segments is not null and segment_ends is not null")
    ends = F.array_join(A.ordered_ends(F.col("segment_ends")).cast("array<string>"), ",")
    return books.select("_id", F.size(lines).cast("bigint").alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("digest"), ends.alias("ends")).distinct()


def j10_heading_after_code(spark: SparkSession, d: str) -> DataFrame:
    """Whether some heading follows some code: the first code cell stands before the last heading."""
    c = cells(spark, d, "notebook_id", "cell_id", "type", ordered.has_heading(F.col("content")).alias("heading"))
    heading = (F.col("type") == "markdown") & F.col("heading")
    per_book = c.groupBy("notebook_id").agg(F.min(F.when(F.col("type") == "code", F.col("cell_id"))).alias("code"), F.max(F.when(heading, F.col("cell_id"))).alias("heading"))
    return per_book.select("notebook_id", F.coalesce(F.col("code") < F.col("heading"), F.lit(False)).alias("after"))


def a18_repeatable_cells(spark: SparkSession, d: str) -> DataFrame:
    """Of the cells delivered more than once, the share whose deliveries agree."""
    c = table(spark, d, "cell").groupBy("_id", "type").agg(F.count("*").alias("n"), F.count_distinct(F.to_json("content")).alias("forms")).where("n > 1")
    return c.groupBy("type").agg(F.count("*").alias("cells"), F.round(F.avg((F.col("forms") <= 1).cast("double")), 6).alias("ratio"))


def a08_cell_edges(spark: SparkSession, d: str) -> DataFrame:
    groups = python_places(spark, d).select("notebook_id", "cell_id", F.col("cell_id").alias("segment_id"))
    links = codegraph.edges(codegraph.references(python_cells(spark, d)), written(groups, "groups"))
    return links.select("notebook_id", "source", "target", F.array_join("names", ",").alias("names"))


def o09_largest(spark: SparkSession, d: str) -> DataFrame:
    """The twenty notebooks with most code."""
    b = notebooks(spark, d, "notebook_id", "n_code_lines").where("n_code_lines is not null")
    return b.orderBy(F.desc("n_code_lines"), "notebook_id").limit(20).select("notebook_id", "n_code_lines")


def s26_partitioned_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples written by split; the training part is read by its folder alone."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/samples-{uuid.uuid4().hex}"
    books = nested(spark, d, "notebook_id", "dataset", "split", "segment_ends").where("split is not null")
    books.withColumn("n_ends", F.coalesce(F.size("segment_ends"), F.lit(-1))).drop("segment_ends").write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).where("split = 'train'").groupBy("dataset").agg(F.count("*").alias("n"), F.sum("n_ends").alias("ends"))


def s30_vectors_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Vectors left after one label is removed, per label."""
    return table(spark, d, "embeddings").where("label != 1").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("mean_square"))


def m06_neighbour_regression(spark: SparkSession, d: str) -> DataFrame:
    """Mean label of the three nearest vectors beside the vector's own."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("neighbour"), "label")
    guess = j15_nearest(spark, d).join(labels, "neighbour").groupBy("query").agg(F.round(F.avg("label"), 6).alias("guess"))
    return guess.join(labels.select(F.col("neighbour").alias("query"), "label"), "query")


QUERIES = {
    f.__name__: f
    for f in (
        w13_built_from_cell_ends, w14_closed_segments, w15_line_ends, w22_chunks, w24_line_ranges, p12_many_ends, p15_ground_truth, j10_heading_after_code,
        a18_repeatable_cells, a08_cell_edges, o09_largest, s26_partitioned_samples, s30_vectors_by_label, m06_neighbour_regression,
    )
}

_PREDICTED = """predicted AS (SELECT g.notebook_id, g.cell_id, pos, coalesce(len(content), 0) AS lines, (pos >= 10 OR pos % 3 = 2)::INT AS closes
  FROM gapped g JOIN cells c ON g.notebook_id = c.notebook_id AND g.cell_id = c.cell_id AND type = 'code'),
built AS (SELECT *, coalesce(sum(closes) OVER (PARTITION BY notebook_id ORDER BY cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM predicted)"""
ORACLE_SQL = {
    "w13_built_from_cell_ends": SQL + _PREDICTED + " SELECT notebook_id, part, count(*) AS n_cells, sum(lines)::BIGINT AS lines FROM built GROUP BY ALL",
    "w14_closed_segments": SQL + _PREDICTED + " SELECT notebook_id, part, sum(lines)::BIGINT AS lines FROM built GROUP BY ALL HAVING max(closes) = 1",
    "w15_line_ends": SQL + _PREDICTED + " SELECT * FROM (SELECT notebook_id, pos, sum(CASE WHEN pos > 0 THEN lines ELSE 0 END) OVER (PARTITION BY notebook_id ORDER BY cell_id)::BIGINT AS line_end FROM built) WHERE (notebook_id, pos) IN (SELECT (notebook_id, pos) FROM built WHERE closes = 1)",
    "w22_chunks": SQL + """r AS (SELECT dataset, notebook_id, (row_number() OVER (PARTITION BY dataset ORDER BY notebook_id) - 1) // 100 AS chunk FROM (SELECT DISTINCT dataset, notebook_id FROM nested))
SELECT dataset, chunk, count(*) AS n, min(notebook_id) AS first, max(notebook_id) AS last FROM r GROUP BY ALL""",
    "w24_line_ranges": SQL + """cut AS (SELECT _id, n_ast_children_of_segments AS n, unnest(list_append(list_filter(segment_ends, lambda e: e >= 0 AND e < n_ast_children_of_segments), n_ast_children_of_segments - 1)) AS e
  FROM nested WHERE segment_ends IS NOT NULL AND n_ast_children_of_segments > 0), once AS (SELECT DISTINCT _id, e FROM cut)
SELECT _id, coalesce(lag(e) OVER (PARTITION BY _id ORDER BY e) + 1, 0) AS start, e + 1 AS stop FROM once""",
    "p12_many_ends": SQL + "x AS (SELECT 1) SELECT _id, (list_max(segment_ends) + 1)::BIGINT AS length FROM nested WHERE len(list_distinct(list_filter(segment_ends, lambda e: e >= 0))) > 5",
    "p15_ground_truth": SQL + """l AS (SELECT _id, flatten(flatten(list_transform(segments, lambda s: list_transform(list_filter(s.cells, lambda c: c.type = 'code'), lambda c: c.content)))) AS l, segment_ends AS e FROM nested WHERE segments IS NOT NULL AND segment_ends IS NOT NULL),
f AS (SELECT _id, list_filter(list_transform(l, lambda x: rtrim(x, ' ')), lambda x: x <> '') AS l, e FROM l)
SELECT _id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS digest, array_to_string(list_sort(list_distinct(list_filter(e, lambda x: x >= 0))), ',') AS ends FROM f""",
    "j10_heading_after_code": SQL + "x AS (SELECT 1) SELECT notebook_id, coalesce(min(cell_id) FILTER (type = 'code') < max(cell_id) FILTER (heading), FALSE) AS after FROM heads GROUP BY 1",
    "a18_repeatable_cells": "WITH c AS (SELECT _id, type, count(DISTINCT content) AS forms FROM cell GROUP BY ALL HAVING count(*) > 1) SELECT type, count(*) AS cells, round(avg((forms <= 1)::INT), 6) AS ratio FROM c GROUP BY 1",
    "o09_largest": SQL + "x AS (SELECT 1) SELECT notebook_id, n_code_lines FROM books WHERE n_code_lines IS NOT NULL ORDER BY n_code_lines DESC, notebook_id LIMIT 20",
    "s26_partitioned_samples": SQL + "x AS (SELECT 1) SELECT dataset, count(*) AS n, sum(coalesce(len(segment_ends), -1))::BIGINT AS ends FROM nested WHERE split = 'train' GROUP BY 1",
    "s30_vectors_by_label": "SELECT label, count(*) AS n, round(avg(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS mean_square FROM embeddings WHERE label <> 1 GROUP BY 1",
    "m06_neighbour_regression": """WITH d AS (SELECT q.vec_id AS query, q.label, r.label AS other, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), r.vec_id) AS rank
  FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id) SELECT query, label, round(avg(other), 6) AS guess FROM d WHERE rank <= 3 GROUP BY ALL""",
}
