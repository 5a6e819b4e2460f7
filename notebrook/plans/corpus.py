"""Deduplicated views of the corpus tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from notebrook.session import latest, table


def cells(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """The latest delivery of each cell, only these columns. Make numbers and flags of text here, so that the text is not shuffled."""
    return latest(table(spark, d, "cell").select("_id", *columns, "loaded_at"), ["_id"], "loaded_at").drop("loaded_at")


def notebooks(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    return latest(table(spark, d, "notebook").select("_id", *columns, "loaded_at"), ["_id"], "loaded_at").drop("loaded_at")


def segments(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """Repeated rows are equal."""
    return table(spark, d, "segment").select("_id", *columns).distinct()


def nested(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """notebooksegments; repeated rows are equal in the columns that queries use."""
    return table(spark, d, "notebooksegments").select("_id", *columns).distinct()


SQL = """WITH cells AS (SELECT * FROM cell QUALIFY row_number() OVER (PARTITION BY _id ORDER BY loaded_at DESC) = 1),
books AS (SELECT * FROM notebook QUALIFY row_number() OVER (PARTITION BY _id ORDER BY loaded_at DESC) = 1),
parts AS (SELECT * FROM segment QUALIFY row_number() OVER (PARTITION BY _id) = 1),
nested AS (SELECT * FROM notebooksegments QUALIFY row_number() OVER (PARTITION BY _id) = 1),
code AS (SELECT DISTINCT notebook_id, cell_id FROM cells WHERE type = 'code'),
gaps AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce((cell_id - lag(cell_id) OVER w > 1)::INT, 0) AS opens FROM code WINDOW w AS (PARTITION BY notebook_id ORDER BY cell_id)),
gapped AS (SELECT notebook_id, cell_id, pos, sum(opens) OVER (PARTITION BY notebook_id ORDER BY cell_id)::BIGINT AS segment_id FROM gaps),
heads AS (SELECT *, type = 'markdown' AND coalesce(len(list_filter(content, lambda x: starts_with(x, '#'))) > 0, FALSE) AS heading FROM cells),
kept AS (SELECT *, lag(type) OVER (PARTITION BY notebook_id ORDER BY cell_id) AS before FROM heads WHERE heading OR type = 'code'),
headed AS (SELECT h.*, sum(CASE WHEN h.heading AND k.before = 'code' THEN 1 ELSE 0 END) OVER (PARTITION BY h.notebook_id ORDER BY h.cell_id)::BIGINT AS segment_id
  FROM heads h LEFT JOIN kept k ON h._id = k._id),
"""
