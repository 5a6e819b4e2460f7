"""Queries over sources: rows that fail to parse and rows that load."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notebrook.session import ensure_checkpoint_dir, table
from notebrook.sources import records


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected(table(spark, d, "code_raw"))


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return records.loaded(table(spark, d, "code_raw"))


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The records written as the files they were cut from, assembled from their lines again and parsed: good rows and letters of their source
    per file. Where an unclosed quote stands before a record that could as well be its end, files cannot tell the two apart."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/raw-{uuid.uuid4().hex}"
    records.to_files(table(spark, d, "code_raw"), path)
    name = F.regexp_extract("file_name", "file_name=([^/]+)/", 1).alias("file_name")
    found = records.load_files(spark, f"{path}/*/*").where("reason is null").select(name, F.length("source").alias("n"))
    return found.groupBy("file_name").agg(F.count("*").alias("rows"), F.sum("n").alias("letters"))


_FIELD = r'(?:"(?:[^"]|"")*"|[^",][^",]*|)'
_NUM = r"^ *[0-9]+([.]0+)? *$"
# the record without its line end, its fields where it is well formed, and the first reason that holds
_PARSED = rf"""
WITH r AS (SELECT record_id, received_at, regexp_replace(record, '(\r\n|\n|\r)$', '') AS rec FROM code_raw),
w AS (SELECT *, regexp_full_match(rec, '(?s){_FIELD}(,{_FIELD})*') AS well, regexp_replace(rec, '(?s)"(?:[^"]|"")*"', '', 'g') AS bare FROM r),
f AS (SELECT *, length(bare) - length(replace(bare, ',', '')) + 1 AS n,
  CASE WHEN well THEN regexp_extract(rec, '(?s)^({_FIELD}),({_FIELD}),({_FIELD})$', ['a', 'b', 'c']) END AS x FROM w),
u AS (SELECT *, {", ".join(f'''CASE WHEN starts_with(x.{c}, '"') THEN replace(x.{c}[2:length(x.{c}) - 1], '""', '"') ELSE x.{c} END AS {c}''' for c in "abc")} FROM f),
v AS (SELECT *, CASE WHEN regexp_matches(a, '{_NUM}') THEN try_cast(regexp_extract(a, '[0-9]+') AS HUGEINT) END AS k,
  CASE WHEN regexp_matches(b, '{_NUM}') THEN try_cast(regexp_extract(b, '[0-9]+') AS HUGEINT) END AS i FROM u),
j AS (SELECT *, CASE WHEN rec IS NULL THEN 'column_count' WHEN NOT well THEN 'quoting' WHEN n <> 3 THEN 'column_count'
  WHEN k IS NULL OR i IS NULL OR k < 1 OR k > 9223372036854775807 OR i > 2147483647 OR regexp_full_match(c, '(?s)\s*') THEN 'invalid_value' END AS reason FROM v)
"""

QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p3_files)}
ORACLE_SQL = {
    "p3_found": _PARSED + "SELECT DISTINCT record_id, reason FROM j WHERE reason IS NOT NULL",
    "p3_files": _PARSED.replace("SELECT record_id, received_at,", "SELECT record_id, received_at, file_name,")
    + "SELECT file_name, count(*) AS rows, sum(length(c))::BIGINT AS letters FROM j WHERE reason IS NULL GROUP BY file_name",
    "p3_loaded": _PARSED + "SELECT k::BIGINT AS kernel_id, i::INT AS cell_id, c AS source, received_at AS loaded_at FROM j WHERE reason IS NULL",
}
