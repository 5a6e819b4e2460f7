"""Queries of the training-data problems, by name, for the driver's entry module."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from notebrook.llm import encoding, language, leaks, overlap, prose, syntax, tokenize
from notebrook.session import table

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(table(spark, d, "notebooksegments"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "notebooksegments"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "cell"), table(spark, d, "segment"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return language.label_report(table(spark, d, "cell"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.prose_in_cells(table(spark, d, "cell"), table(spark, d, "notebook"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return prose.prose_shares(table(spark, d, "cell"), table(spark, d, "notebook"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_notebooks(table(spark, d, "cell"), table(spark, d, "notebook"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.syntax_rates(table(spark, d, "cell"), table(spark, d, "notebook"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_corpus(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p6_tokens_per_source(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.corpus_tokens(table(spark, d, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_documents(table(spark, d, "documents"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.repaired(table(spark, d, "documents")).where("garbled").drop("garbled")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p2_found, p2_report, p4_found, p4_shares, p5_found, p5_rates,
        p6_ids, p6_tokens_per_source, p7_found, p7_report, p8_found, p8_restored,
    )
}
_BAGS = r"""WITH n AS (SELECT DISTINCT notebook_id, dataset, split, segments FROM notebooksegments WHERE split IN ('train', 'valid', 'test')),
s AS (SELECT notebook_id, dataset, split, unnest(segments) AS s FROM n), c AS (SELECT notebook_id, dataset, split, unnest(s.cells) AS c FROM s),
l AS (SELECT notebook_id, dataset, split, unnest(c.content) AS x FROM c WHERE c.type = 'code'),
b AS (SELECT notebook_id, dataset, split, regexp_replace(regexp_replace(x, '("[^"\\]*(?:\\.[^"\\]*)*"|''[^''\\]*(?:\\.[^''\\]*)*'')|#.*', '\1', 'g'), '\s+', '', 'g') AS x FROM l),
t AS (SELECT *, row_number() OVER (PARTITION BY notebook_id, split, x) AS k FROM b WHERE x <> ''),
z AS (SELECT notebook_id, split, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT e.notebook_id AS e, e.split AS side, e.dataset AS source, r.notebook_id AS r, count(*) AS m FROM t e JOIN t r ON e.x = r.x AND e.k = r.k AND r.split = 'train' AND e.split <> 'train' AND e.notebook_id <> r.notebook_id GROUP BY ALL),
p AS (SELECT m.*, m / (a.n + b.n - m) AS j FROM m JOIN z a ON m.e = a.notebook_id AND m.side = a.split JOIN z b ON m.r = b.notebook_id AND b.split = 'train' WHERE m / (a.n + b.n - m) >= 0.7)
"""
# NFC stands in for NFKC, which SQL lacks: they differ only in compatibility characters, which these passages don't have
_RUNS = r"""WITH i AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(passage)), '[\p{L}\p{N}_]+') AS w FROM eval_items WHERE passage IS NOT NULL),
d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
a AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS t(k)),
b AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS t(k)),
m AS (SELECT item_id, doc_id, count(*) AS n FROM a JOIN b USING (g) GROUP BY ALL), z AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1)
"""
ORACLE_SQL: dict[str, str] = {
    "p7_found": _RUNS + "SELECT item_id, doc_id FROM m",
    "p7_report": _RUNS + "SELECT m.item_id, count(*) AS documents, round(max(m.n / z.n), 6) AS largest_share FROM m JOIN z ON m.item_id = z.item_id GROUP BY 1",
    "p1_found": _BAGS + "SELECT DISTINCT least(e, r) AS id_a, greatest(e, r) AS id_b FROM p",
    "p1_report": _BAGS + "SELECT side AS split, source AS dataset, count(DISTINCT e) AS notebooks, count(*) AS pairs, count(*) FILTER (j = 1) AS exact_pairs FROM p GROUP BY ALL",
}
