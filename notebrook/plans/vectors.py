"""Queries over boundary vectors, metrics, embeddings, prompts, responses, models, streams and notebook files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notebrook.functions import arrays as A
from notebrook.functions import prompts as P
from notebrook.operators import models as M
from notebrook.operators import relational as R
from notebrook.operators import retrieval
from notebrook.plans.corpus import SQL, cells, nested, notebooks
from notebrook.session import ensure_checkpoint_dir, table
from notebrook.sources import notebooks as files
from notebrook.streaming import ingest


def _ends(spark: SparkSession, d: str, *more: str) -> DataFrame:
    books = nested(spark, d, "segment_ends", "n_ast_children_of_segments", *more).where("segment_ends is not null and n_ast_children_of_segments > 0")
    return books.withColumn("n", F.col("n_ast_children_of_segments"))


def _joined(column) -> F.Column:
    return F.array_join(column.cast("array<string>"), "")


def f20_binary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    b = _ends(spark, d).withColumn("v", A.to_binary(F.col("segment_ends"), F.col("n")))
    return b.select("_id", _joined(F.col("v")).alias("bits"), F.array_join(A.to_ends(F.col("v")).cast("array<string>"), ",").alias("ends"))


def f24_padded(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of exactly 32 positions with their mask; cut ones are filled again."""
    b = _ends(spark, d).withColumn("v", A.ends_to_binary(F.col("segment_ends")))
    return b.select("_id", _joined(A.padded(F.col("v"), 32)).alias("padded"), _joined(A.cut(F.col("v"), F.lit(16), 32)).alias("cut"), _joined(F.transform(A.padding_mask(F.size("v"), 32), lambda x: x.cast("int"))).alias("mask"))


def a10_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A segmenter that ends a stage every five statements, scored against the recorded ends, per source."""
    b = _ends(spark, d, "dataset").withColumn("truth", A.to_binary(F.col("segment_ends"), F.col("n")))
    b = b.withColumn("guess", F.transform(A.positions(F.col("n")), lambda i: (i % 5 == 4).cast("int")))
    scored = b.select("dataset", A.jaccard_similarity(F.col("truth"), F.col("guess")).alias("j"), A.hamming(F.col("truth"), F.col("guess")).alias("h"), A.wasserstein_count(F.col("truth"), F.col("guess")).alias("w"))
    return scored.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg("j"), 6).alias("jaccard"), F.round(F.avg("h"), 6).alias("hamming"), F.round(F.avg("w"), 6).alias("wasserstein"))


def f11_response_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of the model responses among the documents."""
    r = table(spark, d, "documents").where("kind = 'response' and text is not null").select("doc_id", P.response_segments(F.col("text")).alias("s"))
    return r.select("doc_id", F.size("s").cast("bigint").alias("n"), F.coalesce(F.length(F.array_join("s", "")), F.lit(0)).cast("bigint").alias("chars"))


def f11_fenced_blocks(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(A.fenced_blocks(F.col("text"))).alias("block", "code"))
    return r.select("doc_id", "block", F.length("code").cast("bigint").alias("chars"))


def f14_blocks_at_comments(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.when((F.col("type") == "code") & F.col("content").isNotNull(), F.size(A.split_at_comments(F.col("content"))).cast("bigint"))
    return cells(spark, d, blocks.alias("blocks")).where("blocks is not null")


def f16_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts over the code of every notebook with its first segment as example."""
    code = F.transform("segments", lambda s: F.array_join(F.flatten(F.transform(F.filter(s["cells"], lambda c: c["type"] == "code"), lambda c: c["content"])), "\n"))
    b = table(spark, d, "notebooksegments").where("segments is not null").withColumn("code", code)
    text = P.prompt(F.array_join("code", "\n"), think=True, example=P.annotated(F.slice("code", 1, 1)))
    return b.select("_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest")).distinct()


def f01_document_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", r"\r\n|\r|\n")
    docs = table(spark, d, "documents").where("text is not null and text != ''")
    return docs.select("doc_id", F.size(lines).cast("bigint").alias("lines"), F.size(F.filter(lines, lambda x: F.trim(x) != "")).cast("bigint").alias("filled"))


def f44_previews(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, A.preview(F.col("content")).alias("preview")).where("preview is not null")


def f34_model_size(spark: SparkSession, d: str) -> DataFrame:
    """Parameters of an encoder with a layer for each statement of a measured notebook, width 96, inner width 64 and 1000 words, and how many
    measurements ask for it."""
    layers, h, i, v = F.col("n_ast_children").cast("bigint"), 96, 64, 1000
    block = 4 * (h * h + h) + 2 * h * i + h + i + 4 * h
    sizes = table(spark, d, "profile").where("n_ast_children is not null").groupBy("n_ast_children").agg(F.count("*").alias("n"))
    return sizes.select("n_ast_children", "n", (layers * block + v * h + 512 * h).alias("parameters"))


def j15_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of every vector whose id is divisible by twenty, among all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    found = retrieval.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 3)
    return found.select("query", F.col("rank").cast("bigint").alias("rank"), "neighbour", F.round("distance", 5).alias("distance"))


def s29_new_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return retrieval.new_vectors(e, e.where("label < 3"), "vec_id")


def f33_scaled(spark: SparkSession, d: str) -> DataFrame:
    """Measurements standardised over the table, method one-hot."""
    p = table(spark, d, "profile").where("n_ast_children is not null")
    s = p.agg(F.avg("n_ast_children").alias("m"), F.stddev_pop("n_ast_children").alias("s"))
    hot = [(F.col("method") == x).cast("int").alias(f"is_{x}") for x in ("fewshot", "tree")]
    return p.join(F.broadcast(s)).select("notebook_id", "dataset", "method", "model", "measured_at", F.round((F.col("n_ast_children") - F.col("m")) / F.col("s"), 6).alias("z"), *hot)


def m04_tree_models(spark: SparkSession, d: str) -> DataFrame:
    """What the tree models say of every held-out vector, beside its label."""
    guesses = [M.vector_guesses(table(spark, d, "embeddings"), k).withColumn("model", F.lit(k)) for k in ("tree", "forest", "boosting")]
    return guesses[0].unionByName(guesses[1]).unionByName(guesses[2])


def m18_regression(spark: SparkSession, d: str) -> DataFrame:
    """The duration that a regression on the statements foresees for each held-out measurement, beside the measured one."""
    p = table(spark, d, "profile").select("notebook_id", "measured_at", F.col("n_ast_children").cast("double").alias("n"), "st_time").where("not isnan(st_time)")
    return M.regression_guesses(p, "notebook_id", ["n"], "st_time").select("notebook_id", "measured_at", "st_time", "guess")


def st_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return ingest.window_counts(spark, f"{d}/events.parquet*", table(spark, d, "events").schema, "1 day").select(F.col("starts").cast("timestamp_ntz").alias("starts"), "event_type", "n", "total")


def st_latest_profile(spark: SparkSession, d: str) -> DataFrame:
    keys = ["notebook_id", "dataset", "method", "model"]
    p = ingest.latest_rows(spark, f"{d}/profile.parquet*", table(spark, d, "profile").schema, keys, "measured_at")
    return p.select(*keys, "n_ast_children", "st_time")


def st_first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Notebooks as they are delivered, each once, by a stream that forgets keys after the delay; per language."""
    schema = table(spark, d, "notebook").schema
    first = ingest.first_deliveries(spark, f"{d}/notebook.parquet*", schema, ["_id"], "loaded_at", "365 days")
    return first.groupBy("language").agg(F.count("*").alias("n"), F.min("notebook_id").alias("first"))


def s31_notebook_files(spark: SparkSession, d: str) -> DataFrame:
    """Selected notebooks written as files, a page of cells each, and read again: cells and lines of each."""
    chosen = notebooks(spark, d, "notebook_id", "selected").where("selected").select(F.col("_id").alias("notebook_id"), F.col("notebook_id").alias("name"))
    kids = R.spread_join(cells(spark, d, "notebook_id", "cell_id", "type", "content"), chosen, "notebook_id", "_id").select("name", "cell_id", "type", "content")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"
    files.to_files(kids, "name").select("text", F.col("name").cast("string").alias("name"), "page").write.partitionBy("name", "page").text(path)
    filled = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return files.read_pages(spark, path).groupBy(F.col("name").alias("notebook_id")).agg(F.count("*").alias("n_cells"), F.sum(filled).alias("n_lines"))


def s20_delete_and_recount(spark: SparkSession, d: str) -> DataFrame:
    """Cells left per type after the notebooks of one owner are removed."""
    gone = notebooks(spark, d, "user_name").where("user_name = 'autolog'").select(F.col("_id").alias("notebook_id"))
    return R.without(cells(spark, d, "notebook_id", "type"), gone, ["notebook_id"]).groupBy("type").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        f20_binary_round_trip, f24_padded, a10_metrics, f11_response_segments, f11_fenced_blocks, f14_blocks_at_comments, f16_prompts, f01_document_lines,
        f44_previews, f34_model_size, j15_nearest, s29_new_vectors, f33_scaled, m04_tree_models, m18_regression, st_window_counts, st_latest_profile, st_first_deliveries,
        s31_notebook_files, s20_delete_and_recount,
    )
}

_E = "b AS (SELECT *, n_ast_children_of_segments AS n FROM nested WHERE segment_ends IS NOT NULL AND n_ast_children_of_segments > 0)"
ORACLE_SQL = {
    "f20_binary_round_trip": SQL + _E + """ SELECT _id, array_to_string(list_transform(range(0, n), lambda i: list_contains(segment_ends, i)::INT), '') AS bits,
array_to_string(list_sort(list_distinct(list_filter(segment_ends, lambda e: e >= 0 AND e < n))), ',') AS ends FROM b""",
    "f24_padded": SQL + _E + """, v AS (SELECT _id, list_transform(range(0, coalesce(list_max(segment_ends), -1) + 1), lambda i: list_contains(segment_ends, i)::INT) AS v FROM b)
SELECT _id, rpad(array_to_string(v[1:32], ''), 32, '0') AS padded, rpad(array_to_string(v[1:16], ''), 32, '0') AS cut, repeat('0', least(32, len(v))) || repeat('1', greatest(0, 32 - len(v))) AS mask FROM v""",
    "a10_metrics": SQL + _E + """, p AS (SELECT _id, dataset, list_contains(segment_ends, i)::INT AS t, (i % 5 = 4)::INT AS g FROM b, unnest(range(0, n)) AS u(i)),
s AS (SELECT _id, dataset, sum((t <> g)::INT) AS h, sum((t + g > 0)::INT) AS e, abs(sum(t) - sum(g)) AS w FROM p GROUP BY ALL)
SELECT dataset, count(*) AS n, round(avg(CASE WHEN e = 0 THEN 1.0::DOUBLE ELSE 1 - h::DOUBLE / e END), 6) AS jaccard, round(avg(h), 6) AS hamming, round(avg(w), 6) AS wasserstein FROM s GROUP BY dataset""",
    "f11_fenced_blocks": r"""WITH b AS (SELECT doc_id, regexp_extract_all(text, '(?s)```python\n(.*?)```', 1) AS x FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (i - 1)::INT AS block, length(x[i]) AS chars FROM b, unnest(range(1, len(x) + 1)) AS t(i)""",
    "f14_blocks_at_comments": SQL + """l AS (SELECT _id, i, content[i] AS x FROM cells, unnest(range(1, len(content) + 1)) AS t(i) WHERE type = 'code'),
f AS (SELECT _id, count(*) FILTER (starts_with(x, '#')) AS marks, min(i) FILTER (starts_with(x, '#')) AS first, min(i) FILTER (x <> '') AS filled FROM l GROUP BY 1)
SELECT c._id, CASE WHEN filled IS NULL THEN 0 WHEN first IS NULL THEN 1 WHEN first = filled THEN marks ELSE marks + 1 END AS blocks FROM cells c LEFT JOIN f ON c._id = f._id WHERE type = 'code' AND content IS NOT NULL""",
    "f16_prompts": SQL + f"""s AS (SELECT _id, list_transform(segments, lambda s: array_to_string(flatten(list_transform(list_filter(s.cells, lambda c: c.type = 'code'), lambda c: c.content)), chr(10))) AS code FROM nested WHERE segments IS NOT NULL),
p AS (SELECT _id, '{P.TASK}' || chr(10) || chr(10) || 'Example:' || chr(10) || CASE WHEN len(code) > 0 THEN 'Stage 1:' || chr(10) || '```python' || chr(10) || code[1] || chr(10) || '```' ELSE '' END || chr(10) || chr(10)
  || 'Notebook:' || chr(10) || '```python' || chr(10) || array_to_string(code, chr(10)) || chr(10) || '```' || chr(10) || chr(10) || '{P.THINK}' AS t FROM s)
SELECT DISTINCT _id, length(t) AS chars, md5(t) AS digest FROM p""",
    "f01_document_lines": r"""WITH l AS (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents WHERE text IS NOT NULL AND text <> '')
SELECT doc_id, len(l) AS lines, len(list_filter(l, lambda x: trim(x, ' ') <> '')) AS filled FROM l""",
    "f44_previews": SQL + "p AS (SELECT _id, array_to_string(content, ' ') AS t FROM cells WHERE content IS NOT NULL) SELECT _id, CASE WHEN length(t) > 80 THEN t[1:80] || '...' ELSE t END AS preview FROM p",
    "f34_model_size": "SELECT n_ast_children, count(*) AS n, n_ast_children::BIGINT * (4 * (96 * 96 + 96) + 2 * 96 * 64 + 96 + 64 + 4 * 96) + 1000 * 96 + 512 * 96 AS parameters FROM profile WHERE n_ast_children IS NOT NULL GROUP BY n_ast_children",
    "j15_nearest": """WITH d AS (SELECT q.vec_id AS query, r.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS x FROM embeddings q, embeddings r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY x, neighbour) AS rank, neighbour, round(x, 5) AS distance FROM d QUALIFY rank <= 3""",
    "s29_new_vectors": "SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 3)",
    "f33_scaled": """SELECT notebook_id, dataset, method, model, measured_at, round((n_ast_children - avg(n_ast_children) OVER ()) / stddev_pop(n_ast_children) OVER (), 6) AS z, (method = 'fewshot')::INT AS is_fewshot, (method = 'tree')::INT AS is_tree FROM profile WHERE n_ast_children IS NOT NULL""",
    "st_window_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "st_latest_profile": "SELECT notebook_id, dataset, method, model, n_ast_children, st_time FROM profile QUALIFY row_number() OVER (PARTITION BY notebook_id, dataset, method, model ORDER BY measured_at DESC, n_ast_children DESC) = 1",
    "st_first_deliveries": SQL + "x AS (SELECT 1) SELECT language, count(*) AS n, min(notebook_id) AS first FROM books GROUP BY 1",
    "s31_notebook_files": SQL + """c AS (SELECT b.notebook_id, k.content FROM books b JOIN cells k ON b._id = k.notebook_id WHERE selected)
SELECT notebook_id, count(*) AS n_cells, sum(CASE WHEN coalesce(array_to_string(content, chr(10)), '') = '' THEN 0 ELSE len(content) END)::BIGINT AS n_lines FROM c GROUP BY 1""",
    "s20_delete_and_recount": SQL + "x AS (SELECT 1) SELECT type, count(*) AS n FROM cells WHERE notebook_id NOT IN (SELECT _id FROM books WHERE user_name = 'autolog') GROUP BY 1",
}
