"""Queries that write files and read them again: delimited code, responses, predictions, clone pairs, chunks, recorded outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notebrook.functions import arrays as A
from notebrook.operators import ordered
from notebrook.operators import relational as R
from notebrook.plans.corpus import SQL, cells, nested, notebooks, segments
from notebrook.session import ensure_checkpoint_dir, table
from notebrook.sources import notebooks as files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: How delimited code is written and read: quotes are doubled, fields may hold line breaks, null differs from empty.
_CSV = {"header": True, "escape": '"', "quoteAll": True, "multiLine": True, "emptyValue": "", "lineSep": "\n", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def s04_tagged_csv(spark: SparkSession, d: str) -> DataFrame:
    """Code and markdown, each a folder of delimited files with kernel_id, cell_index, source, read and tagged with their type; empty sources are left out."""
    every = cells(spark, d, "notebook_id", "cell_id", "type", "content").where("content is not null")
    parts = []
    for kind in ("code", "markdown"):
        path = _folder(spark, kind)
        mine = every.where(F.col("type") == kind).select(F.col("notebook_id").alias("kernel_id"), F.col("cell_id").alias("cell_index"), F.array_join("content", "\n").alias("source"))
        mine.write.options(**_CSV).csv(path)
        parts.append(spark.read.schema("kernel_id string, cell_index int, source string").options(**_CSV).csv(path).withColumn("cell_type", F.lit(kind)))
    rows = parts[0].unionByName(parts[1]).where("source is not null and source != ''")
    return rows.select(F.col("kernel_id").alias("notebook_id"), F.col("cell_index").alias("cell_id"), "cell_type", F.length("source").alias("letters"))


def s27_responses(spark: SparkSession, d: str) -> DataFrame:
    """Responses in JSON files of five thousand numbers, named by their part of them, read back in the order of that number and joined with the recorded ends by it."""
    path = _folder(spark, "responses")
    docs = table(spark, d, "documents").where("kind = 'response' and text is not null and doc_id is not null").select("doc_id", "notebook_id", "text")
    docs.withColumn("file", F.floor(F.col("doc_id") / 5000)).repartition("file").write.partitionBy("file").json(path)
    number = F.regexp_extract("_metadata.file_path", r"file=(\d+)/", 1).cast("bigint").alias("number")
    found = spark.read.schema("doc_id bigint, notebook_id bigint, text string").json(f"{path}/*").select(number, "doc_id", "notebook_id", F.length("text").alias("letters"))
    truth = nested(spark, d, "notebook_id", "segment_ends").groupBy("notebook_id").agg(F.max(F.coalesce(F.size("segment_ends"), F.lit(-1))).alias("ends"))
    return found.join(truth, "notebook_id", "left").select("number", "doc_id", "letters", F.when(F.col("ends") >= 0, F.col("ends")).alias("ends"))


def s28_latencies(spark: SparkSession, d: str) -> DataFrame:
    """Measurements in JSON folders by source, two of them read and put together for the mean time by size of notebook."""
    path = _folder(spark, "latencies")
    table(spark, d, "profile").select("dataset", "n_ast_children", "st_time").write.partitionBy("dataset").json(path)
    read = lambda name: spark.read.schema("n_ast_children int, st_time double").json(f"{path}/dataset={name}").withColumn("dataset", F.lit(name))
    both = read("distilkaggle").unionByName(read("gh17")).where("n_ast_children is not null and not isnan(st_time)")
    return both.groupBy("dataset", F.floor(F.col("n_ast_children") / 32).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("st_time"), 6).alias("mean"))


def s45_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Predictions written as JSON by model, one model read back by its folder alone."""
    path = _folder(spark, "predictions")
    books = table(spark, d, "profile").where("n_ast_children is not null").select("notebook_id", "model", "n_ast_children").distinct()
    guess = F.transform(A.positions(F.col("n_ast_children")), lambda i: (i % 5 == 4).cast("int"))
    books.select("notebook_id", "model", guess.alias("guess")).write.partitionBy("model").json(path)
    model = table(spark, d, "profile").agg(F.min("model").alias("m")).first()["m"]
    back = spark.read.schema("notebook_id bigint, guess array<int>").json(f"{path}/model={model}")
    return back.select("notebook_id", F.size("guess").alias("positions"), F.size(A.to_ends(F.col("guess"))).alias("ends"))


def s33_clone_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts by number: the texts in JSON lines (idx, func), the pairs in tab-separated lines (a, b, label), joined on both sides."""
    path = _folder(spark, "clones")
    docs = table(spark, d, "documents").where("text is not null and notebook_id is not null and doc_id is not null").select("doc_id", "notebook_id", "kind", "text")
    docs.select(F.col("doc_id").alias("idx"), F.col("text").alias("func")).write.json(f"{path}/data")
    # each text with the first one about the same notebook
    first = docs.groupBy("notebook_id").agg(F.min(F.struct("doc_id", "kind")).alias("f"))
    pairs = docs.join(first, "notebook_id").where("doc_id != f.doc_id").select(F.col("f.doc_id").alias("a"), F.col("doc_id").alias("b"), (F.col("kind") == F.col("f.kind")).cast("int").alias("label"))
    pairs.write.csv(f"{path}/pairs", sep="\t")
    data = spark.read.schema("idx bigint, func string").json(f"{path}/data")
    side = lambda name: data.select(F.col("idx").alias(name), F.length("func").alias(f"n_{name}"))
    return spark.read.schema("a bigint, b bigint, label int").csv(f"{path}/pairs", sep="\t").join(side("a"), "a").join(side("b"), "b").select("a", "b", "label", "n_a", "n_b")


def s13_written_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments by headings written back with the key of their notebook and the keys of their cells, in pages of a thousand cell numbers, and read again."""
    path = _folder(spark, "segments")
    headed = ordered.heading_segments(cells(spark, d, "notebook_id", "cell_id", "type", ordered.has_heading(F.col("content")).alias("heading")))
    pages = headed.groupBy("notebook_id", "segment_id", F.floor(F.col("cell_id") / 1000).alias("page")).agg(
        F.bool_or(F.col("type") == "code").alias("has_code"), F.array_sort(F.collect_list(F.struct("cell_id", "_id"))).alias("x")
    )
    pages.select("notebook_id", "segment_id", "page", "has_code", F.transform("x", lambda c: c["_id"]).alias("cells")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("notebook_id", "segment_id", "page", "has_code", F.size("cells").cast("bigint").alias("n_cells"), F.md5(F.array_join("cells", ",")).alias("cells"))


def s12_replaced_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stored segments of the notebooks that were split anew are replaced by the new ones, all others stay: how many of each per notebook."""
    stored = segments(spark, d, "notebook_id", "segment_id").select("notebook_id", "segment_id")
    headed = ordered.heading_segments(cells(spark, d, "notebook_id", "cell_id", "type", ordered.has_heading(F.col("content")).alias("heading")))
    fresh = headed.select("notebook_id", "segment_id").distinct()
    anew = notebooks(spark, d, "language").where("language = 'python'").select(F.col("_id").alias("notebook_id"))
    fresh = fresh.join(anew, "notebook_id", "left_semi")
    out = R.without(stored, fresh, ["notebook_id"]).withColumn("fresh", F.lit(False)).unionByName(fresh.withColumn("fresh", F.lit(True)))
    return out.groupBy("notebook_id", "fresh").agg(F.count("*").alias("n"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """notebook_id, is_eda, chunk: notebooks in the order of their numbers, a hundred to a chunk."""
    books = notebooks(spark, d, "notebook_id", "is_eda").select("notebook_id", "is_eda", F.lit(0).alias("all"))
    out = ordered.running(books, "all", "notebook_id", block=None, rank=("sum", F.lit(1), False))
    return out.select("notebook_id", "is_eda", F.floor(F.coalesce("rank", F.lit(0)) / 100).alias("chunk"))


def a23_eda_per_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).groupBy("chunk").agg(F.count("*").alias("n"), F.count_if(F.col("is_eda")).alias("eda"))


def s25_merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk files listed by the number in their name, as text like the reference, and merged in that order."""
    path = _folder(spark, "chunks")
    _chunks(spark, d).repartition("chunk").write.partitionBy("chunk").parquet(path)
    back = spark.read.schema("notebook_id bigint, is_eda boolean").parquet(f"{path}/*")
    number = F.regexp_extract("_metadata.file_path", r"chunk=(\d+)/", 1).alias("name")
    return back.select("notebook_id", number).groupBy("name").agg(F.count("*").alias("n"), F.min("notebook_id").alias("first")).orderBy("name")


def s24_resumed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunk folders written by a run that stopped half way and by one that goes on: what is there already is neither written nor doubled."""
    path, chunks = _folder(spark, "resumed"), _chunks(spark, d)
    R.write_missing(chunks.where("chunk % 2 = 0"), path, "chunk")
    R.write_missing(chunks, path, "chunk")
    return spark.read.parquet(path).groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(F.count("*").alias("n"))


def p16_valid_rows(spark: SparkSession, d: str) -> DataFrame:
    """The measurements with a mask: in range, or without nulls."""
    p = table(spark, d, "profile")
    mask = A.valid_rows([F.col("n_ast_children").between(1, 256), F.col("st_time").between(0.0, 1.0)], [F.col("n_ast_children"), F.col("repr_time"), F.col("st_time")])
    return p.select("notebook_id", "dataset", "method", "model", "measured_at", mask.alias("valid"))


def _recorded(spark: SparkSession, d: str) -> DataFrame:
    """Cells read from notebook files that were written with execution counts (backwards, none for every fifth cell) and outputs (the first line as
    text or as plain data)."""
    every = cells(spark, d, "notebook_id", "cell_id", "type", "content")
    first = F.coalesce(F.try_element_at("content", F.lit(1)), F.lit(""))
    null = F.lit(None).cast("string")
    plain = F.struct(null.alias("text"), F.struct(null.alias("image/png"), first.alias("text/plain")).alias("data"))
    text = F.struct(first.alias("text"), F.lit(None).cast("struct<`image/png`: string, `text/plain`: string>").alias("data"))
    outputs = F.when(F.col("cell_id") % 2 == 0, F.array(text, plain)).otherwise(F.array(plain))
    count = F.when(F.col("cell_id") % 5 != 4, 100_000 - F.col("cell_id"))
    path = _folder(spark, "recorded")
    made = files.to_files(every.withColumn("execution_count", count).withColumn("outputs", outputs), "notebook_id")
    made.select("text", F.col("notebook_id").alias("name"), "page").write.partitionBy("page").json(path)
    return files.pages(spark.read.schema("text string, name string, page bigint").json(path))


def f36_output_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of the recorded outputs of every code cell: text, else image, else plain data, put together."""
    code = _recorded(spark, d).where("type = 'code'")
    return code.groupBy("name").agg(F.count("*").alias("cells"), F.sum(F.length(files.output_text(F.col("outputs")))).alias("letters"))


def p10_run_cells(spark: SparkSession, d: str) -> DataFrame:
    """Code cells that were run, by notebook and page in the order of their execution counts, as positions of the file."""
    run = _recorded(spark, d).where("type = 'code' and execution_count is not null")
    pages = run.groupBy("name", "page").agg(F.array_sort(F.collect_list(F.struct("execution_count", "pos"))).alias("x"))
    return pages.select("name", "page", F.size("x").alias("n"), F.array_join(F.transform("x", lambda c: c["pos"].cast("string")), ",").alias("places"))


#: Lines that make a notebook repeatable, and those that also stop its clock where no frame library needs it.
SEEDS = ("%matplotlib inline", "import random", "random.seed(100)", "import numpy", "numpy.random.seed(100)")
FROZEN = ("from freezegun import freeze_time", 'freezer = freeze_time("2012-01-14 12:00:01")', "freezer.start()")


def f38_repaired(spark: SparkSession, d: str) -> DataFrame:
    """First code cells with the lines that make their notebook repeatable put before them."""
    uses = F.coalesce(F.exists("content", lambda x: x.contains("pandas") | x.contains("seaborn")), F.lit(False)).alias("uses")
    code = cells(spark, d, "notebook_id", "cell_id", "type", uses).where("type = 'code'")
    books = code.groupBy("notebook_id").agg(F.min(F.struct("cell_id", "_id")).alias("first"), F.bool_or("uses").alias("uses"))
    text = table(spark, d, "cell").where("type = 'code'").select(F.col("_id").alias("key"), "loaded_at", F.array_join("content", "\n").alias("code"))
    firsts = books.select("notebook_id", "uses", F.col("first._id").alias("key")).join(text, "key").groupBy("notebook_id", "uses").agg(F.max_by("code", "loaded_at").alias("code"))
    lines = lambda x: F.array(*[F.lit(v) for v in x])
    fixed = F.when(F.col("uses"), lines(SEEDS)).otherwise(lines(FROZEN + SEEDS))
    return firsts.select("notebook_id", F.md5(F.array_join(F.concat(fixed, F.array(F.coalesce("code", F.lit("")))), "\n")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        s04_tagged_csv, s27_responses, s28_latencies, s45_predictions, s33_clone_pairs, s13_written_segments, s12_replaced_segments, a23_eda_per_chunk, s25_merged_chunks, s24_resumed_chunks,
        p16_valid_rows, f36_output_texts, p10_run_cells, f38_repaired,
    )
}

_RANKED = "r AS (SELECT notebook_id, is_eda, (row_number() OVER (ORDER BY notebook_id) - 1) // 100 AS chunk FROM books)"
_LINES = lambda lines: "[" + ", ".join("'" + x + "'" for x in lines) + "]"
ORACLE_SQL = {
    "s04_tagged_csv": SQL + "x AS (SELECT notebook_id, cell_id, type AS cell_type, array_to_string(content, chr(10)) AS s FROM cells WHERE type IN ('code', 'markdown')) SELECT notebook_id, cell_id, cell_type, length(s)::INT AS letters FROM x WHERE s <> ''",
    "s27_responses": SQL + """t AS (SELECT notebook_id, max(len(segment_ends)) AS ends FROM nested GROUP BY 1)
SELECT doc_id // 5000 AS number, doc_id, length(text)::INT AS letters, ends::INT AS ends FROM documents d LEFT JOIN t ON d.notebook_id = t.notebook_id WHERE kind = 'response' AND text IS NOT NULL""",
    "s28_latencies": "SELECT dataset, n_ast_children // 32 AS bin, count(*) AS n, round(avg(st_time), 6) AS mean FROM profile WHERE dataset IN ('distilkaggle', 'gh17') AND n_ast_children IS NOT NULL AND st_time IS NOT NULL AND NOT isnan(st_time) GROUP BY ALL",
    "s45_predictions": """WITH b AS (SELECT DISTINCT notebook_id, n_ast_children AS n FROM profile WHERE n_ast_children IS NOT NULL AND model = (SELECT min(model) FROM profile))
SELECT notebook_id, greatest(n, 0)::INT AS positions, (greatest(n, 0) // 5)::INT AS ends FROM b""",
    "s33_clone_pairs": """WITH d AS (SELECT doc_id, notebook_id, kind, length(text) AS n FROM documents WHERE text IS NOT NULL AND notebook_id IS NOT NULL), f AS (SELECT notebook_id, min(doc_id) AS doc_id FROM d GROUP BY 1)
SELECT a.doc_id AS a, b.doc_id AS b, (a.kind = b.kind)::INT AS label, a.n::INT AS n_a, b.n::INT AS n_b FROM f JOIN d a ON a.doc_id = f.doc_id JOIN d b ON b.notebook_id = f.notebook_id AND b.doc_id <> f.doc_id""",
    "s13_written_segments": SQL + """x AS (SELECT 1) SELECT notebook_id, segment_id, (cell_id // 1000)::BIGINT AS page, bool_or(type = 'code') AS has_code, count(*) AS n_cells, md5(string_agg(_id, ',' ORDER BY cell_id)) AS cells FROM headed GROUP BY 1, 2, 3""",
    "s12_replaced_segments": SQL + """anew AS (SELECT DISTINCT notebook_id, segment_id FROM headed WHERE notebook_id IN (SELECT _id FROM books WHERE language = 'python'))
SELECT notebook_id, FALSE AS fresh, count(*) AS n FROM parts WHERE notebook_id NOT IN (SELECT notebook_id FROM anew) GROUP BY 1 UNION ALL SELECT notebook_id, TRUE, count(*) FROM anew GROUP BY 1""",
    "a23_eda_per_chunk": SQL + _RANKED + " SELECT chunk, count(*) AS n, count(*) FILTER (is_eda) AS eda FROM r GROUP BY 1",
    "s24_resumed_chunks": SQL + _RANKED + " SELECT chunk, count(*) AS n FROM r GROUP BY 1",
    "s25_merged_chunks": SQL + _RANKED + " SELECT chunk::VARCHAR AS name, count(*) AS n, min(notebook_id) AS first FROM r GROUP BY 1",
    "p16_valid_rows": """SELECT notebook_id, dataset, method, model, measured_at, (coalesce(n_ast_children BETWEEN 1 AND 256, FALSE) AND coalesce(st_time BETWEEN 0 AND 1, FALSE)) OR (n_ast_children IS NOT NULL AND repr_time IS NOT NULL AND st_time IS NOT NULL) AS valid FROM profile""",
    "f36_output_texts": SQL + "x AS (SELECT notebook_id AS name, length(coalesce(content[1], '')) * CASE WHEN cell_id % 2 = 0 THEN 2 ELSE 1 END AS n FROM cells WHERE type = 'code') SELECT name, count(*) AS cells, sum(n)::BIGINT AS letters FROM x GROUP BY 1",
    "p10_run_cells": SQL + """p AS (SELECT *, cell_id // 1000 AS page, row_number() OVER (PARTITION BY notebook_id, cell_id // 1000 ORDER BY cell_id) - 1 AS pos FROM cells)
SELECT notebook_id AS name, page::BIGINT AS page, count(*)::INT AS n, string_agg(pos::VARCHAR, ',' ORDER BY cell_id DESC) AS places FROM p WHERE type = 'code' AND cell_id % 5 <> 4 GROUP BY 1, 2""",
    "f38_repaired": SQL + f"""b AS (SELECT notebook_id, min(cell_id) AS cell_id, bool_or(len(list_filter(content, lambda x: contains(x, 'pandas') OR contains(x, 'seaborn'))) > 0) AS uses FROM cells WHERE type = 'code' GROUP BY 1)
SELECT b.notebook_id, md5(array_to_string(list_append(CASE WHEN coalesce(uses, FALSE) THEN {_LINES(SEEDS)} ELSE {_LINES(FROZEN + SEEDS)} END, coalesce(array_to_string(content, chr(10)), '')), chr(10))) AS digest
FROM b JOIN cells c ON b.notebook_id = c.notebook_id AND b.cell_id = c.cell_id AND c.type = 'code'""",
}
