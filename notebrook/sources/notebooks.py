"""Notebook files: reading both versions of the JSON format, and writing cells back as notebooks.

Files that are no JSON or have no cells give no rows (they can be listed with ``broken``). ``source`` may be a list of lines
or one string; cells without text are left out, positions stay those of the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CELL = "struct<cell_type string, source string, input string, execution_count int, outputs string>"
_FILE = f"struct<cells array<{_CELL}>, worksheets array<struct<cells array<{_CELL}>>>, metadata struct<language_info struct<name string, version string>>>"


def _text(column: Column) -> Column:
    """A list of lines or a string, as one string."""
    lines = F.from_json(column, "array<string>")
    return F.when(F.startswith(column, F.lit("[")) & lines.isNotNull(), F.array_join(lines, "")).otherwise(column)


def _files(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ipynb").text(path, wholetext=True)
    return text.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.ipynb$", 1).alias("name"), F.from_json("value", _FILE).alias("n"))


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """name, cell_id, type, content, execution_count, language of every cell with text."""
    nested = _files(spark, path).select("name", F.coalesce("n.cells", F.col("n.worksheets")[0]["cells"]).alias("cells"), F.col("n.metadata.language_info.name").alias("language"))
    flat = nested.select("name", "language", F.posexplode("cells").alias("cell_id", "c"))
    out = flat.select("name", "cell_id", F.col("c.cell_type").alias("type"), _text(F.coalesce("c.source", "c.input")).alias("text"), F.col("c.execution_count").alias("execution_count"), "language")
    return out.where(F.trim("text") != "").select("name", "cell_id", "type", F.split("text", "\n").alias("content"), "execution_count", "language")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """Names of files without readable cells."""
    return _files(spark, path).where("n is null or (n.cells is null and n.worksheets is null)").select("name")


def to_files(cells: DataFrame, key: str, page: int = 1000) -> DataFrame:
    """key, page, text: the JSON of a notebook's cells, one row for each ``page`` positions, so that no file grows with a notebook.
    cells has key, cell_id, type, content, and execution_count and outputs if they are recorded."""
    lines = F.transform("content", lambda x, i: F.when(i < F.size("content") - 1, F.concat(x, F.lit("\n"))).otherwise(x))
    recorded = [c for c in ("execution_count", "outputs") if c in cells.columns]
    cell = F.struct("cell_id", F.struct(F.col("type").alias("cell_type"), F.coalesce(lines, F.array().cast("array<string>")).alias("source"), *recorded).alias("c"))
    books = cells.groupBy(key, F.floor(F.col("cell_id") / page).alias("page")).agg(F.array_sort(F.collect_list(cell), _by_cell).alias("x"))
    body = F.struct(F.transform("x", lambda x: x["c"]).alias("cells"), F.lit(4).alias("nbformat"), F.lit(5).alias("nbformat_minor"))
    return books.select(key, "page", F.to_json(body).alias("text"))


def _by_cell(a: Column, b: Column) -> Column:
    return F.when(a["cell_id"] < b["cell_id"], -1).when(a["cell_id"] > b["cell_id"], 1).otherwise(0)


def pages(texts: DataFrame) -> DataFrame:
    """name, page, pos, type, text, execution_count, outputs of the cells in the JSON of ``to_files``; texts has name, page, text."""
    flat = texts.select("name", "page", F.from_json("text", _FILE).alias("n")).select("name", "page", F.posexplode("n.cells").alias("pos", "c"))
    return flat.select("name", "page", "pos", F.col("c.cell_type").alias("type"), _text(F.col("c.source")).alias("text"), F.col("c.execution_count").alias("execution_count"), F.col("c.outputs").alias("outputs"))


def output_text(outputs: Column) -> Column:
    """Text of a cell's recorded outputs: of each its text, else its image, else its plain data; without outputs the empty text."""
    found = F.from_json(outputs, "array<struct<text string, data struct<`image/png` string, `text/plain` string>>>")
    one = lambda o: F.coalesce(_text(o["text"]), o["data"]["image/png"], _text(o["data"]["text/plain"]), F.lit(""))
    return F.coalesce(F.array_join(F.transform(found, one), ""), F.lit(""))


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    """name, language, version (major and minor number) as the files' metadata have it; null where they have not."""
    found = F.nullif(F.regexp_extract("n.metadata.language_info.version", r"^(\d+\.\d+)", 1), F.lit(""))
    return _files(spark, path).select("name", F.col("n.metadata.language_info.name").alias("language"), found.alias("version"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """name, page, pos, type, text of the cells in the files that ``to_files`` gave, written by name and page; (page, pos) is the
    order of the cells in a notebook."""
    at = lambda part: F.regexp_extract("_metadata.file_path", rf"{part}=(\d+)/", 1).cast("bigint").alias(part)
    return pages(spark.read.text(path, wholetext=True).select(at("name"), at("page"), F.col("value").alias("text"))).select("name", "page", "pos", "type", "text")
