"""Code cells that are not valid in the language of their notebook (problem 5).

Every cell is parsed by every supported grammar, in the order of a token-based ranking. A cell that its notebook's language
rejects is flagged: a foreign parse that succeeds points to a wrong language, failure everywhere to damage. Nulls: a notebook without a language, or with an unsupported one, has no grammar to fail, so its cells count as valid;
null lines are skipped; null or empty content is valid; a cell whose notebook is unknown is left out. Rows delivered twice
count once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notebrook.llm.grammars import diagnose
from notebrook.operators.relational import spread_join
from notebrook.session import dealt

def with_language(cells: DataFrame, notebooks: DataFrame, *columns: str) -> DataFrame:
    """Cells with their notebook's language, number and repository. One notebook may hold a third of all cells: see spread_join. The
    columns of the cells are not shuffled where the notebooks are few enough to be broadcast."""
    books = (
        notebooks.groupBy(F.col("_id").alias("notebook_pk"))
        .agg(F.max(F.struct("loaded_at", F.col("notebook_id").alias("number"), "language", "repository")).alias("n"))
        .select("notebook_pk", F.col("n.number").alias("notebook_number"), F.lower("n.language").alias("language"), "n.repository")
    )
    slim = cells.select(F.col("_id").alias("cell_pk"), F.col("notebook_id").alias("notebook_pk"), *columns)
    return spread_join(slim, books, "notebook_pk", "cell_pk", rows=notebooks.count())


#: Results kept for code that comes again in the same task, and the longest code of which they are kept.
KNOWN, KNOWN_LENGTH = 20_000, 4_000
_known = lru_cache(KNOWN)(diagnose)


def _diagnosed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = zip(b.column(4).to_pylist(), b.column(2).to_pylist())
        found = [(_known if len(code) <= KNOWN_LENGTH else diagnose)(code, language) for code, language in pairs]
        new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.list_(pa.string())))]
        yield pa.RecordBatch.from_arrays([*b.columns[:4], *new], names=["notebook_number", "cell_pk", "language", "repository", "valid", "reason", "accepted"])


def cell_syntax(cells: DataFrame, notebooks: DataFrame) -> DataFrame:
    """notebook_number, cell_pk, language, repository, valid, reason, accepted (the grammars that take the cell, best first) and
    parses_as (of an invalid cell, the best of them)."""
    code = dealt(cells, "_id", "notebook_id", "type", "content").where("type = 'code'").withColumn("code", F.coalesce(F.array_join("content", "\n"), F.lit("")))
    joined = with_language(code, notebooks, "code").select("notebook_number", "cell_pk", "language", "repository", "code")
    schema = "notebook_number bigint, cell_pk string, language string, repository string, valid boolean, reason string, accepted array<string>"
    found = joined.mapInArrow(_diagnosed, schema)
    return found.withColumn("parses_as", F.when(~F.col("valid"), F.try_element_at("accepted", F.lit(1))))


def invalid_notebooks(cells: DataFrame, notebooks: DataFrame) -> DataFrame:
    """The numbers of the notebooks with a cell that is not valid."""
    return cell_syntax(cells, notebooks).where("not valid").select(F.col("notebook_number").alias("notebook_id")).distinct()


def syntax_rates(cells: DataFrame, notebooks: DataFrame) -> DataFrame:
    """Share of invalid cells and of damaged notebooks per repository and language."""
    # repeated deliveries are equal: they are judged where they are read, and only the verdicts are deduplicated
    per_cell = cell_syntax(cells, notebooks).select("repository", "language", "notebook_number", "cell_pk", "valid", "parses_as").dropDuplicates(["cell_pk"])
    per_book = per_cell.groupBy("repository", "language", "notebook_number").agg(
        F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("bad"), F.count_if(F.col("parses_as").isNotNull()).alias("foreign")
    )
    return per_book.groupBy("repository", "language").agg(
        F.count("*").alias("notebooks"), F.count_if(F.col("bad") > 0).alias("invalid_notebooks"), F.sum("n").alias("cells"),
        F.sum("bad").alias("invalid_cells"), F.sum("foreign").alias("foreign_cells"),
        F.round(F.sum("bad") / F.sum("n"), 6).alias("invalid_rate"),
    )
