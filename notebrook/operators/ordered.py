"""Order-dependent operators: running values, segmentation by gaps and by headings.

A notebook may be large (one holds a tenth of all cells), so running values never gather a whole one in a task: its rows are cut
into blocks of positions, values run inside each block, the blocks are summed up, the few sums of keys with more than one block
are ordered, and each block goes on from there. The rows are shuffled once and written once, so the input is read a single time.

Nulls: rows without a key or a place in the order belong nowhere and are left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notebrook.operators.relational import FEW
from notebrook.session import written

BLOCK = 4096

_COMBINE = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, lambda a, b: F.greatest(a, b))}


def _continued(rows: DataFrame, key: str, carried: DataFrame) -> DataFrame:
    """rows with what their block carries on. carried is kept for the keys with several blocks only: written once, it is few rows unless most
    keys are large, and is broadcast up to FEW of them."""
    carried = written(carried.where("_blocks > 1").drop("_blocks"), "carried")
    return rows.join(F.broadcast(carried) if carried.count() <= FEW else carried, [key, "_block"], "left")


def running(df: DataFrame, key: str, *order: str, block: int | None = BLOCK, **values: tuple[str, Column, bool]) -> DataFrame:
    """Running sums and maxima along ``order`` (whole numbers, unique per key). values: name → (sum or max, column, whether the
    row itself counts). Blocks are ``block`` numbers wide. None where the numbers have wide gaps, or where the order is one of several columns,
    unique together: blocks are then ranges of about equally many rows, whatever the values."""
    df = df.where(F.col(key).isNotNull())
    if block is None:
        df = written(df.repartitionByRange(key, *order).withColumn("_block", F.spark_partition_id()), "ranges")
    else:
        df = df.where(F.col(order[0]).isNotNull()).withColumn("_block", F.floor(F.col(order[0]) / block))
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    kept = df.columns
    for name, (kind, column, own) in values.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        df = df.withColumn(f"_{name}", column).withColumn(name, _COMBINE[kind][0](f"_{name}").over(frame))
    df = written(df, "running")
    sums = df.groupBy(key, "_block").agg(*[_COMBINE[kind][0](f"_{name}").alias(f"_{name}") for name, (kind, _, _) in values.items()])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        key, "_block", *[_COMBINE[kind][0](f"_{name}").over(before).alias(f"_before_{name}") for name, (kind, _, _) in values.items()],
        F.count("*").over(Window.partitionBy(key)).alias("_blocks"),
    )
    df = _continued(df, key, carried)
    return df.select(*[c for c in kept if c != "_block"], *[_COMBINE[kind][1](F.col(f"_before_{name}"), F.col(name)).alias(name) for name, (kind, _, _) in values.items()])


def moving_average(df: DataFrame, key: str, order: list[str], column: str, size: int, name: str) -> DataFrame:
    """Mean of a row's value and those of the ``size - 1`` rows before it along ``order`` (unique per key). Rows are numbered, cut into blocks, and the last
    of each block also shown to the next."""
    rows = running(df, key, *order, block=None, _rank=("sum", F.lit(1), False)).withColumn("_rank", F.coalesce("_rank", F.lit(0)))
    block, at = F.floor(F.col("_rank") / BLOCK), F.col("_rank") % BLOCK
    seen = F.when(at > BLOCK - size, F.array(block, block + 1)).otherwise(F.array(block))
    window = Window.partitionBy(key, "_block").orderBy("_rank").rowsBetween(1 - size, 0)
    spread = rows.withColumn("_own", block).withColumn("_block", F.explode(seen)).withColumn(name, F.avg(column).over(window))
    return spread.where("_block = _own").drop("_own", "_block", "_rank")


def _opened(df: DataFrame, key: str, order: str, mark: Column, opens: Callable[[Column, Column], Column]) -> DataFrame:
    """df with segment_id, _rank (0-based, equal for equal ``order``), _prior (the last mark of the rows before) and _opens (whether the row
    opens its segment). Marks rise along ``order``; opens(prior, mark) says whether a segment starts at a marked row."""
    df = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).drop("segment_id")
    kept = df.columns
    inside = Window.partitionBy(key, "_block").orderBy(order)
    df = df.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumn("_mark", mark)
    df = df.withColumn("_in", F.dense_rank().over(inside) - 1).withColumn("_near", F.max("_mark").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_new", F.coalesce(opens(F.col("_near"), F.col("_mark")), F.lit(False)).cast("int"))
    df = written(df.withColumn("_parts", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0))), "opened")
    sums = df.groupBy(key, "_block").agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"), F.sum("_new").alias("_sum"), (F.max("_in") + 1).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    # the first marked row of a block opens a segment or not by the last marked one of the blocks before
    sums = sums.withColumn("_far", F.max("_last").over(before))
    sums = sums.withColumn("_at_first", F.coalesce(opens(F.col("_far"), F.col("_first")), F.lit(False)).cast("int"))
    carried = sums.select(
        key, "_block", "_far", "_at_first", F.sum("_n").over(before).alias("_n_before"), F.sum(F.col("_sum") + F.col("_at_first")).over(before).alias("_s_before"),
        F.count("*").over(Window.partitionBy(key)).alias("_blocks"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    first = F.col("_near").isNull() & F.col("_mark").isNotNull()
    reached = F.coalesce("_near", "_mark").isNotNull()
    return _continued(df, key, carried).select(
        *kept, (F.col("_in") + zero(F.col("_n_before"))).cast("bigint").alias("_rank"), F.coalesce("_near", "_far").alias("_prior"),
        ((F.col("_new") == 1) | (first & (zero(F.col("_at_first")) == 1))).alias("_opens"),
        (F.col("_parts") + zero(F.col("_s_before")) + F.when(reached, zero(F.col("_at_first"))).otherwise(0)).cast("bigint").alias("segment_id"),
    )


def prompted(cells: DataFrame) -> DataFrame:
    """notebook_id, prompted: whether something stands between code cells. Numbers leave a gap iff they span more than they
    count, so no order is needed."""
    code = cells.where("type = 'code'").groupBy("notebook_id", "cell_id").agg(F.lit(1).alias("one"))
    spans = code.groupBy("notebook_id").agg(F.count("*").alias("n"), (F.max("cell_id") - F.min("cell_id") + 1).alias("span"))
    return spans.select("notebook_id", (F.col("span") > F.col("n")).alias("prompted"))


def gap_segments(cells: DataFrame, *carried: str) -> DataFrame:
    """notebook_id, cell_id, pos (0-based among the code cells), opens (whether it is the first of a segment but the first one) and segment_id of
    the code cells: a segment ends before a gap in cell_id. ``carried``: further columns to keep. Of several rows for a cell one is kept."""
    code = cells.where("type = 'code'").select("notebook_id", "cell_id", *carried)
    out = _opened(code, "notebook_id", "cell_id", F.col("cell_id"), lambda before, mark: mark - before > 1)
    out = out.where("_prior is null or _prior < cell_id")
    return out.select("notebook_id", "cell_id", *carried, F.col("_rank").alias("pos"), F.col("_opens").alias("opens"), "segment_id")


def gap_ends(cells: DataFrame) -> DataFrame:
    """notebook_id, end: the last position of every segment but the final one, which is the one before a segment opens."""
    return gap_segments(cells).where("opens").select("notebook_id", (F.col("pos") - 1).alias("end"))


def has_heading(content: Column) -> Column:
    return F.coalesce(F.exists(content, lambda x: F.startswith(x, F.lit("#"))), F.lit(False))


def heading_segments(cells: DataFrame) -> DataFrame:
    """Cells with segment_id: a markdown cell with a heading line opens a segment if the cell before it, of those that are code
    or have a heading, is code. cells has notebook_id, cell_id, type and heading (see has_heading) or content; all columns are kept."""
    if "heading" not in cells.columns:
        cells = cells.withColumn("heading", has_heading(F.col("content")))
    code, heading = F.col("type") == "code", (F.col("type") == "markdown") & F.col("heading")
    # even marks are headings, odd ones code
    mark = F.when(code | heading, F.col("cell_id").cast("bigint") * 2 + code.cast("int"))
    return _opened(cells, "notebook_id", "cell_id", mark, lambda before, mark: (mark % 2 == 0) & (before % 2 == 1)).drop("_rank", "_prior", "_opens")


def segment_summary(segmented: DataFrame) -> DataFrame:
    """notebook_id, segment_id, n_cells, n_code, has_code, first_cell, last_cell, n_lines. segmented has lines, the lines of each cell."""
    code = F.col("type") == "code"
    return segmented.groupBy("notebook_id", "segment_id").agg(
        F.count("*").alias("n_cells"), F.count_if(code).alias("n_code"), (F.count_if(code) > 0).alias("has_code"),
        F.min("cell_id").alias("first_cell"), F.max("cell_id").alias("last_cell"),
        F.sum(F.when(code, F.greatest("lines", F.lit(0))).otherwise(0)).cast("bigint").alias("n_lines"),
    )


def running_ends(summary: DataFrame) -> DataFrame:
    """For segments with code: index of their last code cell and last code line in the notebook."""
    kept = summary.where("has_code")
    out = running(kept, "notebook_id", "segment_id", cells=("sum", F.col("n_code"), True), lines=("sum", F.col("n_lines"), True))
    return out.select("notebook_id", "segment_id", (F.col("cells") - 1).cast("bigint").alias("cell_end"), (F.col("lines") - 1).cast("bigint").alias("line_end"))


def prompts(cells: DataFrame, texts: DataFrame, on: list[str], page: int = 1000) -> DataFrame:
    """notebook_id, segment_id, page, prompts: markdown lines in order, one $CODE$ for each stretch of code between them. A row holds the
    cells of ``page`` numbers at most, so none grows with a segment. cells has notebook_id, cell_id, type, heading, lines (their number) and
    the columns ``on``, by which texts has their content; equal rows of texts count once."""
    code = F.col("type") == "code"
    placed = heading_segments(cells.withColumn("leaves", F.when(code | (F.col("lines") > 0), F.col("cell_id").cast("bigint") * 2 + code.cast("int"))))
    # the cell before, of those that leave a line, is in the same segment: one that opens a segment has a heading
    placed = running(placed, "notebook_id", "cell_id", last=("max", F.col("leaves"), False))
    none = F.array().cast("array<string>")
    mark = F.when(F.coalesce(F.col("last") % 2 == 1, F.lit(False)), none).otherwise(F.array(F.lit("$CODE$")))
    found = placed.join(texts, on).withColumn("page", F.floor(F.col("cell_id") / page))
    lines = F.struct("cell_id", F.when(F.col("type") == "code", mark).otherwise(F.coalesce("content", none)).alias("lines"))
    joined = found.groupBy("notebook_id", "segment_id", "page").agg(F.array_sort(F.collect_set(lines)).alias("x"))
    return joined.select("notebook_id", "segment_id", "page", F.flatten(F.transform("x", lambda c: c["lines"])).alias("prompts"))
