"""Queries over scans, filters, joins, aggregations, set operations, updates and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notebrook.functions import arrays as A
from notebrook.operators import relational as R
from notebrook.operators.ordered import has_heading, running
from notebrook.plans.corpus import SQL, cells, nested, notebooks, segments
from notebrook.session import latest, table


def s05_notebook_scan(spark: SparkSession, d: str) -> DataFrame:
    return notebooks(spark, d, "notebook_id", "language", "prompted", "selected").where("prompted and selected and language = 'python'").select("notebook_id", "language")


def j01_nested_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every notebook with its cells nested in order, in pages; those without cells keep an empty one."""
    books = notebooks(spark, d, "notebook_id").withColumnRenamed("_id", "book")
    kids = cells(spark, d, "notebook_id", "cell_id", "type").select(F.col("notebook_id").alias("book"), "cell_id", "type")
    out = R.paged(books, kids, "book", "cell_id", "cells")
    shape = F.array_join(F.transform("cells", lambda c: F.substring(c["type"], 1, 1)), "")
    return out.select("notebook_id", "page", F.size("cells").cast("bigint").alias("n_cells"), shape.alias("shape"))


def j02_materialised_segments(spark: SparkSession, d: str) -> DataFrame:
    """notebook → segments → cells, nested again in pages of a thousand cell numbers, so that no row grows with a segment; notebooks without
    segments drop out, segments without known cells keep an empty page."""
    books = notebooks(spark, d, "notebook_id", "segments").where("size(segments) > 0").select("notebook_id", F.explode("segments").alias("segment"))
    parts = segments(spark, d, "segment_id", "has_code", "cells").select(F.col("_id").alias("segment"), "segment_id", "has_code", F.explode_outer("cells").alias("cell"))
    kids = cells(spark, d, "cell_id", "type").select(F.col("_id").alias("cell"), "cell_id", "type")
    flat = books.join(parts, "segment").join(kids, "cell", "left").withColumn("page", F.floor(F.coalesce("cell_id", F.lit(0)) / 1000))
    known = F.when(F.col("cell_id").isNotNull(), F.struct("cell_id", "type"))
    nest = flat.groupBy("notebook_id", "segment_id", "has_code", "page").agg(F.array_sort(F.collect_list(known)).alias("cells"))
    return nest.select("notebook_id", "segment_id", "has_code", "page", F.size("cells").cast("bigint").alias("n_cells"), F.array_join(F.transform("cells", lambda c: F.substring(c["type"], 1, 1)), "").alias("shape"))


def j05_pair_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents about the same notebook, each with the one before it by number; both sides must be there."""
    docs = table(spark, d, "documents").where("notebook_id is not null and text is not null").select("doc_id", "notebook_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("flat"))
    w = Window.partitionBy("notebook_id").orderBy("doc_id")
    pairs = docs.select("doc_id", F.lag("doc_id").over(w).alias("other"))
    left, right = docs.select("doc_id", F.length("flat").cast("bigint").alias("n_a")), docs.select(F.col("doc_id").alias("other"), F.length("flat").cast("bigint").alias("n_b"))
    return pairs.join(left, "doc_id").join(right, "other").select("doc_id", "other", "n_a", "n_b")


def j03_semi(spark: SparkSession, d: str) -> DataFrame:
    wanted = notebooks(spark, d, "notebook_id", "is_eda").where("is_eda").select("notebook_id")
    return table(spark, d, "documents").select("doc_id", "notebook_id", "kind").join(wanted, "notebook_id", "left_semi").select("doc_id", "kind")


def j16_anti(spark: SparkSession, d: str) -> DataFrame:
    """Kernels of the code table without nested segments."""
    known = table(spark, d, "notebooksegments").select(F.col("notebook_id").alias("kernel_id")).distinct()
    return table(spark, d, "code").select("kernel_id").distinct().join(known, "kernel_id", "left_anti")


def u01_union(spark: SparkSession, d: str) -> DataFrame:
    base = cells(spark, d, "notebook_id", "type", F.size("content").alias("n"))
    code = base.where("type = 'code'").select("notebook_id", F.lit("code").alias("tag"), "n")
    text = base.where("type = 'markdown'").select("notebook_id", F.lit("text").alias("tag"), "n")
    return code.unionByName(text).groupBy("notebook_id", "tag").agg(F.sum("n").alias("lines"))


def u03_except(spark: SparkSession, d: str) -> DataFrame:
    """Nested notebooks beyond those that were measured, by number and source, as bags: what stands more often on the left stays."""
    new = table(spark, d, "notebooksegments").select("notebook_id", "dataset")
    old = table(spark, d, "profile").select("notebook_id", "dataset")
    return new.exceptAll(old)


def s17_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest measurement of each key, old and new ones together."""
    p = table(spark, d, "profile")
    keys = ["notebook_id", "dataset", "method", "model"]
    old, new = p.where("measured_at < '2024-01-01'"), p.where("measured_at >= '2024-01-01'")
    return R.upsert(old, new, keys, "measured_at").select(*keys, "n_ast_children", "st_time")


def s19_update(spark: SparkSession, d: str) -> DataFrame:
    """Statement counts of measurements replaced by the notebook's where it has one."""
    counts = nested(spark, d, "notebook_id", "dataset", "n_ast_children_of_segments").where("n_ast_children_of_segments is not null")
    counts = counts.groupBy("notebook_id", "dataset").agg(F.max("n_ast_children_of_segments").alias("n_ast_children"))
    out = R.updated(table(spark, d, "profile"), counts, ["notebook_id", "dataset"], "n_ast_children")
    return out.select("notebook_id", "dataset", "method", "model", "measured_at", "n_ast_children")


def s20_cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows left per table after notebooks that do not parse are removed with all they own."""
    books = notebooks(spark, d, "can_parse")
    gone = books.where("can_parse = false").select(F.col("_id").alias("notebook_id"))
    tables = {"cell": cells(spark, d, "notebook_id"), "segment": segments(spark, d, "notebook_id"), "notebook": books.withColumnRenamed("_id", "notebook_id")}
    counts = [R.without(t, gone, ["notebook_id"]).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in tables.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def s21_repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.repeated_keys(table(spark, d, "cell").select("notebook_id", "cell_id"), ["notebook_id", "cell_id"])


def s11_ingest(spark: SparkSession, d: str) -> DataFrame:
    books, _ = R.ingest(table(spark, d, "code"), table(spark, d, "notebook").where("is_eda").select("notebook_id"))
    return books.select("notebook_id", "n_cells", "n_code_lines")


def s14_refresh_flags(spark: SparkSession, d: str) -> DataFrame:
    """Notebooks whose stored parse flag differs from what their comment-free cells say."""
    code = cells(spark, d, "notebook_id", "type", F.col("content_no_comment").isNotNull().alias("bare")).where("type = 'code'")
    fresh = code.groupBy("notebook_id").agg(F.bool_and("bare").alias("fresh"))
    books = notebooks(spark, d, "can_parse").withColumnRenamed("_id", "notebook_id")
    return books.join(fresh, "notebook_id").where(~F.col("can_parse").eqNullSafe(F.col("fresh"))).select("notebook_id", "can_parse", "fresh")


def a03_line_counts(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    code = cells(spark, d, "notebook_id", "type", lines("content").alias("n"), lines("content_no_comment").alias("bare")).where("type = 'code'")
    return code.groupBy("notebook_id").agg(F.sum("n").alias("n_lines"), F.sum("bare").alias("n_bare"))


def a05_statement_sums(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d, "notebook_id", "n_ast_children_of_cell").groupBy("notebook_id").agg(F.sum("n_ast_children_of_cell").alias("n_statements"), F.count("n_ast_children_of_cell").alias("n_known"))


def a01_records(spark: SparkSession, d: str) -> DataFrame:
    """Flat records per notebook with its owner: first values, the first cells in order, the number of cells."""
    books = notebooks(spark, d, "user_name", "current_url_slug").withColumnRenamed("_id", "book")
    numbered = running(cells(spark, d, "notebook_id", "cell_id").select("notebook_id", "cell_id"), "notebook_id", "cell_id", pos=("sum", F.lit(1), False))
    kids = numbered.groupBy(F.col("notebook_id").alias("book")).agg(F.array_sort(F.collect_list(F.when(F.col("pos") < 5, F.col("cell_id")))).alias("ids"), F.count("*").alias("n"))
    return books.join(kids, "book").select("user_name", "current_url_slug", F.array_join(F.col("ids").cast("array<string>"), ",").alias("first_cells"), "n")


def p03_candidates(spark: SparkSession, d: str) -> DataFrame:
    return nested(spark, d, "notebook_id", "prompted", "segment_ends", "n_ast_children_of_segments").where("prompted and size(segment_ends) > 3 and n_ast_children_of_segments <= 256").select("notebook_id", "n_ast_children_of_segments")


def p02_numeric_keys(spark: SparkSession, d: str) -> DataFrame:
    """Per file: records whose first field is a whole number, and how many are not."""
    first = F.try_cast(F.trim(F.split("record", ",")[0]), "bigint") if hasattr(F, "try_cast") else F.expr("try_cast(trim(split(record, ',')[0]) as bigint)")
    numbered = table(spark, d, "code_raw").select("file_name", F.when(F.trim(F.split("record", ",")[0]).rlike("^[0-9]{1,18}$"), first).alias("k"))
    return numbered.groupBy("file_name").agg(F.count("k").alias("numeric"), F.count_if(F.col("k").isNull()).alias("other"), F.max("k").alias("largest"))


def p06_eda_by_imports(spark: SparkSession, d: str) -> DataFrame:
    """Notebooks that import what is required and nothing that is forbidden."""
    modules = F.when(F.col("type") == "code", R.imported_modules(F.col("content"))).alias("modules")
    code = cells(spark, d, "notebook_id", "type", modules).where("type = 'code'").select("notebook_id", F.explode_outer("modules").alias("m"))
    per_book = code.groupBy("notebook_id").agg(
        F.bool_or(F.coalesce(F.col("m") == "pandas", F.lit(False))).alias("pandas"), F.bool_or(F.coalesce(F.col("m").rlike("torch|tensorflow|keras|sklearn"), F.lit(False))).alias("learning"), F.count_distinct("m").alias("n_modules")
    )
    return per_book.select("notebook_id", "n_modules", (F.col("pandas") & ~F.col("learning")).alias("eda"))


def p08_line_filter(spark: SparkSession, d: str) -> DataFrame:
    """Code lines without blank ones and comments, per notebook."""
    kept = F.filter("content", lambda x: ~F.startswith(x, F.lit("#")) & (F.trim(x) != ""))
    code = cells(spark, d, "notebook_id", "type", F.coalesce(F.size(kept), F.lit(0)).alias("n")).where("type = 'code'")
    return code.groupBy("notebook_id").agg(F.sum(F.greatest("n", F.lit(0))).alias("n_lines"))


def p11_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Notebooks up to the 99th percentile of code lines."""
    books = notebooks(spark, d, "notebook_id", "n_code_lines").where("n_code_lines is not null")
    limit = books.agg(F.floor(F.percentile("n_code_lines", F.lit(0.99))).alias("most"))
    return books.join(F.broadcast(limit), F.col("n_code_lines") <= F.col("most")).select("notebook_id", "n_code_lines")


def p13_clean_ends(spark: SparkSession, d: str) -> DataFrame:
    ends = A.clean_ends(F.col("segment_ends"))
    books = nested(spark, d, "segment_ends").withColumn("clean", ends)
    return books.select("_id", F.array_join(F.col("clean").cast("array<string>"), ",").alias("ends"), A.valid_ends(F.col("clean"), 64).alias("valid"))


def p17_not_english(spark: SparkSession, d: str) -> DataFrame:
    text = cells(spark, d, "notebook_id", "type", "lang").where("type = 'markdown' and lang is not null")
    share = text.groupBy("notebook_id").agg(F.avg((F.lower(F.substring("lang", 1, 2)) != "en").cast("double")).alias("share"))
    return share.where("share > 0.5").select("notebook_id", F.round("share", 6).alias("share"))


def p18_with_heading(spark: SparkSession, d: str) -> DataFrame:
    text = cells(spark, d, "notebook_id", "type", has_heading(F.col("content")).alias("heading")).where("type = 'markdown'")
    return text.groupBy("notebook_id").agg(F.bool_or("heading").alias("has_heading"))


def p24_uses_pandas(spark: SparkSession, d: str) -> DataFrame:
    uses = F.coalesce(F.exists("content", lambda x: x.contains("pd.") | x.contains("pandas")), F.lit(False))
    code = cells(spark, d, "notebook_id", "type", uses.alias("uses")).where("type = 'code'")
    return code.groupBy("notebook_id").agg(F.bool_or("uses").alias("pandas"))


def o04_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of ten notebooks after the first fifty."""
    return table(spark, d, "notebook").select("notebook_id").distinct().orderBy("notebook_id").offset(50).limit(10)


def o05_split(spark: SparkSession, d: str) -> DataFrame:
    """A seeded four-fifths split that needs no order and no shuffle."""
    h = F.pmod(F.pmod("notebook_id", F.lit(1000003)) * 2654435761 + 42, F.lit(1000003)) % 100
    return table(spark, d, "notebook").select("notebook_id").distinct().select("notebook_id", F.when(h < 80, "train").otherwise("test").alias("part"))


def o06_stratified(spark: SparkSession, d: str) -> DataFrame:
    """At most sixteen notebooks of a cell of the size grid, no two with the same ends, the lowest numbers first."""
    books = nested(spark, d, "notebook_id", "segment_ends", "n_ast_children_of_segments").where("segment_ends is not null and n_ast_children_of_segments between 1 and 256")
    books = books.withColumn("x", F.floor((F.col("n_ast_children_of_segments") - 1) / 32)).withColumn("y", F.least(F.lit(7), F.floor(F.size("segment_ends") / 4)))
    once = books.groupBy("x", "y", F.array_join(F.col("segment_ends").cast("array<string>"), ",").alias("ends")).agg(F.min("notebook_id").alias("notebook_id"))
    return R.lowest(once, ["x", "y"], ["notebook_id", "ends"], 16).select("x", "y", "notebook_id")


def o06_borrowed(spark: SparkSession, d: str) -> DataFrame:
    """The reference's sample: the grid of 4 to 35 segments, sixteen notebooks for each (x, y), a short bin filled from x + 1 and on."""
    books = nested(spark, d, "notebook_id", "segment_ends", "n_ast_children_of_segments").where("size(segment_ends) between 4 and 35 and n_ast_children_of_segments between 1 and 256")
    books = books.select("notebook_id", ((F.col("n_ast_children_of_segments") - 1) / 32).cast("int").alias("x"), (F.floor(F.size("segment_ends") / 4) - 1).cast("int").alias("y"), F.array_join(F.col("segment_ends").cast("array<string>"), ",").alias("ends"))
    return R.borrowed(books, 16, 8)


def a11_size_grid(spark: SparkSession, d: str) -> DataFrame:
    """Counts by statements (rows) and segments (columns)."""
    books = nested(spark, d, F.size("segments").alias("n"), "n_ast_children_of_segments").where("n >= 0 and n_ast_children_of_segments between 1 and 256")
    books = books.select(F.floor((F.col("n_ast_children_of_segments") - 1) / 32).alias("x"), F.least(F.lit(3), F.floor(F.col("n") / 4)).cast("int").alias("y"))
    grid = books.groupBy("x").pivot("y", [0, 1, 2, 3]).count()
    return grid.select("x", *[F.coalesce(F.col(str(i)), F.lit(0)).alias(f"y{i}") for i in range(4)])


def a13_latency(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile")
    return p.groupBy("method", "model").agg(F.count("*").alias("n"), F.round(F.avg("st_time"), 6).alias("mean"), F.round(F.stddev_pop("st_time"), 6).alias("std"), F.count(F.nanvl("repr_time", F.lit(None))).alias("with_repr"))


def a14_latency_bins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile").where("n_ast_children is not null")
    return p.groupBy((F.floor(F.col("n_ast_children") / 32) + 1).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("st_time"), 6).alias("mean"))


def a16_macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a predictor that grows surer of an end over each five statements, against the recorded ends at threshold 0.5: accuracy and
    macro precision, recall and F1 of the two classes, per source."""
    books = nested(spark, d, "dataset", "segment_ends", "n_ast_children_of_segments").where("segment_ends is not null and n_ast_children_of_segments > 0")
    at = books.select("dataset", "segment_ends", F.explode(A.positions(F.col("n_ast_children_of_segments"))).alias("i"))
    t, p = F.array_contains("segment_ends", F.col("i")), (F.col("i") % 5 + 1) / 5 > 0.5
    c = at.groupBy("dataset").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, z: F.coalesce(F.try_divide(a, z), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fn), ratio(tn, tn + fp)
    f1, f0 = ratio(2 * p1 * r1, p1 + r1), ratio(2 * p0 * r0, p0 + r0)
    return c.select("dataset", F.round((tp + tn) / (tp + fp + fn + tn), 6).alias("accuracy"), F.round((p1 + p0) / 2, 6).alias("precision"), F.round((r1 + r0) / 2, 6).alias("recall"), F.round((f1 + f0) / 2, 6).alias("f1"))


def a17_line_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of a cell's lines that the stripped side repeats at the same place; 1 for a cell without lines. Per notebook."""
    same = A.count_where(F.transform("content", lambda x, i: F.when(x.eqNullSafe(F.try_element_at("content_no_comment", i + 1)), 1).otherwise(0)), F.array().cast("array<int>"), lambda x, y: x == 1)
    ratio = F.when(F.size("content") == 0, F.lit(1.0)).otherwise(same / F.size("content"))
    known = (F.col("type") == "code") & F.col("content_no_comment").isNotNull() & F.col("content").isNotNull()
    code = cells(spark, d, "notebook_id", F.when(known, ratio).alias("ratio")).where("ratio is not null")
    return code.groupBy("notebook_id").agg(F.round(F.avg("ratio"), 6).alias("agreement"), F.count("*").alias("n"))


def y17_first_difference(spark: SparkSession, d: str) -> DataFrame:
    """The first line at which a cell and its stripped side differ."""
    at = F.filter(F.transform("content", lambda x, i: F.when(~x.eqNullSafe(F.try_element_at("content_no_comment", i + 1)), i)), lambda i: i.isNotNull())
    known = (F.col("type") == "code") & F.col("content_no_comment").isNotNull() & F.col("content").isNotNull()
    return cells(spark, d, F.when(known, F.try_element_at(at, F.lit(1))).alias("line")).where("line is not null")


def a20_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Share of notebooks per ten code lines within each class, without the longest hundredth."""
    b = notebooks(spark, d, "prompted", "n_code_lines").where("n_code_lines is not null and prompted is not null")
    limit = b.agg(F.percentile("n_code_lines", F.lit(0.99)).alias("most"))
    kept = b.join(F.broadcast(limit), F.col("n_code_lines") <= F.col("most"))
    binned = kept.groupBy("prompted", F.floor(F.col("n_code_lines") / 10).alias("bin")).agg(F.count("*").alias("n"))
    return binned.select("prompted", "bin", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("prompted")), 6).alias("share"))


def a21_melt(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile").groupBy("method").agg(F.round(F.avg("st_time"), 6).alias("st_time"), F.round(F.avg("n_ast_children"), 6).alias("n_ast_children"))
    return p.unpivot("method", ["st_time", "n_ast_children"], "metric", "value")


def a19_distinct_kernels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code").select("kernel_id").distinct()


def s47_missing_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cells that their notebook's list of cells does not name, per notebook."""
    ref = table(spark, d, "notebook").select(F.explode("cells").alias("_id")).distinct()
    return cells(spark, d, "notebook_id").join(ref, "_id", "left_anti").groupBy("notebook_id").agg(F.count("*").alias("unlisted"))


def f32_date_features(spark: SparkSession, d: str) -> DataFrame:
    b = notebooks(spark, d, "notebook_id", "created_at").where("created_at is not null")
    return b.select("notebook_id", F.weekday("created_at").alias("weekday"), F.hour("created_at").alias("hour"), F.date_format("created_at", "yyyy-MM-dd").alias("day"))


def s06_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One notebook by its key, the lowest selected number, with its cells in pages; the key is pushed down to the scan of the cells."""
    key = table(spark, d, "notebook").where("selected").agg(F.min(F.struct("notebook_id", "_id"))["_id"].alias("k")).first()["k"]
    book = notebooks(spark, d, "notebook_id").where(F.col("_id") == key).withColumnRenamed("_id", "book")
    mine = table(spark, d, "cell").where(F.col("notebook_id") == key).select("_id", F.col("notebook_id").alias("book"), "cell_id", "type", "loaded_at")
    pages = R.paged(book, latest(mine, ["_id"], "loaded_at").drop("loaded_at"), "book", "cell_id", "cells")
    return pages.select("notebook_id", "page", F.size("cells").cast("bigint").alias("n_cells"), F.md5(F.array_join(F.transform("cells", lambda c: c["_id"]), ",")).alias("cells"))


def s10_bulk_insert(spark: SparkSession, d: str) -> DataFrame:
    """Code records as cells of new notebooks: each gets the key of its notebook and its place in it, from 0."""
    _, kids = R.ingest(table(spark, d, "code"), table(spark, d, "notebook").where("is_eda").select("notebook_id"))
    placed = running(kids, "notebook_id", "cell_id", block=None, place=("sum", F.lit(1), False))
    return placed.select("notebook_id", F.coalesce("place", F.lit(0)).cast("int").alias("cell_id"), F.size("content").alias("lines"))


def p01_code_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the code records, one row each; equal rows of the load count once."""
    once = table(spark, d, "code").where("source is not null").select("kernel_id", "cell_id", "source").distinct()
    lines = once.select("kernel_id", "cell_id", F.md5("source").alias("record"), F.posexplode(F.split("source", "\n")).alias("line_no", "line"))
    return lines.select("kernel_id", "cell_id", "record", "line_no", F.length("line").alias("letters"))


def f30_flattened(spark: SparkSession, d: str) -> DataFrame:
    """All lines of a nested notebook in one list, segments and cells undone."""
    lines = A.flattened(F.transform("segments", lambda s: F.transform(s["cells"], lambda c: c["content"])), 2)
    books = table(spark, d, "notebooksegments").where("segments is not null")
    return books.select("_id", F.size(lines).cast("bigint").alias("lines"), F.md5(F.array_join(lines, "\n")).alias("digest")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        s05_notebook_scan, j01_nested_cells, j02_materialised_segments, j05_pair_join, j03_semi, j16_anti, u01_union, u03_except, s17_upsert, s19_update,
        s20_cascade_delete, s21_repeated_keys, s11_ingest, s14_refresh_flags, a03_line_counts, a05_statement_sums, a01_records, p03_candidates,
        p02_numeric_keys, p06_eda_by_imports, p08_line_filter, p11_outliers, p13_clean_ends, p17_not_english, p18_with_heading, p24_uses_pandas,
        o04_page, o05_split, o06_stratified, o06_borrowed, a11_size_grid, a13_latency, a14_latency_bins, a16_macro_f1, a17_line_agreement, y17_first_difference,
        a20_histogram, a21_melt, a19_distinct_kernels, s47_missing_keys, f32_date_features, s06_point_lookup, s10_bulk_insert, p01_code_lines, f30_flattened,
    )
}

ORACLE_SQL = {
    "s05_notebook_scan": SQL + "x AS (SELECT 1) SELECT notebook_id, language FROM books WHERE prompted AND selected AND language = 'python'",
    "s06_point_lookup": SQL + """k AS (SELECT _id, notebook_id FROM books WHERE _id = (SELECT arg_min(_id, notebook_id) FROM notebook WHERE selected))
SELECT k.notebook_id, (cell_id // 1000)::BIGINT AS page, count(*) AS n_cells, md5(string_agg(c._id, ',' ORDER BY cell_id)) AS cells FROM k JOIN cells c ON c.notebook_id = k._id GROUP BY 1, 2""",
    "s10_bulk_insert": r"""WITH f AS (SELECT * FROM code WHERE kernel_id NOT IN (SELECT notebook_id FROM notebook WHERE is_eda) AND source IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY kernel_id, cell_id ORDER BY loaded_at DESC, source DESC) = 1)
SELECT kernel_id AS notebook_id, (row_number() OVER (PARTITION BY kernel_id ORDER BY cell_id) - 1)::INT AS cell_id, (length(source) - length(replace(source, chr(10), '')) + 1)::INT AS lines FROM f""",
    "p01_code_lines": """WITH o AS (SELECT DISTINCT kernel_id, cell_id, source, string_split(source, chr(10)) AS l FROM code WHERE source IS NOT NULL)
SELECT kernel_id, cell_id, md5(source) AS record, (i - 1)::INT AS line_no, length(l[i])::INT AS letters FROM o, unnest(range(1, len(l) + 1)) AS t(i)""",
    "f30_flattened": SQL + """l AS (SELECT _id, flatten(flatten(list_transform(segments, lambda s: list_transform(s.cells, lambda c: c.content)))) AS l FROM nested WHERE segments IS NOT NULL)
SELECT _id, len(l) AS lines, md5(array_to_string(l, chr(10))) AS digest FROM l""",
    "j01_nested_cells": SQL + """k AS (SELECT notebook_id AS book, cell_id // 1000 AS page, count(*) AS n, string_agg(type[1], '' ORDER BY cell_id) AS shape FROM cells GROUP BY 1, 2)
SELECT b.notebook_id, coalesce(page, 0)::BIGINT AS page, coalesce(n, 0) AS n_cells, coalesce(shape, '') AS shape FROM books b LEFT JOIN k ON b._id = k.book""",
    "j02_materialised_segments": SQL + """b AS (SELECT notebook_id, unnest(segments) AS s FROM books), p AS (SELECT b.notebook_id, segment_id, has_code, CASE WHEN len(p.cells) > 0 THEN p.cells ELSE [NULL] END AS c FROM b JOIN parts p ON b.s = p._id),
u AS (SELECT notebook_id, segment_id, has_code, unnest(c) AS c FROM p)
SELECT u.notebook_id, segment_id, has_code, (coalesce(cell_id, 0) // 1000)::BIGINT AS page, count(k._id) AS n_cells, coalesce(string_agg(k.type[1], '' ORDER BY cell_id), '') AS shape FROM u LEFT JOIN cells k ON u.c = k._id GROUP BY 1, 2, 3, 4""",
    "j05_pair_join": r"""WITH d AS (SELECT doc_id, notebook_id, length(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS n FROM documents WHERE notebook_id IS NOT NULL AND text IS NOT NULL)
SELECT doc_id, lag(doc_id) OVER w AS other, n AS n_a, lag(n) OVER w AS n_b FROM d WINDOW w AS (PARTITION BY notebook_id ORDER BY doc_id) QUALIFY other IS NOT NULL""",
    "j03_semi": SQL + "x AS (SELECT 1) SELECT doc_id, kind FROM documents WHERE notebook_id IN (SELECT notebook_id FROM books WHERE is_eda)",
    "j16_anti": "SELECT DISTINCT kernel_id FROM code WHERE kernel_id NOT IN (SELECT notebook_id FROM notebooksegments)",
    "u01_union": SQL + "x AS (SELECT 1) SELECT notebook_id, CASE WHEN type = 'code' THEN 'code' ELSE 'text' END AS tag, sum(len(content))::BIGINT AS lines FROM cells WHERE type IN ('code', 'markdown') GROUP BY ALL",
    "u03_except": "SELECT notebook_id, dataset FROM notebooksegments EXCEPT ALL SELECT notebook_id, dataset FROM profile",
    "s17_upsert": "SELECT notebook_id, dataset, method, model, n_ast_children, st_time FROM profile QUALIFY row_number() OVER (PARTITION BY notebook_id, dataset, method, model ORDER BY measured_at DESC, n_ast_children DESC) = 1",
    "s19_update": SQL + """n AS (SELECT notebook_id, dataset, max(n_ast_children_of_segments) AS m FROM nested GROUP BY ALL)
SELECT p.notebook_id, p.dataset, method, model, measured_at, coalesce(m, n_ast_children) AS n_ast_children FROM profile p LEFT JOIN n ON p.notebook_id = n.notebook_id AND p.dataset = n.dataset""",
    "s20_cascade_delete": SQL + """gone AS (SELECT _id FROM books WHERE can_parse = FALSE)
SELECT 'cell' AS name, count(*) AS n FROM cells WHERE notebook_id NOT IN (FROM gone) UNION ALL SELECT 'segment', count(*) FROM parts WHERE notebook_id NOT IN (FROM gone) UNION ALL SELECT 'notebook', count(*) FROM books WHERE _id NOT IN (FROM gone)""",
    "s21_repeated_keys": "SELECT notebook_id, cell_id, count(*) AS n FROM cell GROUP BY ALL HAVING count(*) > 1",
    "s11_ingest": r"""WITH f AS (SELECT * FROM code WHERE kernel_id NOT IN (SELECT notebook_id FROM notebook WHERE is_eda) AND source IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY kernel_id, cell_id ORDER BY loaded_at DESC, source DESC) = 1)
SELECT kernel_id AS notebook_id, count(*) AS n_cells, sum(length(source) - length(replace(source, chr(10), '')) + 1)::BIGINT AS n_code_lines FROM f GROUP BY 1""",
    "s14_refresh_flags": SQL + """f AS (SELECT notebook_id, bool_and(content_no_comment IS NOT NULL) AS fresh FROM cells WHERE type = 'code' GROUP BY 1)
SELECT f.notebook_id, can_parse, fresh FROM books b JOIN f ON b._id = f.notebook_id WHERE can_parse IS DISTINCT FROM fresh""",
    "a03_line_counts": SQL + "x AS (SELECT 1) SELECT notebook_id, sum(coalesce(len(content), 0))::BIGINT AS n_lines, sum(coalesce(len(content_no_comment), 0))::BIGINT AS n_bare FROM cells WHERE type = 'code' GROUP BY 1",
    "a05_statement_sums": SQL + "x AS (SELECT 1) SELECT notebook_id, sum(n_ast_children_of_cell)::BIGINT AS n_statements, count(n_ast_children_of_cell) AS n_known FROM cells GROUP BY 1",
    "a01_records": SQL + """k AS (SELECT notebook_id AS book, list(cell_id ORDER BY cell_id) AS ids FROM cells GROUP BY 1)
SELECT user_name, current_url_slug, array_to_string(ids[1:5], ',') AS first_cells, len(ids) AS n FROM books b JOIN k ON b._id = k.book""",
    "p03_candidates": SQL + "x AS (SELECT 1) SELECT notebook_id, n_ast_children_of_segments FROM nested WHERE prompted AND len(segment_ends) > 3 AND n_ast_children_of_segments <= 256",
    "p02_numeric_keys": "WITH k AS (SELECT file_name, CASE WHEN regexp_full_match(trim(split_part(record, ',', 1), ' '), '[0-9]{1,18}') THEN trim(split_part(record, ',', 1), ' ')::BIGINT END AS k FROM code_raw) SELECT file_name, count(k) AS numeric, count(*) FILTER (k IS NULL) AS other, max(k) AS largest FROM k GROUP BY 1",
    "p06_eda_by_imports": SQL + r"""m AS (SELECT notebook_id, nullif(regexp_extract(l, '^\s*(?:import|from)\s+([A-Za-z_]\w*)', 1), '') AS m FROM (SELECT notebook_id, unnest(content) AS l FROM cells WHERE type = 'code')),
b AS (SELECT DISTINCT notebook_id FROM cells WHERE type = 'code'),
a AS (SELECT notebook_id, bool_or(m = 'pandas') AS p, bool_or(regexp_matches(m, 'torch|tensorflow|keras|sklearn')) AS k, count(DISTINCT m) AS n FROM m GROUP BY 1)
SELECT b.notebook_id, coalesce(n, 0) AS n_modules, coalesce(p, FALSE) AND NOT coalesce(k, FALSE) AS eda FROM b LEFT JOIN a ON b.notebook_id = a.notebook_id""",
    "p08_line_filter": SQL + "x AS (SELECT 1) SELECT notebook_id, sum(coalesce(len(list_filter(content, lambda x: NOT starts_with(x, '#') AND trim(x, ' ') <> '')), 0))::BIGINT AS n_lines FROM cells WHERE type = 'code' GROUP BY 1",
    "p11_outliers": SQL + "x AS (SELECT 1) SELECT notebook_id, n_code_lines FROM books WHERE n_code_lines <= (SELECT floor(quantile_cont(n_code_lines, 0.99)) FROM books)",
    "p13_clean_ends": SQL + """c AS (SELECT _id, list_sort(list_distinct(list_filter(segment_ends, lambda e: e >= 0))) AS e FROM nested)
SELECT _id, array_to_string(e, ',') AS ends, len(e) > 0 AND list_max(e) < 64 AS valid FROM c""",
    "p17_not_english": SQL + "x AS (SELECT 1) SELECT notebook_id, round(avg((lower(lang[1:2]) <> 'en')::INT), 6) AS share FROM cells WHERE type = 'markdown' AND lang IS NOT NULL GROUP BY 1 HAVING avg((lower(lang[1:2]) <> 'en')::INT) > 0.5",
    "p18_with_heading": SQL + "x AS (SELECT 1) SELECT notebook_id, bool_or(heading) AS has_heading FROM heads WHERE type = 'markdown' GROUP BY 1",
    "p24_uses_pandas": SQL + "x AS (SELECT 1) SELECT notebook_id, bool_or(coalesce(len(list_filter(content, lambda x: contains(x, 'pd.') OR contains(x, 'pandas'))) > 0, FALSE)) AS pandas FROM cells WHERE type = 'code' GROUP BY 1",
    "o04_page": "SELECT DISTINCT notebook_id FROM notebook ORDER BY 1 LIMIT 10 OFFSET 50",
    "o05_split": "SELECT DISTINCT notebook_id, CASE WHEN ((notebook_id % 1000003 * 2654435761 + 42) % 1000003) % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM notebook",
    "o06_stratified": SQL + """g AS (SELECT ((n_ast_children_of_segments - 1) // 32)::BIGINT AS x, least(7, len(segment_ends) // 4) AS y, segment_ends, min(notebook_id) AS notebook_id FROM nested
  WHERE segment_ends IS NOT NULL AND n_ast_children_of_segments BETWEEN 1 AND 256 GROUP BY ALL) SELECT x, y, notebook_id FROM g QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY notebook_id) <= 16""",
    "a11_size_grid": SQL + """g AS (SELECT ((n_ast_children_of_segments - 1) // 32)::BIGINT AS x, least(3, len(segments) // 4) AS y FROM nested WHERE segments IS NOT NULL AND n_ast_children_of_segments BETWEEN 1 AND 256)
SELECT x, count(*) FILTER (y = 0) AS y0, count(*) FILTER (y = 1) AS y1, count(*) FILTER (y = 2) AS y2, count(*) FILTER (y = 3) AS y3 FROM g GROUP BY x""",
    "a13_latency": "SELECT method, model, count(*) AS n, round(avg(st_time), 6) AS mean, round(stddev_pop(st_time), 6) AS std, count(*) FILTER (repr_time IS NOT NULL AND NOT isnan(repr_time)) AS with_repr FROM profile GROUP BY ALL",
    "a14_latency_bins": "SELECT (n_ast_children // 32 + 1)::BIGINT AS bin, count(*) AS n, round(avg(st_time), 6) AS mean FROM profile WHERE n_ast_children IS NOT NULL GROUP BY 1",
    "a16_macro_f1": SQL + """p AS (SELECT dataset, list_contains(segment_ends, i) AS t, (i % 5 + 1) / 5.0 > 0.5 AS g FROM nested, unnest(range(0, n_ast_children_of_segments)) AS u(i) WHERE segment_ends IS NOT NULL AND n_ast_children_of_segments > 0),
c AS (SELECT dataset, count(*) FILTER (t AND g)::DOUBLE AS tp, count(*) FILTER (NOT t AND g)::DOUBLE AS fp, count(*) FILTER (t AND NOT g)::DOUBLE AS fn, count(*) FILTER (NOT t AND NOT g)::DOUBLE AS tn FROM p GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p1, coalesce(tp / nullif(tp + fn, 0), 0) AS r1, coalesce(tn / nullif(tn + fn, 0), 0) AS p0, coalesce(tn / nullif(tn + fp, 0), 0) AS r0 FROM c)
SELECT dataset, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((p1 + p0) / 2, 6) AS precision, round((r1 + r0) / 2, 6) AS recall, round((coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) + coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0)) / 2, 6) AS f1 FROM r""",
    "a17_line_agreement": SQL + """l AS (SELECT _id, notebook_id, len(content) AS n, list_sum(list_transform(content, lambda x, i: (x IS NOT DISTINCT FROM content_no_comment[i])::INT)) AS same FROM cells WHERE type = 'code' AND content_no_comment IS NOT NULL AND content IS NOT NULL)
SELECT notebook_id, round(avg(CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE same::DOUBLE / n END), 6) AS agreement, count(*) AS n FROM l GROUP BY 1""",
    "y17_first_difference": SQL + """l AS (SELECT _id, i - 1 AS line FROM cells, unnest(range(1, len(content) + 1)) AS t(i) WHERE type = 'code' AND content_no_comment IS NOT NULL AND content[i] IS DISTINCT FROM content_no_comment[i])
SELECT _id, min(line)::INT AS line FROM l GROUP BY 1""",
    "a20_histogram": SQL + """k AS (SELECT prompted, (n_code_lines // 10)::BIGINT AS bin, count(*) AS n FROM books WHERE prompted IS NOT NULL AND n_code_lines <= (SELECT quantile_cont(n_code_lines, 0.99) FROM books WHERE prompted IS NOT NULL) GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY prompted), 6) AS share FROM k""",
    "a21_melt": """WITH p AS (SELECT method, round(avg(st_time), 6) AS st_time, round(avg(n_ast_children), 6) AS n_ast_children FROM profile GROUP BY 1)
SELECT method, 'st_time' AS metric, st_time AS value FROM p UNION ALL SELECT method, 'n_ast_children', n_ast_children FROM p""",
    "a19_distinct_kernels": "SELECT DISTINCT kernel_id FROM code",
    "s47_missing_keys": SQL + "r AS (SELECT DISTINCT unnest(cells) AS c FROM notebook) SELECT notebook_id, count(*) AS unlisted FROM cells WHERE _id NOT IN (SELECT c FROM r) GROUP BY 1",
    "f32_date_features": SQL + "x AS (SELECT 1) SELECT notebook_id, (isodow(created_at) - 1)::INT AS weekday, hour(created_at)::INT AS hour, strftime(created_at, '%Y-%m-%d') AS day FROM books WHERE created_at IS NOT NULL",
}
